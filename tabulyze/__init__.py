"""Table profiling, cleaning and insight operators over Spark DataFrames."""

__version__ = "0.1.0"
