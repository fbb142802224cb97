"""Readers and writers."""

from tabulyze.sources.readers import (
    SourceRegistry,
    load_table,
    read_csv,
    read_json,
    read_parquet,
    read_tsv,
    register_source,
    sources,
)
from tabulyze.sources.sinks import export_csv

__all__ = [
    "SourceRegistry", "export_csv", "load_table", "read_csv", "read_json",
    "read_parquet", "read_tsv", "register_source", "sources",
]
