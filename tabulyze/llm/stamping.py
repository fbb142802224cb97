"""Row numbers that survive a retry: they are data of a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabulyze.session import scratch_path

ROW = "row_uid"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from the shared folder; nothing upstream is computed again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stamped(df: DataFrame, name: str, row: str = ROW) -> DataFrame:
    """`written` with a number for each row, unique but not dense."""
    return written(df.withColumn(row, F.monotonically_increasing_id()), name)


def unused(name: str, *frames: DataFrame) -> str:
    """`name`, lengthened until no frame has such a column in any letter case."""
    taken = {c.lower() for frame in frames for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name
