"""The points of a scatter chart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from tabulyze.functions.columns import CATEGORICAL, col, free_name, role_of
from tabulyze.operators.roles import project_complete_rows
from tabulyze.session import ensure_checkpoint_dir

# Distinct categories, and bytes of their texts, up to which the code table is broadcast.
CODE_LIMIT = 100_000
CODE_BYTES = 16 << 20
HOT_SHARE = 0.01
# Longest text matched by broadcast.
HOT_BYTES = 64 << 10


def category_codes(
    df: DataFrame, column: str, limit: int = CODE_LIMIT, most_bytes: int = CODE_BYTES
) -> tuple[DataFrame, bool]:
    """`column`, `__code`: position among the sorted distinct values, and whether it is small."""
    values = df.select(col(column)).distinct()
    size = F.coalesce(F.sum(F.octet_length(col(column).cast("string"))), F.lit(0))
    distinct, text_bytes = values.agg(F.count("*"), size).first()
    if distinct <= limit and text_bytes <= most_bytes:
        code = F.row_number().over(W.orderBy(col(column))) - 1
        return values.withColumn("__code", code.cast("bigint")), True
    # Sorted across tasks: rows before a task come from a count per task. The sorted table is
    # checkpointed, so that a lost task cannot come back with other rows.
    ensure_checkpoint_dir(df.sparkSession)
    placed = (
        values.orderBy(col(column))
        .withColumn("__task", F.spark_partition_id())
        .checkpoint()
    )
    by_task = placed.groupBy("__task").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.orderBy("__task").rowsBetween(W.unboundedPreceding, -1))
    starts = by_task.select("__task", F.coalesce(before, F.lit(0)).alias("__before"))
    place = F.row_number().over(W.partitionBy("__task").orderBy(col(column))) - 1
    coded = placed.withColumn("__place", place).join(F.broadcast(starts), "__task")
    return coded.select(col(column), (F.col("__before") + F.col("__place")).alias("__code")), False


def _attach_codes(rows: DataFrame, column: str, limit: int) -> DataFrame:
    codes, small = category_codes(rows, column, limit)
    if small:
        return rows.join(F.broadcast(codes), column)
    # At most 1 / HOT_SHARE values can each hold that share of the rows. Their rows are
    # matched by broadcast, so the shuffled join never meets a large key. Rows of longer texts
    # than fit a broadcast are joined like the others; adaptive execution splits them.
    sizes = rows.groupBy(col(column)).agg(F.count("*").alias("__n"))
    short = F.octet_length(col(column).cast("string")) <= HOT_BYTES
    hot = sizes.filter((F.col("__n") > rows.count() * HOT_SHARE) & short).select(col(column))
    hot_codes = F.broadcast(codes.join(F.broadcast(hot), column, "left_semi"))
    warm = rows.join(F.broadcast(hot), column, "left_anti").join(codes, column)
    return rows.join(hot_codes, column).unionByName(warm)


def scatter_points(
    df: DataFrame,
    x_column: str,
    y_column: str,
    color_column: str | None = None,
    size_column: str | None = None,
    limit: int = CODE_LIMIT,
) -> DataFrame:
    """Complete rows of the asked columns; a text colour column adds `color_code`."""
    wanted = [c for c in (x_column, y_column, color_column, size_column) if c]
    points = project_complete_rows(df, list(dict.fromkeys(wanted)))
    if not color_column or role_of(df.schema[color_column].dataType) != CATEGORICAL:
        return points
    coded = _attach_codes(points, color_column, limit)
    out = free_name("color_code", points.columns)
    return coded.select(*[col(c) for c in points.columns], F.col("__code").alias(out))
