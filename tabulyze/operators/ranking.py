"""Grouped measures, value counts and top/bottom lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tabulyze.functions.columns import (
    as_double, col, complete_rows, free_name, is_missing, nan_to_null, quoted, tie_break,
)
from tabulyze.functions.order_stats import GROUP_LIMIT, grouped_median
from tabulyze.functions.text import safe_divide
from tabulyze.operators.roles import require_columns


def group_measure(
    df: DataFrame,
    key: str,
    value: str,
    aggregation: str = "sum",
    out: str = "value",
    median_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """One row per present key. Sum, mean and count combine before the shuffle.

    A group without values sums to 0; an unknown aggregation is a sum.
    """
    require_columns(df, [key, value])
    clean = nan_to_null(df.select(*dict.fromkeys([quoted(key), quoted(value)])))
    kept = clean.filter(col(key).isNotNull())
    if aggregation == "median":
        return grouped_median(kept, [key], value, out, median_limit)
    measures = {
        "mean": F.avg(as_double(value)),
        "count": F.count(col(value)),
        "sum": F.coalesce(F.sum(col(value)), F.lit(0)),
    }
    return kept.groupBy(col(key)).agg(measures.get(aggregation, measures["sum"]).alias(out))


def value_counts(df: DataFrame, column: str, out: str = "n") -> DataFrame:
    """Rows per present value."""
    require_columns(df, column)
    kept = complete_rows(nan_to_null(df.select(col(column))))
    return kept.groupBy(col(column)).agg(F.count("*").alias(out))


def sorted_value_counts(df: DataFrame, column: str) -> DataFrame:
    out = free_name("n", [column])
    return value_counts(df, column, out).orderBy(F.desc(out), col(column))


def long_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`column`, `value` rows of the given columns, all of one type, missing left out."""
    pairs = [
        F.struct(F.lit(c).alias("column"), col(c).alias("value")) for c in columns
    ]
    exploded = df.select(F.explode(F.array(*pairs)).alias("s")).select("s.column", "s.value")
    return exploded.filter(F.col("value").isNotNull())


def column_value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`column`, `value`, `n` for several columns of one type, counted in one shuffle."""
    return long_values(df, columns).groupBy("column", "value").agg(F.count("*").alias("n"))


HEAD = 32  # characters that travel with the hash of a text
FEW = 1000  # candidates sent to the tasks; more are joined by shuffle


def hashed_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`column`, `h1`, `h2`, `n` for text columns, with each text's `head` and if it is `longer`.

    Texts are told apart by 128 bits of hashes, so no exchange carries a whole text.
    """
    pairs = [
        F.struct(
            F.lit(c).alias("column"), F.xxhash64(col(c)).alias("h1"),
            F.xxhash64(F.lit(HEAD), col(c)).alias("h2"),
            F.substring(col(c), 1, HEAD).alias("head"),
            (F.length(col(c)) > HEAD).alias("longer"),
        )
        for c in columns
    ]
    rows = df.select(F.explode(F.array(*pairs)).alias("s")).select("s.*")
    # Equal texts have one head, which a minimum keeps as it is.
    return rows.filter(F.col("head").isNotNull()).groupBy("column", "h1", "h2").agg(
        F.count("*").alias("n"), F.min("head").alias("head"), F.max("longer").alias("longer"))


def top_values(df: DataFrame, columns: Sequence[str], top: int) -> DataFrame:
    """`column`, `rank`, `value`, `n`: the most frequent texts of each column, ties by value.

    Candidates are found by counts and heads; only texts longer than a head are fetched by a second
    pass over the table, and only those of candidates. All columns must be text.
    """
    spark = df.sparkSession
    by_count = W.partitionBy("column").orderBy(F.desc("n"), "head")
    keys = ["column", "h1", "h2"]
    candidates = (
        hashed_counts(df, columns)
        .withColumn("place", F.rank().over(by_count)).filter(F.col("place") <= top)
        .select(*keys, "head", "longer", "n")
    )
    few = candidates.limit(FEW + 1).collect()
    if len(few) <= FEW:
        found = spark.createDataFrame(few, candidates.schema)
        wanted = F.broadcast(found.filter("longer").select(*keys))  # at most FEW rows of hashes
        cut = sorted({r["column"] for r in few if r["longer"]})
    else:
        found, cut = candidates, list(columns)
        wanted = candidates.filter("longer").select(*keys)
    value = F.col("head")
    if cut:
        rows = long_values(df, cut).withColumns({
            "h1": F.xxhash64("value"), "h2": F.xxhash64(F.lit(HEAD), F.col("value"))})
        texts = (
            rows.filter(F.length("value") > HEAD).join(wanted, keys)
            .groupBy(*keys).agg(F.min("value").alias("text"), F.max("value").alias("other"))
        )
        found = found.join(texts, keys, "left")
        same = F.col("text").eqNullSafe(F.col("other"))
        value = F.when(same, F.coalesce("text", "head")).otherwise(
            F.raise_error(F.lit("two texts share 128 bits of hashes")))
    place = F.row_number().over(W.partitionBy("column").orderBy(F.desc("n"), "value"))
    return (
        found.select("column", value.alias("value"), "n")
        .withColumn("rank", place.cast("int")).filter(F.col("rank") <= top)
        .select("column", "rank", "value", "n")
    )


def column_modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """`column`, `value`, `n`: the most frequent value, the smallest on ties."""
    if all(df.schema[c].dataType == T.StringType() for c in columns):
        return top_values(df, columns, 1).select("column", "value", "n")
    best = F.min(F.struct((-F.col("n")).alias("m"), "value"))
    return (
        column_value_counts(df, columns)
        .groupBy("column").agg(best.alias("s"))
        .select("column", "s.value", (-F.col("s.m")).alias("n"))
    )


LISTED = ("side", "rank", "value", "side_count", "side_total", "contribution")


def listed_name(column: str) -> str:
    """What a key column is called in a top/bottom list, whose own columns come first."""
    return free_name(column, LISTED)


def _ranked(rows: DataFrame, order: Sequence[Column], side: str) -> DataFrame:
    # `rows` is already a limit of a few rows, so the window stays small.
    return rows.select(
        F.lit(side).alias("side"),
        F.row_number().over(W.orderBy(*order)).cast("int").alias("rank"),
        "*",
    )


def _with_side_totals(listed: DataFrame, total: Column) -> DataFrame:
    side = W.partitionBy("side")
    side_total = F.sum(F.col("value").cast("double")).over(side)
    share = F.when(total == 0, F.lit(0.0)).otherwise(safe_divide(side_total, total))
    return listed.withColumns(
        {
            "side_count": F.count("*").over(side),
            "side_total": F.coalesce(side_total, F.lit(0.0)),
            "contribution": share,
        }
    )


def top_bottom(
    df: DataFrame,
    column: str,
    group_by: str | None = None,
    top_n: int = 5,
    bottom_n: int = 5,
    aggregation: str = "sum",
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """Highest and lowest groups, or rows when `group_by` is None.

    Columns: `side`, `rank`, the group or key columns, `value`, `side_count`, `side_total`
    and `contribution`, the side's share in the total of all listed candidates. Groups
    without a value sort last, which puts them at the bottom. Ties go by group or key. A key
    column with one of these names gets an underscore.
    """
    require_columns(df, [column] + ([group_by] if group_by else []))
    if group_by:
        rows = group_measure(df, group_by, column, aggregation, "__measure").select(
            col(group_by).alias(listed_name(group_by)),
            F.col("__measure").alias("value"),
        )
        names = [listed_name(group_by)]
    else:
        key_columns = tie_break(df, keys, column)
        names = [listed_name(k) for k in key_columns]
        rows = nan_to_null(df).filter(~is_missing(df, column)).select(
            *[col(k).alias(listed_name(k)) for k in key_columns],
            col(column).alias("value"),
        )
    ties = [col(k) for k in names]
    high = [F.col("value").desc_nulls_last(), *[c.asc() for c in ties]]
    # Groups without a value count as lowest, yet are shown after the lowest values.
    low = [F.col("value").asc_nulls_first(), *[c.asc() for c in ties]]
    shown_low = [F.col("value").asc_nulls_last(), *[c.asc() for c in ties]]
    top = _ranked(rows.orderBy(*high).limit(top_n), high, "top")
    bottom = _ranked(rows.orderBy(*low).limit(bottom_n), shown_low, "bottom")
    total = F.coalesce(rows.agg(F.sum(F.col("value").cast("double"))).scalar(), F.lit(0.0))
    return _with_side_totals(top.unionByName(bottom), total)


def top_bottom_contribution(
    df: DataFrame,
    column: str,
    group_by: str | None = None,
    top_n: int = 5,
    bottom_n: int = 5,
    aggregation: str = "sum",
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """One row per side: `side`, `side_count`, `side_total`, `contribution`."""
    listed = top_bottom(df, column, group_by, top_n, bottom_n, aggregation, keys)
    return listed.groupBy("side").agg(
        F.max("side_count").alias("side_count"),
        F.max("side_total").alias("side_total"),
        F.max("contribution").alias("contribution"),
    )


def category_series(
    df: DataFrame,
    column: str,
    value_column: str | None = None,
    aggregation: str = "count",
    top_n: int | None = None,
) -> DataFrame:
    """A measure per category, largest first, optionally only the `top_n` largest.

    Without a value column, or with count or an unknown aggregation, rows are counted.
    """
    require_columns(df, [column] + ([value_column] if value_column else []))
    out = free_name("value", [column])
    if value_column and aggregation in ("sum", "mean", "median"):
        rows = group_measure(df, column, value_column, aggregation, out)
    else:
        rows = value_counts(df, column, out)
    if top_n:
        # Groups without a value are not among the largest.
        rows = rows.filter(F.col(out).isNotNull())
    ordered = rows.orderBy(F.col(out).desc_nulls_last(), col(column))
    return ordered.limit(top_n) if top_n else ordered


def category_share(
    df: DataFrame,
    column: str,
    value_column: str | None = None,
    aggregation: str = "count",
    top_n: int | None = None,
) -> DataFrame:
    """Pie shares: each shown category as a percentage of all shown, one decimal."""
    shown = category_series(df, column, value_column, aggregation, top_n)
    out = free_name("value", [column])
    total = shown.agg(F.sum(out)).scalar().cast("double")
    return shown.withColumn(
        free_name("share", [column]),
        F.round(F.try_divide(F.col(out).cast("double"), total) * 100, 1),
    )
