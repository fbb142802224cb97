"""Outlier removal and anomaly detection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabulyze.functions.columns import (
    as_double, col, complete_rows, free_name, nan_to_null, tie_break,
)
from tabulyze.functions.facts import VALUE_LIMIT, Answer, Asked, answered
from tabulyze.functions.order_stats import quantile_values
from tabulyze.functions.text import safe_divide
from tabulyze.operators.roles import is_numerical, require_columns

METHODS = ("zscore", "iqr")


def _center(df: DataFrame, column: str) -> tuple[float | None, float | None]:
    c = as_double(column)
    return tuple(df.agg(F.avg(c), F.stddev_samp(c)).first())


def _fences(
    df: DataFrame, column: str, threshold: float, limit: int
) -> tuple[float | None, float | None]:
    q1, q3 = quantile_values(df, [column], [0.25, 0.75], limit)[column]
    if q1 is None:
        return None, None
    return q1 - threshold * (q3 - q1), q3 + threshold * (q3 - q1)


def z_score(column: str, mean: float | None, std: float | None) -> Column:
    """|x - mean| / std; NULL when the deviation is missing or 0."""
    if mean is None or not std:
        return F.lit(None).cast("double")
    return F.abs((as_double(column) - F.lit(mean)) / F.lit(std))


def remove_outliers(
    df: DataFrame,
    columns: Sequence[str],
    method: str = "zscore",
    threshold: float = 3.0,
    limit: int = VALUE_LIMIT,
) -> DataFrame:
    """Drop outlier rows, column after column, each judged on the rows still left.

    z-score keeps |z| < threshold, iqr keeps values on or within the fences; rows missing the
    value go. Missing or non-numeric columns and unknown methods are passed over. Each step
    brings one row of statistics to the driver and adds one literal filter, so the plan grows
    by a filter per column and the scan can skip files by the bounds.
    """
    kept = nan_to_null(df)
    for name in columns:
        if name not in df.columns or not is_numerical(df, name) or method not in METHODS:
            continue
        if method == "zscore":
            kept = kept.filter(z_score(name, *_center(kept, name)) < threshold)
        else:
            low, high = _fences(kept, name, threshold, limit)
            kept = kept.filter(
                F.lit(False) if low is None else as_double(name).between(low, high)
            )
    return kept


def _check(df: DataFrame, column: str, method: str) -> None:
    require_columns(df, column)
    if method not in METHODS:
        raise ValueError(f"Unsupported method: {method}")


def _anomaly_test(
    df: DataFrame, column: str, method: str, threshold: float, limit: int,
    facts: Answer | None = None,
) -> tuple[Column, Column]:
    """(is anomaly, z-score) for present values, with literals from one or two jobs.

    `facts` of the column (mean, std, q1, q3) spare the jobs.
    """
    z = z_score(column, *((facts["mean"], facts["std"]) if facts else _center(df, column)))
    if method == "zscore":
        return F.coalesce(z > threshold, F.lit(False)), z
    if facts:
        q1, q3 = facts["q1"], facts["q3"]
        reach = None if q1 is None else threshold * (q3 - q1)
        low, high = (None, None) if q1 is None else (q1 - reach, q3 + reach)
    else:
        low, high = _fences(df, column, threshold, limit)
    if low is None:
        return F.lit(False), z
    c = as_double(column)
    return (c < low) | (c > high), z


def spread_asked(column: str) -> Asked:
    """Mean, deviation and quartiles of a column without NaN, as anomalies need them."""
    c = as_double(column)
    return Asked({"mean": F.avg(c), "std": F.stddev_samp(c)}, {"quartiles": (c, (0.25, 0.5, 0.75))})


def spread_of(answer: Answer) -> Answer:
    return answer | dict(zip(("q1", "median", "q3"), answer["quartiles"]))


def spread_facts(df: DataFrame, column: str, limit: int = VALUE_LIMIT) -> Answer:
    rows = nan_to_null(df.select(col(column)))
    return spread_of(answered(rows, spread_asked(column), limit=limit)[0])


def anomaly_values(
    df: DataFrame,
    column: str,
    method: str = "zscore",
    threshold: float = 3.0,
    rows: int = 20,
    limit: int = VALUE_LIMIT,
    facts: Answer | None = None,
) -> DataFrame:
    """`rank`, `value`: the anomalies farthest from the mean, ties by value."""
    _check(df, column, method)
    present = complete_rows(nan_to_null(df.select(col(column))))
    hit, z = _anomaly_test(present, column, method, threshold, limit, facts)
    far = present.filter(hit).select(z.alias("z"), as_double(column).alias("value")) \
        .orderBy(F.desc("z"), "value").limit(rows)
    place = F.row_number().over(W.orderBy(F.desc("z"), "value"))  # over a few rows
    return far.select(place.alias("rank"), "value")


def anomalies(
    df: DataFrame,
    column: str,
    method: str = "zscore",
    threshold: float = 3.0,
    limit: int = VALUE_LIMIT,
) -> DataFrame:
    """Rows whose value is an anomaly, with their z-score in `z`."""
    _check(df, column, method)
    present = nan_to_null(df).filter(col(column).isNotNull())
    hit, z = _anomaly_test(present, column, method, threshold, limit)
    return present.filter(hit).withColumn(free_name("z", df.columns), z)


def anomaly_sample(
    df: DataFrame,
    column: str,
    method: str = "zscore",
    threshold: float = 3.0,
    rows: int = 20,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """The `rows` anomalies farthest from the mean, ties by key."""
    found = anomalies(df, column, method, threshold)
    ties = [col(k) for k in tie_break(df, keys)]
    return found.orderBy(F.desc(free_name("z", df.columns)), *ties).limit(rows)


def anomaly_summary(
    df: DataFrame,
    column: str,
    method: str = "zscore",
    threshold: float = 3.0,
    limit: int = VALUE_LIMIT,
    facts: Answer | None = None,
) -> DataFrame:
    """One row of counts and statistics; `error` is set when there is too little to judge."""
    require_columns(df, column)
    columns = (
        "total_points bigint, anomaly_count bigint, anomaly_share double, mean double, "
        "median double, std double, min double, max double, min_anomaly double, "
        "max_anomaly double, error string"
    )
    if not is_numerical(df, column):
        row = [(None,) * 10 + (f"Column {column} is not numerical",)]
        return df.sparkSession.createDataFrame(row, columns)
    _check(df, column, method)
    present = complete_rows(nan_to_null(df.select(col(column))))
    facts = facts or spread_facts(df, column, limit)
    hit, _ = _anomaly_test(present, column, method, threshold, limit, facts)
    c = as_double(column)
    stats = present.agg(
        F.count("*").alias("total_points"),
        F.count_if(hit).alias("anomaly_count"),
        F.avg(c).alias("mean"),
        F.lit(facts["median"]).cast("double").alias("median"),
        F.stddev_samp(c).alias("std"),
        F.min(c).alias("min"),
        F.max(c).alias("max"),
        F.min(F.when(hit, c)).alias("min_anomaly"),
        F.max(F.when(hit, c)).alias("max_anomaly"),
    )
    few = F.col("total_points") < 3
    share = safe_divide(F.col("anomaly_count"), F.col("total_points"))
    shown = stats.withColumn("anomaly_share", share)
    names = [part.split()[0] for part in columns.split(", ")][:-1]
    return shown.select(
        *[
            (F.col(n) if n == "total_points" else F.when(~few, F.col(n))).alias(n) for n in names
        ],
        F.when(few, F.lit("Insufficient data")).alias("error"),
    )
