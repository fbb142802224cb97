"""Table profile: size, missing values, numeric and text summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabulyze.functions.columns import (
    CATEGORICAL, as_double, col, column_types, is_missing, nan_to_null, numeric_columns,
)
from tabulyze.functions.facts import VALUE_LIMIT, Asked, answered
from tabulyze.operators.correlation import correlation_matrix
from tabulyze.operators.ranking import hashed_counts, top_values

QUARTILES = (0.25, 0.5, 0.75)
NUMERIC_SCHEMA = (
    "column string, count bigint, mean double, std double, min double, "
    "q25 double, q50 double, q75 double, max double"
)
TEXT_SCHEMA = (
    "column string, unique_count bigint, top_value string, top_frequency bigint, "
    "rank int, value string, n bigint"
)


def basic_info(df: DataFrame) -> DataFrame:
    """`position`, `column`, `type`, `rows`, `columns`; a Parquet count reads only footers."""
    listed = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"), F.lit(name).alias("column"), F.lit(kind).alias("type")
            )
            for i, (name, kind) in enumerate(df.dtypes)
        ]
    )
    counted = df.agg(F.count("*").alias("rows"))
    return counted.select(
        F.inline(listed), F.col("rows"), F.lit(len(df.columns)).alias("columns")
    )


def missing_report(df: DataFrame) -> DataFrame:
    """Columns with missing values: `column`, `missing_count`, `missing_percentage`."""
    counted = df.agg(
        F.count("*").alias("rows"),
        *[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)],
    )
    listed = F.array(
        *[
            F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing_count"))
            for i, c in enumerate(df.columns)
        ]
    )
    share = F.try_divide(F.col("missing_count"), F.col("rows")) * 100
    return (
        counted.select("rows", F.inline(listed))
        .filter("missing_count > 0")
        .select("column", "missing_count", F.round(share, 2).alias("missing_percentage"))
        .orderBy(F.desc("missing_count"), "column")
    )


def numeric_asked(columns: list[str]) -> Asked:
    """What `numeric_summary` needs of each column."""
    asked = Asked({}, {})
    for i, name in enumerate(columns):
        c = as_double(name)
        asked.aggregates |= {
            f"count{i}": F.count(c), f"mean{i}": F.avg(c), f"std{i}": F.stddev_samp(c),
            f"min{i}": F.min(c), f"max{i}": F.max(c)}
        asked.quantiles[f"q{i}"] = (c, QUARTILES)
    return asked


def numeric_summary(df: DataFrame, limit: int = VALUE_LIMIT) -> DataFrame:
    """count, mean, std, min, quartiles, max per numeric column; no rows if there is none."""
    numeric = numeric_columns(df)
    spark = df.sparkSession
    if not numeric:
        return spark.createDataFrame([], NUMERIC_SCHEMA)
    clean = nan_to_null(df.select(*[col(c) for c in numeric]))
    found = answered(clean, numeric_asked(numeric), limit=limit)[0]
    return spark.createDataFrame([
        (name, *(found[f"{k}{i}"] for k in ("count", "mean", "std", "min")), *found[f"q{i}"],
         found[f"max{i}"])
        for i, name in enumerate(numeric)
    ], NUMERIC_SCHEMA)


def text_summary(df: DataFrame, top: int = 10) -> DataFrame:
    """Distinct count, mode and the `top` most frequent values of each text column.

    One row per listed value. Texts are counted by hashes; those listed are fetched by `top_values`.
    """
    text = column_types(df)[CATEGORICAL]
    if not text:
        return df.sparkSession.createDataFrame([], TEXT_SCHEMA)
    listed = top_values(df, text, top)
    totals = hashed_counts(df, text).groupBy("column").agg(F.count("*").alias("unique_count"))
    first = listed.filter("rank = 1").select(
        "column", F.col("value").alias("top_value"), F.col("n").alias("top_frequency"))
    # Both have one row per text column of the schema, and `listed` a few of each.
    return listed.join(totals, "column").join(first, "column").select(
        "column", "unique_count", "top_value", "top_frequency", "rank", "value", "n"
    )


def _long(df: DataFrame, section: str, name: Column, metrics: dict[str, Column]) -> DataFrame:
    pairs = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value"))
            for m, v in metrics.items()
        ]
    )
    return df.select(
        F.lit(section).alias("section"), name.alias("column"), F.inline(pairs)
    ).withColumn("text", F.lit(None).cast("string"))


def full_profile(df: DataFrame) -> DataFrame:
    """All parts in long form: `section`, `column`, `metric`, `value`, `text`."""
    info = basic_info(df)
    parts = [
        _long(info, "basic_info", F.col("column"), {"rows": F.col("rows")}).withColumn(
            "text", F.get(F.lit([t for _, t in df.dtypes]), F.array_position(
                F.lit(df.columns), F.col("column")).cast("int") - 1)
        ),
        _long(
            missing_report(df), "missing_values", F.col("column"),
            {m: F.col(m) for m in ("missing_count", "missing_percentage")},
        ),
        _long(
            numeric_summary(df), "numerical_summary", F.col("column"),
            {m: F.col(m) for m in ("count", "mean", "std", "min", "q25", "q50", "q75", "max")},
        ),
    ]
    summary = text_summary(df)
    first = summary.filter("rank = 1")
    parts.append(
        _long(first, "categorical_summary", F.col("column"),
              {m: F.col(m) for m in ("unique_count", "top_frequency")})
    )
    parts.append(
        summary.select(
            F.lit("value_counts").alias("section"), "column",
            F.col("rank").cast("string").alias("metric"),
            F.col("n").cast("double").alias("value"), F.col("value").alias("text"),
        )
    )
    if len(numeric_columns(df)) >= 2:
        parts.append(
            correlation_matrix(df).select(
                F.lit("correlation_matrix").alias("section"),
                F.col("variable1").alias("column"), F.col("variable2").alias("metric"),
                F.col("r").alias("value"), F.lit(None).cast("string").alias("text"),
            )
        )
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
