"""Distribution statistics and the series behind histogram, box and violin charts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabulyze.functions.columns import as_double, col, complete_rows, free_name, nan_to_null
from tabulyze.functions.moments import kurtosis_adjusted, skewness_adjusted
from tabulyze.functions.facts import VALUE_LIMIT, Answer, Asked, answered
from tabulyze.functions.order_stats import quantile_values
from tabulyze.functions.text import safe_divide
from tabulyze.operators.ranking import top_values, value_counts
from tabulyze.operators.roles import is_numerical, require_columns

NO_DATA = "No valid data"
WHISKER = 1.5
GRID_POINTS = 100


def shape_label(skewness: Column, kurtosis: Column) -> Column:
    """Six labels, tested in this order; missing moments give the last one.

    Fixed values: the labels and limits of the reference.
    """
    normal = (F.abs(skewness) < 0.5) & (F.abs(kurtosis) < 0.5)
    return (
        F.when(normal, "approximately normal")
        .when(skewness > 0.5, "right-skewed (positive skew)")
        .when(skewness < -0.5, "left-skewed (negative skew)")
        .when(kurtosis > 1, "heavy-tailed (leptokurtic)")
        .when(kurtosis < -1, "light-tailed (platykurtic)")
        .otherwise("mixed characteristics")
    )


def _values(df: DataFrame, column: str) -> DataFrame:
    require_columns(df, column)
    if not is_numerical(df, column):
        raise ValueError(f"Column {column} is not numerical")
    return complete_rows(nan_to_null(df.select(as_double(column).alias("v"))))


def numeric_mode(df: DataFrame, column: str) -> DataFrame:
    """One row: the most frequent value, the smallest on ties."""
    counts = value_counts(df.select(as_double(column).alias("v")), "v")
    best = F.min(F.struct((-F.col("n")).alias("m"), "v"))
    return counts.agg(best.alias("s")).select(F.col("s.v").alias("mode"))


DISTRIBUTION = (
    "count bigint, mean double, median double, std double, min double, max double, "
    "range double, q1 double, q3 double, iqr double, skewness double, kurtosis double"
)


def distribution_asked(column: str) -> Asked:
    """What `numeric_distribution` needs of a column without NaN."""
    v = as_double(column)
    return Asked({
        "count": F.count(v), "mean": F.avg(v), "std": F.stddev_samp(v), "min": F.min(v),
        "max": F.max(v), "skewness": skewness_adjusted(v), "kurtosis": kurtosis_adjusted(v),
    }, {"quartiles": (v, (0.25, 0.5, 0.75))})


def numeric_distribution(
    df: DataFrame, column: str, limit: int = VALUE_LIMIT, facts: Answer | None = None
) -> DataFrame:
    """One row of moments, quartiles, mode and shape; `error` when there are no values.

    `facts` answer `distribution_asked` where they are known.
    """
    rows = _values(df, column)
    if facts is None:
        facts = answered(rows, distribution_asked("v"), limit=limit)[0]
    q1, median, q3 = facts["quartiles"]
    found = facts | {"q1": q1, "median": median, "q3": q3, "iqr": None, "range": None}
    if facts["count"]:
        found |= {"iqr": q3 - q1, "range": facts["max"] - facts["min"]}
    names = [part.split()[0] for part in DISTRIBUTION.split(", ")]
    stats = df.sparkSession.createDataFrame([tuple(found[n] for n in names)], DISTRIBUTION)
    empty = F.col("count") == 0
    return stats.select(
        "count", "mean", "median", numeric_mode(rows, "v").scalar().alias("mode"),
        *stats.columns[3:],
        F.when(~empty, shape_label(F.col("skewness"), F.col("kurtosis"))).alias("shape"),
        F.when(empty, F.lit(NO_DATA)).alias("error"),
    )


def _texts_with_counts(df: DataFrame, column: str) -> DataFrame:
    out = free_name("n", [column])
    return value_counts(df, column, out).select(
        col(column).cast("string").alias("value"), F.col(out).alias("n"))


def categorical_distribution(df: DataFrame, column: str) -> DataFrame:
    """One row: count, distinct values, most and least common value; ties by value."""
    counts = _texts_with_counts(df, column)
    most = F.min(F.struct((-F.col("n")).alias("m"), "value"))
    least = F.min(F.struct("n", "value"))
    stats = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("count"),
        F.count("*").alias("unique_values"),
        most.alias("most"), least.alias("least"),
    )
    top = -F.col("most.m")
    return stats.select(
        "count", "unique_values",
        F.col("most.value").alias("most_common"), top.alias("most_common_count"),
        F.when(F.col("count") > 0, safe_divide(top, F.col("count"))).alias("most_common_share"),
        F.col("least.value").alias("least_common"), F.col("least.n").alias("least_common_count"),
        F.when(F.col("count") == 0, F.lit(NO_DATA)).alias("error"),
    )


def common_values(df: DataFrame, column: str, top_n: int = 10) -> DataFrame:
    """`rank`, `value`, `n`: the most frequent values, ties by value."""
    if dict(df.dtypes).get(column) == "string":
        return top_values(df, [column], top_n).select("rank", "value", "n")
    counts = _texts_with_counts(df, column)
    place = F.row_number().over(W.orderBy(F.desc("n"), "value"))  # over a few rows
    return counts.orderBy(F.desc("n"), "value").limit(top_n).select(
        place.alias("rank"), "value", "n")


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """`bin`, `low`, `high`, `n` for equal-width bins from min to max, last one closed.

    Empty bins are listed. A constant column is spread over value ± 0.5.
    """
    rows = _values(df, column)
    low, high = rows.agg(F.min("v"), F.max("v")).first()
    if low is None:
        raise ValueError(f"No valid data in column '{column}'")
    if not (math.isfinite(low) and math.isfinite(high)):
        raise ValueError(f"Column '{column}' holds values that are not finite")
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins

    def edge(i: Column) -> Column:
        return F.when(i == bins, F.lit(high)).otherwise(F.lit(low) + i * F.lit(width))

    v = F.col("v")
    guess = F.least(F.floor((v - low) / F.lit(high - low) * bins), F.lit(bins - 1)).cast("int")
    # Rounding can put a value next to an edge one bin off; the edges decide.
    settled = (
        F.when(v < edge(F.col("g")), F.col("g") - 1)
        .when((F.col("g") < bins - 1) & (v >= edge(F.col("g") + 1)), F.col("g") + 1)
        .otherwise(F.col("g"))
    )
    counted = (
        rows.withColumn("g", guess).groupBy(settled.alias("bin")).agg(F.count("*").alias("n"))
    )
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (
        every.join(F.broadcast(counted), "bin", "left")  # at most `bins` rows
        .select(
            "bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
        .orderBy("bin")
    )


def box_stats(df: DataFrame, column: str, limit: int = VALUE_LIMIT) -> DataFrame:
    """Quartiles, whiskers at the farthest values within 1.5 IQR, and outlier counts."""
    rows = _values(df, column)
    q1, q2, q3 = quantile_values(rows, ["v"], [0.25, 0.5, 0.75], limit)["v"]
    if q1 is None:
        raise ValueError(f"No valid data in column '{column}'")
    low, high = q1 - WHISKER * (q3 - q1), q3 + WHISKER * (q3 - q1)
    v = F.col("v")
    return rows.agg(
        F.lit(q1).alias("q1"), F.lit(q2).alias("median"), F.lit(q3).alias("q3"),
        F.min(F.when(v >= low, v)).alias("whisker_low"),
        F.max(F.when(v <= high, v)).alias("whisker_high"),
        F.count_if((v < low) | (v > high)).alias("outliers"),
        F.count("*").alias("n"),
    )


def box_outliers(df: DataFrame, column: str, limit: int = VALUE_LIMIT) -> DataFrame:
    """The values outside the whiskers, with their counts."""
    rows = _values(df, column)
    q1, q3 = quantile_values(rows, ["v"], [0.25, 0.75], limit)["v"]
    if q1 is None:
        raise ValueError(f"No valid data in column '{column}'")
    low, high = q1 - WHISKER * (q3 - q1), q3 + WHISKER * (q3 - q1)
    outside = rows.filter((F.col("v") < low) | (F.col("v") > high))
    return outside.groupBy("v").agg(F.count("*").alias("n"))


def density_curve(df: DataFrame, column: str, points: int = GRID_POINTS) -> DataFrame:
    """`point`, `x`, `density`: a Gaussian kernel curve, bandwidth n^(-1/5) times std.

    A constant column has no width: one point, density NULL. Each grid point is one sum, so
    rows are neither shuffled nor multiplied by the grid.
    """
    rows = _values(df, column)
    n, std, low, high = rows.agg(
        F.count("*"), F.stddev_samp("v"), F.min("v"), F.max("v")
    ).first()
    if not n:
        raise ValueError(f"No valid data in column '{column}'")
    if not std:
        return rows.limit(1).select(
            F.lit(0).alias("point"), F.col("v").alias("x"),
            F.lit(None).cast("double").alias("density"),
        )
    h = std * n ** (-0.2)
    start, step = low - 2 * h, (high - low + 4 * h) / (points - 1)
    # exp(-((x - g) / h)^2 / 2) is exp(-(x * unit - centre)^2).
    unit = math.sqrt(0.5) / h
    grid = [start + i * step for i in range(points)]
    away = [f"(v * {unit!r}D - {g * unit!r}D)" for g in grid]
    sums = rows.agg(*[F.expr(f"sum(exp(-{a} * {a}))").alias(f"s{i}") for i, a in enumerate(away)])
    scale = 1.0 / (n * h * math.sqrt(2 * math.pi))
    listed = ", ".join(f"s{i}" for i in range(points))
    return sums.select(F.posexplode(F.expr(f"array({listed})")).alias("point", "s")).select(
        "point",
        (F.lit(start) + F.col("point") * F.lit(step)).alias("x"),
        (F.col("s") * scale).alias("density"),
    )
