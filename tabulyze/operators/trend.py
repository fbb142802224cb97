"""Time series and trend measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabulyze.functions.columns import (
    CATEGORICAL, as_double, col, complete_rows, free_name, nan_to_null, quoted, role_of,
    tie_break,
)
from tabulyze.functions.moments import fit_line
from tabulyze.functions.facts import VALUE_LIMIT, Answer, Asked, answered
from tabulyze.functions.order_stats import GROUP_LIMIT, grouped_median
from tabulyze.functions.text import parse_timestamp, safe_divide
from tabulyze.operators.roles import require_columns

TOO_FEW = "Insufficient data for trend analysis"


def as_date(df: DataFrame, column: str) -> Column:
    """The column as a timestamp; text is parsed, failures become NULL."""
    dtype = df.schema[column].dataType
    if role_of(dtype) == CATEGORICAL:
        return parse_timestamp(col(column))
    if isinstance(dtype, T.DateType):
        return col(column).cast("timestamp_ntz")
    return col(column)


def time_series(
    df: DataFrame,
    date_column: str,
    value_column: str,
    aggregation: str = "sum",
    keys: Sequence[str] | None = None,
    median_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """A measure per exact timestamp, in time order.

    'none' and unknown names give the rows themselves, sorted by date and then key.
    """
    require_columns(df, [date_column, value_column])
    clean = nan_to_null(df)
    if aggregation not in ("sum", "mean", "count", "median"):
        dated = clean.withColumn(date_column, as_date(clean, date_column))
        ties = [col(k) for k in tie_break(df, keys, date_column)]
        return dated.filter(col(date_column).isNotNull()).orderBy(col(date_column), *ties)
    rows = clean.select(
        as_date(clean, date_column).alias(date_column), col(value_column).alias("__value")
    ).filter(col(date_column).isNotNull())
    if aggregation == "median":
        measured = grouped_median(rows, [date_column], "__value", value_column, median_limit)
    else:
        value = F.col("__value")
        measure = {
            "sum": F.coalesce(F.sum(value), F.lit(0)),
            "mean": F.avg(value.cast("double")),
            "count": F.count(value),
        }[aggregation]
        measured = rows.groupBy(col(date_column)).agg(measure.alias(value_column))
    return measured.orderBy(col(date_column))


def _direction(change: Column) -> Column:
    return F.when(change > 0, "increasing").when(change < 0, "decreasing").otherwise("stable")


def volatility_level(std: Column, mean: Column) -> Column:
    """By the ratio of deviation to mean; a negative mean therefore reads as low."""
    ratio = safe_divide(std, mean)
    return F.when(ratio < 0.1, "low").when(ratio < 0.3, "moderate").otherwise("high")


TREND = (
    "rows bigint, first_value double, last_value double, mean double, median double, "
    "std_deviation double, growth_rate double, first_ts timestamp_ntz, last_ts timestamp_ntz"
)


def trend_asked(
    clean: DataFrame, date_column: str, value_column: str, keys: Sequence[str] | None = None
) -> Asked:
    """What `trend` needs of a table without NaN."""
    ties = tie_break(clean, keys, date_column, value_column) if keys else []
    ts, v = as_date(clean, date_column), as_double(value_column)
    both = ts.isNotNull() & v.isNotNull()
    ts, v = F.when(both, ts), F.when(both, v)
    order = F.when(both, F.struct(
        ts.alias("ts"), *[col(k).alias(f"k{i}") for i, k in enumerate(ties)], v.alias("v")))
    first_date = clean.agg(F.min(ts)).scalar()
    day = F.timestamp_diff("DAY", first_date, ts).cast("double")
    return Asked({
        "rows": F.count(v), "first_value": F.min_by(v, order), "last_value": F.max_by(v, order),
        "mean": F.avg(v), "std_deviation": F.stddev_samp(v), "growth_rate": fit_line(day, v)[0],
        "first_ts": F.min(ts).cast("timestamp_ntz"), "last_ts": F.max(ts).cast("timestamp_ntz"),
    }, {"medians": (v, (0.5,))})


def trend(
    df: DataFrame,
    date_column: str,
    value_column: str,
    period: str = "overall",
    keys: Sequence[str] | None = None,
    limit: int = VALUE_LIMIT,
    facts: Answer | None = None,
) -> DataFrame:
    """One row of trend measures over rows that have both date and value.

    First and last value are those of the earliest and latest date, ties by key. The growth
    rate is the least-squares slope per whole day since the first date. `period` is echoed.
    `facts` answer `trend_asked` where they are known.
    """
    require_columns(df, [date_column, value_column])
    clean = nan_to_null(df)
    if facts is None:
        facts = answered(clean, trend_asked(clean, date_column, value_column, keys), limit=limit)[0]
    names = [part.split()[0] for part in TREND.split(", ")]
    found = facts | {"median": facts["medians"][0]}
    stats = df.sparkSession.createDataFrame([tuple(found[n] for n in names)], TREND)
    change = F.col("last_value") - F.col("first_value")
    enough = F.col("rows") >= 2
    shown = {
        "trend_direction": _direction(change),
        "first_value": F.col("first_value"),
        "last_value": F.col("last_value"),
        "absolute_change": change,
        "percentage_change": safe_divide(change, F.col("first_value")),
        "mean": F.col("mean"),
        "median": F.col("median"),
        "std_deviation": F.col("std_deviation"),
        "growth_rate": F.col("growth_rate"),
        "volatility": volatility_level(F.col("std_deviation"), F.col("mean")),
        "start_date": F.date_format("first_ts", "yyyy-MM-dd"),
        "end_date": F.date_format("last_ts", "yyyy-MM-dd"),
        "days": F.timestamp_diff("DAY", F.col("first_ts"), F.col("last_ts")),
    }
    return stats.select(
        F.lit(period).alias("period"),
        "rows",
        *[F.when(enough, c).alias(name) for name, c in shown.items()],
        F.when(~enough, F.lit(TOO_FEW)).alias("error"),
    )


def scatter_trendline(df: DataFrame, x_column: str, y_column: str) -> DataFrame:
    """Complete rows with the least-squares fit in `fitted`.

    The two coefficients are fitted by one job and enter the plan as literals.
    """
    require_columns(df, [x_column, y_column])
    names = list(dict.fromkeys([quoted(x_column), quoted(y_column)]))
    rows = complete_rows(nan_to_null(df.select(*names)))
    slope, intercept = rows.agg(*fit_line(as_double(x_column), as_double(y_column))).first()
    fitted = F.lit(intercept).cast("double") + F.lit(slope).cast("double") * as_double(x_column)
    return rows.withColumn(free_name("fitted", rows.columns), fitted)
