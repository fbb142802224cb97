"""Insights as rows, their sentences, and the registry that runs them by name.

Every insight is `DataFrame -> DataFrame` with columns `metric`, `value`, `text`. A metric
named `summary` carries the sentence, `error` the reason why there is nothing to report.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from tabulyze.functions.columns import (
    DATETIME, NUMERICAL, col, column_types, is_integral, nan_to_null, numeric_columns,
)
from tabulyze.functions.facts import Answer, answered
from tabulyze.functions.text import fmt_number, fmt_percentage
from tabulyze.operators.correlation import STRONG_LIMIT, correlation_pairs, with_strength
from tabulyze.operators.distribution import (
    categorical_distribution, common_values, distribution_asked, numeric_distribution,
)
from tabulyze.operators.outliers import (
    anomaly_summary, anomaly_values, spread_asked, spread_facts, spread_of,
)
from tabulyze.operators.ranking import listed_name, top_bottom
from tabulyze.operators.roles import is_numerical, require_columns
from tabulyze.operators.trend import trend, trend_asked

log = logging.getLogger(__name__)

Insight = Callable[..., DataFrame]
INSIGHT_SCHEMA = "metric string, value double, text string"
# Anomalies and frequent values listed.
ANOMALIES = 20
COMMON = 10

# The sentences the reference shows, with named gaps.
SENTENCES = {
    "top_grouped": (
        "Top performer in {column}: '{top_name}' with {high}. "
        "Bottom performer: '{bottom_name}' with {low}. "
        "Top {top_count} performers contribute {share} of total."
    ),
    "top_direct": "Highest value in {column}: {high}. Lowest value: {low}. Range: {range}",
    "trend": (
        "{column} shows a {direction} trend with {percent} {verb}. "
        "Absolute change: {change}. Volatility: {volatility}."
    ),
    "trend_short": "Not enough data points to analyze trends.",
    "anomaly": "Detected {count} anomalies ({percent}) in {column}. ",
    "anomaly_range": "Range of anomalies: {low} to {high}.",
    "anomaly_none": "No anomalies detected in {column} using {method} method.",
    "anomaly_short": "Not enough data points to detect anomalies.",
    "anomaly_text": "Cannot detect anomalies in non-numerical column {column}.",
    "distribution": (
        "{column} has a {shape} distribution. Mean: {mean}, Median: {median}, "
        "Std Dev: {std}. Range: {low} to {high}."
    ),
    "categories": (
        "{column} has {distinct} unique values. Most common: '{value}' ({percent})."
    ),
    "distribution_none": "No valid data in column {column}.",
    "correlation": (
        "Found {count} strong correlations. "
        "Strongest: {first} and {second} ({direction}, {r})."
    ),
    "correlation_none": "No strong correlations (threshold: {threshold}) found.",
    "correlation_short": "Need at least 2 numerical columns for correlation analysis.",
}
_GAP = re.compile(r"\{(\w+)\}")


def _sentence(name: str, **gaps: Column | str) -> Column:
    """The sentence with its gaps filled by texts or columns."""
    parts = []
    for i, piece in enumerate(_GAP.split(SENTENCES[name])):
        value = gaps[piece] if i % 2 else piece
        parts.append(value.cast("string") if isinstance(value, Column) else F.lit(str(value)))
    return F.concat(*parts)


def _entry(metric: Column, value: Column, text: Column | None = None) -> Column:
    return F.struct(
        metric.alias("metric"), value.cast("double").alias("value"),
        (F.lit(None) if text is None else text).cast("string").alias("text"),
    )


def _numbered(rows: DataFrame, name: str, value: str, text: str | None = None) -> DataFrame:
    """A list with a `rank` as rows `name_1`, `name_2`, ..."""
    metric = F.concat(F.lit(f"{name}_"), F.col("rank").cast("string"))
    entry = _entry(metric, F.col(value), F.col(text) if text else None)
    return rows.select(entry.alias("s")).select("s.*")


def _as_metrics(
    one: DataFrame, numbers: Sequence[str], texts: Sequence[str] = (),
    listed: Column | None = None,
) -> DataFrame:
    """A one-row frame as `metric`, `value`, `text` rows, then those of an array of entries."""
    rows = [
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"),
                 F.lit(None).cast("string").alias("text"))
        for m in numbers
    ]
    rows += [
        F.struct(F.lit(m).alias("metric"), F.lit(None).cast("double").alias("value"),
                 F.col(m).cast("string").alias("text"))
        for m in texts
    ]
    every = F.array(*rows)
    shown = one.select(F.inline(every if listed is None else F.concat(every, listed)))
    return shown.filter((F.col("metric") != "error") | F.col("text").isNotNull())


def _whole(df: DataFrame, column: str) -> bool:
    return is_integral(df.schema[column].dataType)


def _shown(value: Column, whole: bool) -> Column:
    return fmt_number(value.cast("bigint") if whole else value)


def top_bottom_insight(
    df: DataFrame,
    column: str,
    group_by: str | None = None,
    top_n: int = 5,
    bottom_n: int = 5,
    aggregation: str = "sum",
    keys: Sequence[str] | None = None,
) -> DataFrame:
    listed = top_bottom(df, column, group_by, top_n, bottom_n, aggregation, keys)
    name = (
        col(listed_name(group_by)).cast("string") if group_by else F.lit(None).cast("string")
    )

    def first(side: str, c: Column) -> Column:
        return F.max(F.when((F.col("side") == side) & (F.col("rank") == 1), c))

    def of(side: str, name: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col(name)))

    one = listed.agg(
        of("top", "side_count").alias("top_count"),
        of("top", "side_total").alias("top_total"),
        of("top", "contribution").alias("top_contribution"),
        of("bottom", "side_count").alias("bottom_count"),
        of("bottom", "side_total").alias("bottom_total"),
        of("bottom", "contribution").alias("bottom_contribution"),
        first("top", name).alias("top_name"),
        first("bottom", name).alias("bottom_name"),
        first("top", F.col("value")).alias("top_value"),
        first("bottom", F.col("value")).alias("bottom_value"),
        # As many entries as were asked for.
        F.collect_list(_entry(
            F.concat("side", F.lit("_"), F.col("rank").cast("string")), F.col("value"), name,
        )).alias("entries"),
    )
    counted = group_by is not None and aggregation == "count"
    exact = group_by is None or aggregation not in ("mean", "median")
    whole = counted or (exact and _whole(df, column))
    high, low = F.col("top_value"), F.col("bottom_value")
    if group_by:
        summary = _sentence(
            "top_grouped", column=column,
            top_name=F.coalesce("top_name", F.lit("N/A")), high=_shown(high, whole),
            bottom_name=F.coalesce("bottom_name", F.lit("N/A")), low=_shown(low, whole),
            top_count=F.col("top_count"), share=fmt_percentage(F.col("top_contribution")),
        )
    else:
        summary = _sentence(
            "top_direct", column=column, high=_shown(high, whole), low=_shown(low, whole),
            range=_shown(high - low, whole),
        )
    numbers = (
        "top_count", "top_total", "top_contribution",
        "bottom_count", "bottom_total", "bottom_contribution", "top_value", "bottom_value",
    )
    texts = ("top_name", "bottom_name", "summary") if group_by else ("summary",)
    return _as_metrics(one.withColumn("summary", summary), numbers, texts, F.col("entries"))


def trend_insight(
    df: DataFrame,
    date_column: str,
    value_column: str,
    period: str = "overall",
    keys: Sequence[str] | None = None,
    facts: Answer | None = None,
) -> DataFrame:
    """Measures of the trend. `facts` answer `trend_asked` where they are known."""
    one = trend(df, date_column, value_column, period, keys, facts=facts)
    change = F.col("absolute_change")
    sentence = _sentence(
        "trend", column=value_column, direction=F.col("trend_direction"),
        percent=fmt_percentage(F.abs("percentage_change")),
        verb=F.when(change > 0, "increase").otherwise("decrease"),
        change=_shown(change, _whole(df, value_column)), volatility=F.col("volatility"),
    )
    few = _sentence("trend_short")
    one = one.withColumn("summary", F.when(F.col("error").isNull(), sentence).otherwise(few))
    numbers = (
        "first_value", "last_value", "absolute_change", "percentage_change", "mean", "median",
        "std_deviation", "growth_rate", "days",
    )
    texts = (
        "period", "trend_direction", "volatility", "start_date", "end_date", "summary", "error",
    )
    return _as_metrics(one, numbers, texts)


def anomaly_insight(
    df: DataFrame, column: str, method: str = "zscore", threshold: float = 3.0,
    facts: Answer | None = None,
) -> DataFrame:
    """Counts, and the anomalies farthest from the mean. `facts` answer `spread_asked`."""
    require_columns(df, column)
    if is_numerical(df, column):
        facts = spread_of(facts) if facts else spread_facts(df, column)
    one = anomaly_summary(df, column, method, threshold, facts=facts)
    low, high = F.col("min_anomaly"), F.col("max_anomaly")
    whole = is_numerical(df, column) and _whole(df, column)
    # The range is told only when neither end is 0, as the reference does.
    told = low.isNotNull() & (low != 0) & (high != 0)
    span = _sentence("anomaly_range", low=_shown(low, whole), high=_shown(high, whole))
    found = F.concat(
        _sentence("anomaly", count=F.col("anomaly_count"), column=column,
                  percent=fmt_percentage(F.col("anomaly_share"))),
        F.when(told, span).otherwise(F.lit("")),
    )
    failed = F.when(
        F.col("error") == "Insufficient data", _sentence("anomaly_short")
    ).otherwise(_sentence("anomaly_text", column=column))
    summary = (
        F.when(F.col("error").isNotNull(), failed)
        .when(F.col("anomaly_count") == 0,
              _sentence("anomaly_none", column=column, method=method))
        .otherwise(found)
    )
    numbers = (
        "total_points", "anomaly_count", "anomaly_share", "mean", "median", "std", "min", "max",
        "min_anomaly", "max_anomaly",
    )
    told = _as_metrics(one.withColumn("summary", summary), numbers, ("summary", "error"))
    if not is_numerical(df, column):
        return told
    # Below three values there is nothing to judge and no value lies far enough off.
    values = anomaly_values(df, column, method, threshold, ANOMALIES, facts=facts)
    return told.unionByName(_numbered(values, "anomaly", "value"))


def distribution_insight(
    df: DataFrame, column: str, facts: Answer | None = None
) -> DataFrame:
    """Moments and shape, or value counts with the most frequent values.

    `facts` answer `distribution_asked` where they are known.
    """
    require_columns(df, column)
    common = None
    failed = _sentence("distribution_none", column=column)
    if not is_numerical(df, column):
        one = categorical_distribution(df, column)
        told = _sentence(
            "categories", column=column, distinct=F.col("unique_values"),
            value=F.col("most_common"), percent=fmt_percentage(F.col("most_common_share")),
        )
        numbers = ("count", "unique_values", "most_common_count", "most_common_share",
                   "least_common_count")
        texts = ("most_common", "least_common")
        common = _numbered(common_values(df, column, COMMON), "common", "n", "value")
    else:
        one = numeric_distribution(df, column, facts=facts)
        whole = _whole(df, column)
        told = _sentence(
            "distribution", column=column, shape=F.col("shape"), mean=fmt_number(F.col("mean")),
            median=fmt_number(F.col("median")), std=fmt_number(F.col("std")),
            low=_shown(F.col("min"), whole), high=_shown(F.col("max"), whole),
        )
        numbers = ("count", "mean", "median", "mode", "std", "min", "max", "range", "q1", "q3",
                   "iqr", "skewness", "kurtosis")
        texts = ("shape",)
    summary = F.when(F.col("error").isNull(), told).otherwise(failed)
    told = _as_metrics(one.withColumn("summary", summary), numbers, (*texts, "summary", "error"))
    return told if common is None else told.unionByName(common)


def correlation_insight(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    threshold: float = 0.7,
    method: str = "pearson",
) -> DataFrame:
    names = numeric_columns(df, columns or None)
    if columns:
        require_columns(df, columns)
    if len(names) < 2:
        return df.sparkSession.createDataFrame(
            [
                ("summary", None, SENTENCES["correlation_short"]),
                ("error", None, "Insufficient numerical columns"),
            ],
            INSIGHT_SCHEMA,
        )
    pairs = with_strength(correlation_pairs(df, columns, method))
    strong = F.abs("r") >= threshold
    ranked = F.struct(-F.abs("r"), "variable1", "variable2", "r", "direction", "strength")
    one = pairs.agg(
        F.count("*").alias("pairs_analyzed"),
        F.count_if(strong).alias("strong_found"),
        F.min(F.when(strong, ranked)).alias("s"),
        # The pairs of a schema, few thousand at most.
        F.slice(F.sort_array(F.collect_list(F.when(strong, ranked))), 1, STRONG_LIMIT).alias("l"),
    ).select(
        F.transform("l", lambda s, i: _entry(
            F.concat(F.lit("pair_"), (i + 1).cast("string")), s["r"],
            F.concat_ws(", ", s["variable1"], s["variable2"]),
        )).alias("entries"),
        "pairs_analyzed", "strong_found", F.col("s.r").alias("strongest"),
        F.col("s.variable1").alias("variable1"), F.col("s.variable2").alias("variable2"),
        F.col("s.direction").alias("direction"), F.col("s.strength").alias("strength"),
    )
    told = _sentence(
        "correlation", count=F.col("strong_found"), first=F.col("variable1"),
        second=F.col("variable2"), direction=F.col("direction"),
        r=fmt_number(F.col("strongest")),
    )
    none = _sentence("correlation_none", threshold=str(threshold))
    one = one.withColumn("summary", F.when(F.col("strong_found") > 0, told).otherwise(none))
    return _as_metrics(
        one, ("pairs_analyzed", "strong_found", "strongest"),
        ("variable1", "variable2", "direction", "strength", "summary"), F.col("entries"),
    )


class InsightRegistry:
    """Insights by name, in the order in which they were registered."""

    def __init__(self) -> None:
        self.insights: dict[str, Insight] = {
            "top_bottom": top_bottom_insight,
            "trend": trend_insight,
            "anomaly": anomaly_insight,
            "distribution": distribution_insight,
            "correlation": correlation_insight,
        }

    def register(self, name: str, insight: Insight) -> None:
        self.insights[name] = insight

    def available(self) -> list[str]:
        return list(self.insights)

    def generate(self, name: str, df: DataFrame, **options) -> DataFrame:
        if name not in self.insights:
            raise ValueError(
                f"Unsupported insight type: {name}. Available types: {self.available()}"
            )
        return self.insights[name](df, **options)

    def generate_all(
        self, df: DataFrame, config: dict[str, dict] | None = None
    ) -> DataFrame:
        """All insights that the column roles allow: `insight`, `metric`, `value`, `text`.

        The first numeric column is ranked, described and searched for anomalies; with two
        numeric columns come correlations, with a date the trend. One that the table's columns do
        not allow is left out; a failure while Spark runs is raised.
        """
        roles = column_types(df)
        numeric, dates = roles[NUMERICAL], roles[DATETIME]
        asked: list[tuple[str, dict]] = []
        if numeric:
            asked += [(n, {"column": numeric[0]}) for n in ("top_bottom", "distribution", "anomaly")]
        if len(numeric) >= 2:
            asked.append(("correlation", {}))
        if dates and numeric:
            asked.append(("trend", {"date_column": dates[0], "value_column": numeric[0]}))
        asked = [(name, {**options, **(config or {}).get(name, {})}) for name, options in asked]
        parts, facts = [], self._facts(df, asked)
        for name, options in asked:
            try:
                part = self.generate(name, df, **options, **facts.get(name, {}))
                parts.append(part.select(F.lit(name).alias("insight"), "metric", "value", "text"))
            except (ValueError, TypeError, AnalysisException) as error:
                log.warning("Could not generate %s insight: %s", name, error)
        if not parts:
            return df.sparkSession.createDataFrame([], "insight string, " + INSIGHT_SCHEMA)
        return reduce(DataFrame.unionByName, parts)

    def _facts(self, df: DataFrame, asked: Sequence[tuple[str, dict]]) -> dict[str, dict]:
        """What the package's own insights need to know of the table, found together.

        Those whose options do not fit the table are left to fail by themselves.
        """
        clean, needs = nan_to_null(df), {}
        for name, options in asked:
            insight, column = self.insights[name], options.get("column")
            if insight is trend_insight:
                columns = [options["date_column"], options["value_column"]]
                if set(columns) | set(options.get("keys") or ()) <= set(df.columns):
                    needs[name] = trend_asked(clean, *columns, options.get("keys"))
            elif column in numeric_columns(df):
                if insight is distribution_insight:
                    needs[name] = distribution_asked(column)
                elif insight is anomaly_insight:
                    needs[name] = spread_asked(column)
        found = answered(clean, *needs.values())
        return {name: {"facts": answer} for name, answer in zip(needs, found)}

    def summaries(self, df: DataFrame, config: dict[str, dict] | None = None) -> DataFrame:
        """One sentence per insight: `insight`, `summary`."""
        every = self.generate_all(df, config)
        return every.filter(F.col("metric") == "summary").select(
            "insight", F.col("text").alias("summary")
        )


insights = InsightRegistry()

__all__ = [
    "InsightRegistry", "anomaly_insight", "correlation_insight",
    "distribution_insight", "insights", "top_bottom_insight", "trend_insight",
]
