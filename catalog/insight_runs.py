"""Insights, recommendations and the registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.distributions import SHAPE
from catalog.registry import query, rounded, table
from tabulyze.plans.insights import InsightRegistry, insights
from tabulyze.plans.views import ViewRegistry, recommend_views as recommend
from tabulyze.operators.ranking import value_counts


def measured_events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("value", "user_id", "ts", "event_type")


INSIGHTS = f"""
with e as (select value, user_id, ts, event_type from events),
top as (select value from e order by value desc limit 5),
low as (select value from e order by value limit 5),
b as (select (select count(*) from top) as tn, (select sum(value) from top) as tt,
             (select max(value) from top) as hi, (select count(*) from low) as bn,
             (select sum(value) from low) as bt, (select min(value) from low) as lo,
             (select sum(value) from e) as total),
d as (select count(value) as n, avg(value) as mean, quantile_cont(value, 0.5) as median,
             (select value from e group by value order by count(*) desc, value limit 1) as mode,
             stddev_samp(value) as std, min(value) as min, max(value) as max,
             quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3,
             skewness(value) as s, kurtosis(value) as k from e),
a as (select count(*) as c, min(value) as lo, max(value) as hi from e, d
      where abs((value - mean) / std) > 3),
c as (select corr(value, user_id) as r from e),
t as (select *, last - first as change from (
      select arg_min(value, {{'ts': ts, 'v': value}}) as first,
             arg_max(value, {{'ts': ts, 'v': value}}) as last,
             min(ts) as ts0, max(ts) as ts1,
             regr_slope(value, date_sub('day', (select min(ts) from e), ts)) as slope from e))
"""

_M = "select '{i}' as insight, '{m}' as metric, round(({x})::double, 4) as value, null as text from {f}"
_T = "select '{i}' as insight, '{m}' as metric, null::double as value, ({x})::varchar as text from {f}"


def _metrics(insight: str, source: str, numbers: dict[str, str], texts: dict[str, str]) -> str:
    rows = [_M.format(i=insight, m=m, x=x, f=source) for m, x in numbers.items()]
    rows += [_T.format(i=insight, m=m, x=x, f=source) for m, x in texts.items()]
    return " union all ".join(rows)


def _n(x: str) -> str:
    return f"format('{{:,.2f}}', {x})"


def _p(x: str) -> str:
    return f"printf('%.2f%%', ({x}) * 100)"


_TOP_SUMMARY = f"""'Highest value in value: ' || {_n('hi')} || '. Lowest value: ' || {_n('lo')}
 || '. Range: ' || {_n('hi - lo')}"""
_DIST_SUMMARY = f"""'value has a ' || {SHAPE.format(s='s', k='k')} || ' distribution. Mean: '
 || {_n('mean')} || ', Median: ' || {_n('median')} || ', Std Dev: ' || {_n('std')}
 || '. Range: ' || {_n('min')} || ' to ' || {_n('max')} || '.'"""
_ANOMALY_SUMMARY = f"""case when c = 0 then 'No anomalies detected in value using zscore method.'
 else 'Detected ' || c || ' anomalies (' || {_p('c / n')} || ') in value. Range of anomalies: '
 || {_n('lo')} || ' to ' || {_n('hi')} || '.' end"""
_CORR_SUMMARY = "'No strong correlations (threshold: 0.7) found.'"
_VOLATILITY = "case when std / mean < 0.1 then 'low' when std / mean < 0.3 then 'moderate' else 'high' end"
_DIRECTION = "case when change > 0 then 'increasing' when change < 0 then 'decreasing' else 'stable' end"
_TREND_SUMMARY = f"""'value shows a ' || {_DIRECTION} || ' trend with ' || {_p('abs(change / first)')}
 || case when change > 0 then ' increase' else ' decrease' end || '. Absolute change: '
 || {_n('change')} || '. Volatility: ' || {_VOLATILITY} || '.'"""

INSIGHT_ROWS = " union all ".join([
    _metrics("top_bottom", "b", {
        "top_count": "tn", "top_total": "tt", "top_contribution": "tt / total",
        "bottom_count": "bn", "bottom_total": "bt", "bottom_contribution": "bt / total",
        "top_value": "hi", "bottom_value": "lo",
    }, {"summary": _TOP_SUMMARY}),
    _metrics("distribution", "d", {
        "count": "n", "mean": "mean", "median": "median", "mode": "mode", "std": "std",
        "min": "min", "max": "max", "range": "max - min", "q1": "q1", "q3": "q3",
        "iqr": "q3 - q1", "skewness": "s", "kurtosis": "k",
    }, {"shape": SHAPE.format(s="s", k="k"), "summary": _DIST_SUMMARY}),
    _metrics("anomaly", "a, d", {
        "total_points": "n", "anomaly_count": "c", "anomaly_share": "c / n", "mean": "mean",
        "median": "median", "std": "std", "min": "min", "max": "max", "min_anomaly": "lo",
        "max_anomaly": "hi",
    }, {"summary": _ANOMALY_SUMMARY}),
    *[f"""
select 'top_bottom' as insight, '{side}_' || row_number() over (order by {order}) as metric,
       round(value::double, 4) as value, null as text from {source}"""
      for side, order, source in (("top", "value desc", "top"), ("bottom", "value", "low"))],
    """
select 'anomaly' as insight, 'anomaly_' || place as metric, round(value::double, 4) as value,
       null as text
from (select value, row_number() over (order by abs((value - mean) / std) desc, value) as place
      from e, d where abs((value - mean) / std) > 3) where place <= 20""",
    _metrics("correlation", "c", {
        "pairs_analyzed": "1", "strong_found": "case when abs(r) >= 0.7 then 1 else 0 end",
        "strongest": "null",
    }, {"variable1": "null", "variable2": "null", "direction": "null", "strength": "null",
        "summary": _CORR_SUMMARY}),
    _metrics("trend", "t, d", {
        "first_value": "first", "last_value": "last", "absolute_change": "change",
        "percentage_change": "change / first", "mean": "mean", "median": "median",
        "std_deviation": "std", "growth_rate": "slope", "days": "date_sub('day', ts0, ts1)",
    }, {
        "period": "'overall'", "trend_direction": _DIRECTION, "volatility": _VOLATILITY,
        "start_date": "strftime(ts0, '%Y-%m-%d')", "end_date": "strftime(ts1, '%Y-%m-%d')",
        "summary": _TREND_SUMMARY,
    }),
])


@query("insights_all", INSIGHTS + INSIGHT_ROWS)
def insights_all(spark, sf_dir):
    return rounded(insights.generate_all(measured_events(spark, sf_dir)), 4, "value")


@query("insight_summaries",
       INSIGHTS + f"select insight, text as summary from ({INSIGHT_ROWS}) where metric = 'summary'")
def insight_summaries(spark, sf_dir):
    return insights.summaries(measured_events(spark, sf_dir))


@query("insight_grouped", f"""
with g as (select l_returnflag as k, sum(l_extendedprice) as v from lineitem group by 1),
top as (select * from g order by v desc, k limit 5), low as (select * from g order by v, k limit 5)
select 'Top performer in l_extendedprice: ''' || (select k from top order by v desc, k limit 1)
  || ''' with ' || {_n('(select max(v) from top)')} || '. Bottom performer: '''
  || (select k from low order by v, k limit 1) || ''' with ' || {_n('(select min(v) from low)')}
  || '. Top ' || (select count(*) from top) || ' performers contribute '
  || {_p('(select sum(v) from top) / (select sum(v) from g)')} || ' of total.' as summary""")
def insight_grouped(spark, sf_dir):
    found = insights.generate(
        "top_bottom", table(spark, sf_dir, "lineitem"),
        column="l_extendedprice", group_by="l_returnflag",
    )
    return found.filter("metric = 'summary'").select(F.col("text").alias("summary"))


@query("insight_categorical", f"""
with c as (select event_type as v, count(*) as n from events group by 1)
select 'event_type has ' || (select count(*) from c) || ' unique values. Most common: '''
  || (select v from c order by n desc, v limit 1) || ''' ('
  || {_p('(select max(n) from c) / (select sum(n) from c)')} || ').' as summary""")
def insight_categorical(spark, sf_dir):
    found = insights.generate("distribution", table(spark, sf_dir, "events"), column="event_type")
    return found.filter("metric = 'summary'").select(F.col("text").alias("summary"))


def _view(rank: int, kind: str, priority: str, reason: str, params: str) -> str:
    return (f"select {rank}::int as rank, '{kind}' as type, '{priority}' as priority, "
            f"{reason} as reason, '{params}' as params")


@query("recommend_views", " union all ".join([
    _view(1, "time_series", "high",
          "'Detected date and numerical columns - perfect for trend analysis'",
          "aggregation=sum,date_column=l_shipdate,value_column=l_orderkey"),
    _view(2, "correlation", "high",
          "'Found 8 numerical columns - great for correlation analysis'", ""),
    _view(3, "category", "high",
          "'Found categorical column \"l_returnflag\" with ' || "
          "(select count(distinct l_returnflag) from lineitem) || ' categories'",
          "column=l_returnflag,plot_type=bar"),
    _view(4, "distribution", "medium",
          "'Numerical data available - useful for understanding value distribution'",
          "column=l_orderkey,plot_type=histogram"),
    _view(5, "scatter", "medium",
          "'Multiple numerical columns - explore relationships between variables'",
          "x_column=l_orderkey,y_column=l_partkey"),
]))
def recommend_views(spark, sf_dir):
    found = recommend(table(spark, sf_dir, "lineitem"))
    pairs = F.transform(
        F.array_sort(F.map_entries("params")),
        lambda e: F.concat(e.getField("key"), F.lit("="), e.getField("value")),
    )
    return found.withColumn("params", F.array_join(pairs, ","))


def _gaps(df, column):
    """A user's own insight: how many values are missing."""
    one = df.agg(F.count_if(F.col(column).isNull()).cast("double").alias("value"))
    return one.select(
        F.lit("missing").alias("metric"), "value", F.lit(None).cast("string").alias("text")
    )


@query("register_insight", """
select 'missing' as metric, (count(*) - count(user_id))::double as value, null::varchar as text
from events""")
def register_insight(spark, sf_dir):
    registry = InsightRegistry()
    registry.register("gaps", _gaps)
    return registry.generate("gaps", table(spark, sf_dir, "events"), column="user_id")


@query("register_view", "select p_brand, count(*) as n from part group by p_brand")
def register_view(spark, sf_dir):
    registry = ViewRegistry()
    registry.register("counts", value_counts, ["column"])
    return registry.create("counts", table(spark, sf_dir, "part"), column="p_brand")


@query("view_by_name", """
select o_orderstatus, count(*) as value,
       round(count(*) / (select count(*) from orders) * 100, 1) as share
from orders group by o_orderstatus""")
def view_by_name(spark, sf_dir):
    return ViewRegistry().create(
        "category", table(spark, sf_dir, "orders"), column="o_orderstatus", plot_type="pie"
    )
