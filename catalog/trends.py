"""Time series and trend queries."""

from __future__ import annotations

from catalog.registry import GAPPY_ORDERS, gappy_orders, query, rounded, table
from tabulyze.operators import trend


def _series(aggregation: str, sql: str):
    @query(f"time_series_{aggregation}", f"""
select o_orderdate, round({sql}, 6) as o_totalprice from orders
where o_orderdate is not null group by o_orderdate""")
    def run(spark, sf_dir):
        orders = table(spark, sf_dir, "orders")
        series = trend.time_series(orders, "o_orderdate", "o_totalprice", aggregation)
        return rounded(series, 6, "o_totalprice")


_series("sum", "coalesce(sum(o_totalprice), 0)")
_series("mean", "avg(o_totalprice)")
_series("count", "count(o_totalprice)")
_series("median", "quantile_cont(o_totalprice, 0.5)")


@query("time_series_raw", "select o_orderkey, o_orderdate, o_totalprice from orders")
def time_series_raw(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return trend.time_series(orders, "o_orderdate", "o_totalprice", "none", ["o_orderkey"])


TREND = """
with r as (select ts, value as v, event_id as k from events
           where ts is not null and value is not null),
s as (
  select count(*) as rows, arg_min(v, {'ts': ts, 'k': k}) as first_value,
         arg_max(v, {'ts': ts, 'k': k}) as last_value, avg(v) as mean,
         quantile_cont(v, 0.5) as median, stddev_samp(v) as std_deviation,
         min(ts) as first_ts, max(ts) as last_ts,
         regr_slope(v, date_sub('day', (select min(ts) from r), ts)) as growth_rate
  from r),
t as (select *, last_value - first_value as change from s)
"""


def _trend(spark, sf_dir):
    return trend.trend(table(spark, sf_dir, "events"), "ts", "value", "monthly", ["event_id"])


@query("trend_metrics", TREND + """
select 'monthly' as period, rows, first_value, last_value, round(change, 4) as absolute_change,
       round(case when first_value = 0 then 0 else change / first_value end, 6)
         as percentage_change,
       round(mean, 4) as mean, round(median, 4) as median,
       round(std_deviation, 4) as std_deviation
from t""")
def trend_metrics(spark, sf_dir):
    found = _trend(spark, sf_dir).select(
        "period", "rows", "first_value", "last_value", "absolute_change", "percentage_change",
        "mean", "median", "std_deviation",
    )
    return rounded(
        rounded(found, 4, "absolute_change", "mean", "median", "std_deviation"),
        6, "percentage_change",
    )


@query("trend_direction", TREND + """
select case when change > 0 then 'increasing' when change < 0 then 'decreasing'
            else 'stable' end as trend_direction from t""")
def trend_direction(spark, sf_dir):
    return _trend(spark, sf_dir).select("trend_direction")


@query("trend_growth_rate", TREND + "select round(growth_rate, 6) as growth_rate from t")
def trend_growth_rate(spark, sf_dir):
    return rounded(_trend(spark, sf_dir).select("growth_rate"), 6, "growth_rate")


@query("trend_volatility", TREND + """
select case when std_deviation / mean < 0.1 then 'low'
            when std_deviation / mean < 0.3 then 'moderate' else 'high' end as volatility
from t""")
def trend_volatility(spark, sf_dir):
    return _trend(spark, sf_dir).select("volatility")


@query("trend_date_range", TREND + """
select strftime(first_ts, '%Y-%m-%d') as start_date, strftime(last_ts, '%Y-%m-%d') as end_date,
       date_sub('day', first_ts, last_ts) as days from t""")
def trend_date_range(spark, sf_dir):
    return _trend(spark, sf_dir).select("start_date", "end_date", "days")


@query("scatter_trendline", f"""
with t as (select o_custkey, o_totalprice from ({GAPPY_ORDERS})
           where o_custkey is not null and o_totalprice is not null),
f as (select regr_slope(o_totalprice, o_custkey) as b,
             regr_intercept(o_totalprice, o_custkey) as a from t)
select o_custkey, o_totalprice, round(a + b * o_custkey, 4) as fitted from t, f""")
def scatter_trendline(spark, sf_dir):
    line = trend.scatter_trendline(gappy_orders(spark, sf_dir), "o_custkey", "o_totalprice")
    return rounded(line, 4, "fitted")
