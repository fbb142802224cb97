"""Distribution, anomaly and scatter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import GAPPY_ORDERS, gappy_orders, query, rounded, table
from tabulyze.functions.moments import kurtosis_adjusted, skewness_adjusted
from tabulyze.operators import distribution, outliers, scatter

SHAPE = """
case when abs({s}) < 0.5 and abs({k}) < 0.5 then 'approximately normal'
     when {s} > 0.5 then 'right-skewed (positive skew)'
     when {s} < -0.5 then 'left-skewed (negative skew)'
     when {k} > 1 then 'heavy-tailed (leptokurtic)'
     when {k} < -1 then 'light-tailed (platykurtic)'
     else 'mixed characteristics' end"""

NUMERIC_DISTRIBUTION = f"""
select count(value) as count, round(avg(value), 4) as mean,
       round(quantile_cont(value, 0.5), 4) as median,
       (select value from events where value is not null
        group by value order by count(*) desc, value limit 1) as mode,
       round(stddev_samp(value), 4) as std, min(value) as min, max(value) as max,
       round(max(value) - min(value), 4) as range,
       round(quantile_cont(value, 0.25), 4) as q1, round(quantile_cont(value, 0.75), 4) as q3,
       round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 4) as iqr,
       round(skewness(value), 4) as skewness, round(kurtosis(value), 4) as kurtosis,
       {SHAPE.format(s='skewness(value)', k='kurtosis(value)')} as shape
from events"""


@query("distribution_numeric", NUMERIC_DISTRIBUTION)
def distribution_numeric(spark, sf_dir):
    one = distribution.numeric_distribution(table(spark, sf_dir, "events"), "value").drop("error")
    return rounded(one, 4, "mean", "median", "std", "range", "q1", "q3", "iqr", "skewness",
                   "kurtosis")


@query("skewness_adjusted", """
select l_returnflag, round(skewness(l_extendedprice), 6) as skewness from lineitem
group by l_returnflag""")
def skewness_by_flag(spark, sf_dir):
    skew = skewness_adjusted(F.col("l_extendedprice"))
    by_flag = table(spark, sf_dir, "lineitem").groupBy("l_returnflag")
    return by_flag.agg(F.round(skew, 6).alias("skewness"))


@query("kurtosis_adjusted", """
select l_returnflag, round(kurtosis(l_extendedprice), 6) as kurtosis from lineitem
group by l_returnflag""")
def kurtosis_by_flag(spark, sf_dir):
    kurt = kurtosis_adjusted(F.col("l_extendedprice"))
    by_flag = table(spark, sf_dir, "lineitem").groupBy("l_returnflag")
    return by_flag.agg(F.round(kurt, 6).alias("kurtosis"))


@query("distribution_shape", f"""
select event_type, {SHAPE.format(s='skewness(value)', k='kurtosis(value)')} as shape
from events group by event_type""")
def distribution_shape(spark, sf_dir):
    moments = table(spark, sf_dir, "events").groupBy("event_type").agg(
        skewness_adjusted(F.col("value")).alias("s"), kurtosis_adjusted(F.col("value")).alias("k")
    )
    return moments.select(
        "event_type", distribution.shape_label(F.col("s"), F.col("k")).alias("shape")
    )


@query("distribution_categorical", f"""
with c as (select o_orderstatus as value, count(*) as n from ({GAPPY_ORDERS})
           where o_orderstatus is not null group by o_orderstatus)
select (select sum(n) from c)::bigint as count, (select count(*) from c) as unique_values,
       (select value from c order by n desc, value limit 1) as most_common,
       (select max(n) from c) as most_common_count,
       round((select max(n) from c) / (select sum(n) from c), 6) as most_common_share,
       (select value from c order by n, value limit 1) as least_common,
       (select min(n) from c) as least_common_count""")
def distribution_categorical(spark, sf_dir):
    one = distribution.categorical_distribution(gappy_orders(spark, sf_dir), "o_orderstatus")
    return rounded(one.drop("error"), 6, "most_common_share")


@query("distribution_categorical_top", """
select (row_number() over (order by count(*) desc, p_type))::int as rank, p_type as value,
       count(*) as n
from part group by p_type order by n desc, value limit 10""")
def distribution_categorical_top(spark, sf_dir):
    return distribution.common_values(table(spark, sf_dir, "part"), "p_type")


def _histogram(column: str, source: str, bins: int) -> str:
    return f"""
with e as (select min({column}) as lo, max({column}) as hi from {source}),
b as (select i::int as bin, lo + i * ((hi - lo) / {bins}) as low,
             case when i = {bins - 1} then hi else lo + (i + 1) * ((hi - lo) / {bins}) end as high
      from e, range({bins}) r(i)),
n as (select bin, count(*) as n from {source}, b
      where {column} >= low and ({column} < high or bin = {bins - 1}) group by bin)
select bin, round(low, 6) as low, round(high, 6) as high, coalesce(n, 0) as n
from b left join n using (bin)"""


@query("histogram", _histogram("value", "events", 30))
def histogram(spark, sf_dir):
    bars = distribution.histogram(table(spark, sf_dir, "events"), "value")
    return rounded(bars, 6, "low", "high")


@query("histogram_prices", _histogram("l_extendedprice", "lineitem", 50))
def histogram_prices(spark, sf_dir):
    bars = distribution.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice", 50)
    return rounded(bars, 6, "low", "high")


BOX = """
with q as (select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as q2,
                  quantile_cont(value, 0.75) as q3 from events),
f as (select *, q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from q)
"""


@query("box_stats", BOX + """
select round(any_value(q1), 4) as q1, round(any_value(q2), 4) as median,
       round(any_value(q3), 4) as q3,
       min(case when value >= lo then value end) as whisker_low,
       max(case when value <= hi then value end) as whisker_high,
       count(case when value < lo or value > hi then 1 end) as outliers, count(*) as n
from events, f where value is not null""")
def box_stats(spark, sf_dir):
    one = distribution.box_stats(table(spark, sf_dir, "events"), "value")
    return rounded(one, 4, "q1", "median", "q3")


@query("box_outliers", BOX + """
select value as v, count(*) as n from events, f where value < lo or value > hi group by value""")
def box_outliers(spark, sf_dir):
    return distribution.box_outliers(table(spark, sf_dir, "events"), "value")


@query("density_curve", """
with s as (select count(value) as n, stddev_samp(value) as d, min(value) as lo, max(value) as hi
           from events),
h as (select *, d * pow(n, -0.2) as h from s),
g as (select i::int as point, lo - 2 * h + i * ((hi - lo + 4 * h) / 99) as x, n, h
      from h, range(100) r(i))
select point, round(any_value(x), 6) as x,
       round(sum(exp(-0.5 * pow((value - x) / h, 2))) / any_value(n * h * sqrt(2 * pi())), 8)
         as density
from events, g group by point""")
def density_curve(spark, sf_dir):
    curve = distribution.density_curve(table(spark, sf_dir, "events"), "value")
    return rounded(rounded(curve, 6, "x"), 8, "density")


ZSCORE = """
with s as (select avg(value) as m, stddev_samp(value) as d from events),
z as (select e.*, abs((value - m) / d) as z from events e, s where value is not null)
"""
FENCES = """
with q as (select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3,
                  avg(value) as m, stddev_samp(value) as d from events),
z as (select e.*, abs((value - m) / d) as z,
             value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1) as hit
      from events e, q where value is not null)
"""
_COLUMNS = "event_id, ts, user_id, event_type, value, props, round(z, 6) as z"


@query("anomaly_zscore", ZSCORE + f"select {_COLUMNS} from z where z > 2")
def anomaly_zscore(spark, sf_dir):
    found = outliers.anomalies(table(spark, sf_dir, "events"), "value", "zscore", 2.0)
    return rounded(found, 6, "z")


@query("anomaly_iqr", FENCES + f"select {_COLUMNS} from z where hit")
def anomaly_iqr(spark, sf_dir):
    found = outliers.anomalies(table(spark, sf_dir, "events"), "value", "iqr", 1.5)
    return rounded(found, 6, "z")


_SUMMARY = """
select count(*) as total_points, count(case when {hit} then 1 end) as anomaly_count,
       round(count(case when {hit} then 1 end) / count(*), 6) as anomaly_share,
       round(avg(value), 4) as mean, round(quantile_cont(value, 0.5), 4) as median,
       round(stddev_samp(value), 4) as std, min(value) as min, max(value) as max,
       min(case when {hit} then value end) as min_anomaly,
       max(case when {hit} then value end) as max_anomaly
from z"""


def _summary(spark, sf_dir, method, threshold):
    one = outliers.anomaly_summary(table(spark, sf_dir, "events"), "value", method, threshold)
    return rounded(rounded(one.drop("error"), 4, "mean", "median", "std"), 6, "anomaly_share")


@query("anomaly_summary", ZSCORE + _SUMMARY.format(hit="z > 3"))
def anomaly_summary(spark, sf_dir):
    return _summary(spark, sf_dir, "zscore", 3.0)


@query("anomaly_summary_iqr", FENCES + _SUMMARY.format(hit="hit"))
def anomaly_summary_iqr(spark, sf_dir):
    return _summary(spark, sf_dir, "iqr", 1.5)


@query("anomaly_sample", ZSCORE + f"""
select {_COLUMNS} from (select * from z where z > 3 order by z desc, event_id limit 20)""")
def anomaly_sample(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return rounded(outliers.anomaly_sample(events, "value", keys=["event_id"]), 6, "z")


_POINTS = """
with c as (select event_type, row_number() over (order by event_type) - 1 as color_code
           from (select distinct event_type from events where event_type is not null))
select user_id, value, event_type, event_id, color_code
from events join c using (event_type)
where user_id is not null and value is not null and event_id is not null"""


@query("scatter_points", _POINTS)
def scatter_points(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return scatter.scatter_points(events, "user_id", "value", "event_type", "event_id")


@query("scatter_points_at_scale", _POINTS)
def scatter_points_at_scale(spark, sf_dir):
    """The path of colour columns with too many categories to broadcast."""
    events = table(spark, sf_dir, "events")
    return scatter.scatter_points(events, "user_id", "value", "event_type", "event_id", limit=2)
