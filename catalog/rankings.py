"""Grouped measures, value counts, top and bottom lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import LINE_KEYS, query, rounded, table
from tabulyze.functions.order_stats import grouped_median
from tabulyze.operators import filters, ranking

# Quantities with a supplier in ten left without any value, and a few keys missing.
GAPPY_LINES = """
select case when l_orderkey % 17 = 0 then null else l_suppkey end as l_suppkey,
       case when l_suppkey % 10 = 0 then null else l_extendedprice end as price
from lineitem"""


def gappy_lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_orderkey") % 17 != 0, F.col("l_suppkey")).alias("l_suppkey"),
        F.when(F.col("l_suppkey") % 10 != 0, F.col("l_extendedprice")).alias("price"),
    )


def _grouped(measure: str) -> str:
    return f"""
select l_suppkey, {measure} as value from ({GAPPY_LINES})
where l_suppkey is not null group by l_suppkey"""


@query("group_sum", _grouped("round(coalesce(sum(price), 0), 2)"))
def group_sum(spark, sf_dir):
    lines = gappy_lines(spark, sf_dir)
    return rounded(ranking.group_measure(lines, "l_suppkey", "price", "sum"), 2, "value")


@query("group_mean", _grouped("round(avg(price), 4)"))
def group_mean(spark, sf_dir):
    lines = gappy_lines(spark, sf_dir)
    return rounded(ranking.group_measure(lines, "l_suppkey", "price", "mean"), 4, "value")


@query("group_count", _grouped("count(price)"))
def group_count(spark, sf_dir):
    return ranking.group_measure(gappy_lines(spark, sf_dir), "l_suppkey", "price", "count")


@query("group_median", _grouped("round(quantile_cont(price, 0.5), 4)"))
def group_median(spark, sf_dir):
    lines = gappy_lines(spark, sf_dir)
    return rounded(ranking.group_measure(lines, "l_suppkey", "price", "median"), 4, "value")


@query("group_median_at_scale", _grouped("round(quantile_cont(price, 0.5), 4)"))
def group_median_at_scale(spark, sf_dir):
    """The path of groups too large for one task."""
    lines = gappy_lines(spark, sf_dir).filter(F.col("l_suppkey").isNotNull())
    medians = grouped_median(lines, ["l_suppkey"], "price", "value", limit=100, buckets=64)
    return rounded(medians, 4, "value")


@query("value_counts", "select event_type, count(*) as n from events group by event_type")
def value_counts(spark, sf_dir):
    return ranking.sorted_value_counts(table(spark, sf_dir, "events"), "event_type")


def _sides(rows: str, keys: str, tie: str, total: str, places: int = 4) -> str:
    return f"""
with a as ({rows}),
t as (select 'top' as side, * from a where value is not null order by value desc, {tie} limit 5),
b as (select 'bottom' as side, * from a order by value nulls first, {tie} limit 5),
l as (
  select *, row_number() over (order by value desc, {tie})::int as rank from t
  union all
  select *, row_number() over (order by value nulls last, {tie})::int as rank from b)
select side, rank, {keys}, round(value, {places}) as value,
       count(*) over w as side_count, round((sum(value) over w)::double, {places}) as side_total,
       round(case when {total} = 0 then 0 else sum(value) over w / {total} end, 8)
         as contribution
from l window w as (partition by side)"""


_TOTAL = "(select sum(value) from a)"


def _listed(listed):
    return rounded(rounded(listed, 4, "value", "side_total"), 8, "contribution")


def _top_grouped(aggregation: str, sql: str):
    @query(f"top_bottom_grouped_{aggregation}" if aggregation != "sum" else "top_bottom_grouped",
           _sides(f"select l_partkey, {sql} as value from lineitem group by l_partkey",
                  "l_partkey", "l_partkey", _TOTAL))
    def run(spark, sf_dir):
        lines = table(spark, sf_dir, "lineitem")
        return _listed(ranking.top_bottom(
            lines, "l_extendedprice", "l_partkey", aggregation=aggregation
        ))


_top_grouped("sum", "sum(l_extendedprice)")
_top_grouped("mean", "avg(l_extendedprice)")
_top_grouped("count", "count(l_extendedprice)")
_top_grouped("median", "quantile_cont(l_extendedprice, 0.5)")


FLAGSHIP = [
    {"type": "numerical", "column": "l_quantity", "min_val": 5, "max_val": 45},
    {"type": "categorical", "column": "l_returnflag", "values": ["A", "N"]},
]


@query("filtered_top_bottom", _sides("""
select l_partkey, sum(l_extendedprice) as value from lineitem
where l_quantity >= 5 and l_quantity <= 45 and l_returnflag in ('A', 'N')
group by l_partkey""", "l_partkey", "l_partkey", _TOTAL))
def filtered_top_bottom(spark, sf_dir):
    kept = filters.apply_filters(table(spark, sf_dir, "lineitem"), FLAGSHIP)
    return _listed(ranking.top_bottom(kept, "l_extendedprice", "l_partkey"))


@query("top_bottom_direct", _sides(
    f"select {', '.join(LINE_KEYS)}, l_extendedprice as value from lineitem",
    ", ".join(LINE_KEYS), ", ".join(LINE_KEYS), _TOTAL))
def top_bottom_direct(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return _listed(ranking.top_bottom(lines, "l_extendedprice", keys=LINE_KEYS))


@query("top_bottom_large_numbers", _sides(
    "select o_orderkey, 9007199254740993 + o_orderkey as value from orders",
    "o_orderkey", "o_orderkey", _TOTAL, 0))
def top_bottom_large_numbers(spark, sf_dir):
    """Whole numbers beyond what a double can tell apart."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.lit(9007199254740993) + F.col("o_orderkey")).alias("v"))
    listed = ranking.top_bottom(orders, "v", keys=["o_orderkey"])
    return rounded(rounded(listed, 0, "side_total"), 8, "contribution")


@query("top_bottom_contribution", f"""
select distinct side, side_count, side_total, contribution from ({_sides(
    "select l_suppkey, sum(l_extendedprice) as value from lineitem group by l_suppkey",
    "l_suppkey", "l_suppkey", _TOTAL)})""")
def top_bottom_contribution(spark, sf_dir):
    shares = ranking.top_bottom_contribution(
        table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_suppkey"
    )
    return rounded(rounded(shares, 4, "side_total"), 8, "contribution")


@query("category_top_n", """
select l_suppkey, round(avg(l_extendedprice), 4) as value from lineitem
group by l_suppkey order by avg(l_extendedprice) desc, l_suppkey limit 7""")
def category_top_n(spark, sf_dir):
    series = ranking.category_series(
        table(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice", "mean", 7
    )
    return rounded(series, 4, "value")


@query("category_count", """
select event_type, count(*) as value from events group by event_type""")
def category_count(spark, sf_dir):
    return ranking.category_series(table(spark, sf_dir, "events"), "event_type", "value")


@query("category_share", """
with s as (select p_brand, sum(p_retailprice) as value from part group by p_brand
           order by value desc, p_brand limit 6)
select p_brand, round(value, 2) as value,
       round(value / (select sum(value) from s) * 100, 1) as share from s""")
def category_share(spark, sf_dir):
    shares = ranking.category_share(
        table(spark, sf_dir, "part"), "p_brand", "p_retailprice", "sum", 6
    )
    return rounded(shares, 2, "value")
