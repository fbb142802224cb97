"""Filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import GAPPY_ORDERS, gappy_orders, query, table
from tabulyze.operators import filters

SPECS = [
    {"type": "numerical", "column": "l_quantity", "min_val": 10, "max_val": 40},
    {"type": "categorical", "column": "l_returnflag", "values": ["A", "R"]},
    {"type": "date", "column": "l_shipdate", "start_date": "1996-01-01",
     "end_date": "2000-12-31"},
    {"type": "colour", "column": "l_tax"},
]
WHERE = """l_quantity >= 10 and l_quantity <= 40 and l_returnflag in ('A', 'R')
and l_shipdate >= timestamp '1996-01-01' and l_shipdate <= timestamp '2000-12-31'"""


@query("filter_numeric_range",
       f"select * from ({GAPPY_ORDERS}) where o_totalprice >= 100000 and o_totalprice <= 250000")
def filter_numeric_range(spark, sf_dir):
    return filters.filter_numeric_range(
        gappy_orders(spark, sf_dir), "o_totalprice", 100000, 250000
    )


@query("filter_in_values",
       f"select * from ({GAPPY_ORDERS}) where o_orderstatus in ('F') or o_orderstatus is null")
def filter_in_values(spark, sf_dir):
    return filters.filter_in_values(gappy_orders(spark, sf_dir), "o_orderstatus", ["F", None])


@query("filter_date_range", """
select * from events where ts >= timestamp '2024-01-03' and ts <= timestamp '2024-01-20'""")
def filter_date_range(spark, sf_dir):
    return filters.filter_date_range(
        table(spark, sf_dir, "events"), "ts", "2024-01-03", "2024-01-20"
    )


@query("filter_date_range_text", """
select o_orderkey, o_orderdate from orders
where o_orderkey % 13 <> 0
  and o_orderdate >= timestamp '1996-06-01' and o_orderdate <= timestamp '1998-06-30'""")
def filter_date_range_text(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    texts = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 13 == 0, "unknown").otherwise(day).alias("o_orderdate"),
    )
    return filters.filter_date_range(texts, "o_orderdate", "1996-06-01", "1998-06-30")


@query("filter_compose", f"select * from lineitem where {WHERE}")
def filter_compose(spark, sf_dir):
    return filters.apply_filters(table(spark, sf_dir, "lineitem"), SPECS)


@query("filter_row_counts",
       f"select count(*) as total, count(*) filter (where {WHERE}) as remaining from lineitem")
def filter_row_counts(spark, sf_dir):
    return filters.filter_row_counts(table(spark, sf_dir, "lineitem"), SPECS)
