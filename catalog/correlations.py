"""Correlation queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from catalog.profiles import LINE_NUMBERS, matrix_sql, pairs_sql
from catalog.registry import GAPPY_ORDERS, gappy_orders, query, rounded, table
from tabulyze.operators import correlation, kendall

_ROUNDED = "select variable1, variable2, round(r, 6) as r from ({})"
_GAPPY = ["o_orderkey", "o_custkey", "o_totalprice"]


@query("corr_pearson", _ROUNDED.format(pairs_sql(f"({GAPPY_ORDERS})", _GAPPY)))
def corr_pearson(spark, sf_dir):
    return rounded(correlation.correlation_pairs(gappy_orders(spark, sf_dir)), 6, "r")


@query("corr_pearson_wide", _ROUNDED.format(pairs_sql(f"({GAPPY_ORDERS})", _GAPPY)))
def corr_pearson_wide(spark, sf_dir):
    """The path of tables with many columns."""
    pairs = correlation.correlation_pairs(gappy_orders(spark, sf_dir), wide=0)
    return rounded(pairs, 6, "r")


# On the rows where `near` is present, `far` lies a long way from its overall mean.
_OFFSET = """
select case when o_orderkey % 2 = 0 then 1e6 + o_totalprice / 7
            else -1e6 - o_custkey end as far,
       case when o_orderkey % 2 = 0 then o_totalprice end as near,
       case when o_orderkey % 3 > 0 then o_custkey::double end as third
from orders"""


def offset_orders(spark, sf_dir):
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        F.when(key % 2 == 0, 1e6 + price / 7).otherwise(-1e6 - F.col("o_custkey")).alias("far"),
        F.when(key % 2 == 0, price).alias("near"),
        F.when(key % 3 > 0, F.col("o_custkey").cast("double")).alias("third"),
    )


def _offset(name: str, wide: int) -> None:
    @query(name, _ROUNDED.format(pairs_sql(f"({_OFFSET})", ["far", "near", "third"])))
    def run(spark, sf_dir):
        return rounded(
            correlation.correlation_pairs(offset_orders(spark, sf_dir), wide=wide), 6, "r")


_offset("corr_pearson_offset", 10_000)
_offset("corr_pearson_wide_offset", 0)


def spearman_sql(source: str, columns: list[str]) -> str:
    def rank(c: str) -> str:
        return f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0"

    return " union all ".join(
        f"""
select '{a}' as variable1, '{b}' as variable2, round(corr(ra, rb), 6) as r
from (select {rank(a)} as ra, {rank(b)} as rb from {source}
      where {a} is not null and {b} is not null)"""
        for a, b in combinations(columns, 2)
    )


_RANKED = ["l_quantity", "l_extendedprice", "l_tax"]


@query("corr_spearman", spearman_sql("lineitem", _RANKED))
def corr_spearman(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return rounded(correlation.correlation_pairs(lines, _RANKED, "spearman", 64), 6, "r")


@query("corr_spearman_gaps", spearman_sql(f"({GAPPY_ORDERS})", _GAPPY))
def corr_spearman_gaps(spark, sf_dir):
    pairs = correlation.correlation_pairs(gappy_orders(spark, sf_dir), method="spearman")
    return rounded(pairs, 6, "r")


_KENDALL = """
with n as (select count(*)::double as n from part),
s as (select sum(sign(a.p_size - b.p_size) * sign(a.p_retailprice - b.p_retailprice)) as s
      from part a, part b where a.p_partkey < b.p_partkey),
x as (select sum(c * (c - 1) / 2) as t from (select count(*)::double as c from part group by p_size)),
y as (select sum(c * (c - 1) / 2) as t
      from (select count(*)::double as c from part group by p_retailprice))
select {names}round(s / sqrt((n * (n - 1) / 2 - x.t) * (n * (n - 1) / 2 - y.t)), 6) as r
from n, s, x, y"""


@query("corr_kendall",
       _KENDALL.format(names="'p_size' as variable1, 'p_retailprice' as variable2, "))
def corr_kendall(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    pairs = correlation.correlation_pairs(part, ["p_size", "p_retailprice"], "kendall")
    return rounded(pairs, 6, "r")


@query("corr_kendall_at_scale", _KENDALL.format(names=""))
def corr_kendall_at_scale(spark, sf_dir):
    """The path of tables too large for one task."""
    part = table(spark, sf_dir, "part")
    return rounded(
        kendall.kendall_pair(part, "p_size", "p_retailprice", rows_per_bucket=100), 6, "r"
    )


def kendall_sql(source: str, a: str, b: str) -> str:
    return f"""
select '{a}' as variable1, '{b}' as variable2, round(s / sqrt((n - x) * (n - y)), 6) as r from (
  select sum(sign(u.{a} - v.{a}) * sign(u.{b} - v.{b})) as s, count(*) as n,
         count_if(u.{a} = v.{a}) as x, count_if(u.{b} = v.{b}) as y
  from {source} u join {source} v on u.k < v.k
  where u.{a} is not null and u.{b} is not null and v.{a} is not null and v.{b} is not null)"""


_SIZED_PARTS = """(select p_partkey as k, p_size as size, p_retailprice as price,
  case when p_partkey % 3 > 0 then p_partkey % 17 end as lot,
  case when p_partkey % 5 > 0 then p_retailprice * p_size end as worth from part)"""
_SIZED = ["size", "price", "lot", "worth"]


@query("corr_kendall_gaps", " union all ".join(
    kendall_sql(_SIZED_PARTS, a, b) for a, b in combinations(_SIZED, 2)))
def corr_kendall_gaps(spark, sf_dir):
    """Several columns, some with gaps."""
    key = F.col("p_partkey")
    part = table(spark, sf_dir, "part").select(
        F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"),
        F.when(key % 3 > 0, key % 17).alias("lot"),
        F.when(key % 5 > 0, F.col("p_retailprice") * F.col("p_size")).alias("worth"))
    return rounded(correlation.correlation_pairs(part, method="kendall"), 6, "r")


@query("corr_spearman_gaps_at_scale", spearman_sql(f"({GAPPY_ORDERS})", _GAPPY))
def corr_spearman_gaps_at_scale(spark, sf_dir):
    """Pairs with gaps, cut into buckets as large tables are."""
    pairs = correlation.correlation_pairs(
        gappy_orders(spark, sf_dir), method="spearman", buckets=64)
    return rounded(pairs, 6, "r")


# A price related to another column, so that there are strong pairs to find.
RELATED = """
select l_quantity, l_extendedprice, l_discount, 3 * l_quantity + l_linenumber as load,
       l_extendedprice * (1 - l_discount) as net, -l_quantity + l_tax as less
from lineitem"""


def related(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_quantity", "l_extendedprice", "l_discount",
        (F.col("l_quantity") * 3 + F.col("l_linenumber")).alias("load"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"),
        (-F.col("l_quantity") + F.col("l_tax")).alias("less"),
    )


_RELATED = ["l_quantity", "l_extendedprice", "l_discount", "load", "net", "less"]
STRENGTH = """
case when abs(r) >= 0.9 then 'very strong' when abs(r) >= 0.7 then 'strong'
     when abs(r) >= 0.5 then 'moderate' when abs(r) >= 0.3 then 'weak'
     else 'very weak' end"""


@query("corr_strong_pairs", f"""
with p as ({pairs_sql(f'({RELATED})', _RELATED)})
select variable1, variable2, round(r, 6) as r, {STRENGTH} as strength,
       case when r > 0 then 'positive' else 'negative' end as direction,
       (select count(*) from p) as pairs_analyzed,
       (select count(*) from p where abs(r) >= 0.7) as strong_found
from p where abs(r) >= 0.7 order by abs(r) desc, variable1, variable2 limit 10""")
def corr_strong_pairs(spark, sf_dir):
    return rounded(correlation.strong_pairs(related(spark, sf_dir)), 6, "r")


@query("corr_strength", f"""
select variable1, variable2, round(r, 6) as r, {STRENGTH} as strength,
       case when r > 0 then 'positive' else 'negative' end as direction
from ({pairs_sql(f'({RELATED})', _RELATED)})""")
def corr_strength(spark, sf_dir):
    pairs = correlation.correlation_pairs(related(spark, sf_dir))
    return rounded(correlation.with_strength(pairs), 6, "r")


@query("corr_matrix_long", matrix_sql(pairs_sql("lineitem", LINE_NUMBERS), "lineitem", LINE_NUMBERS))
def corr_matrix_long(spark, sf_dir):
    return rounded(correlation.correlation_matrix(table(spark, sf_dir, "lineitem")), 6, "r")
