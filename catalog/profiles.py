"""Profile queries and the SQL builders that insight queries reuse."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from catalog.registry import GAPPY_ORDERS, gappy_orders, query, rounded, table
from tabulyze.functions import order_stats
from tabulyze.operators import correlation, profile


def numeric_sql(source: str, columns: list[str]) -> str:
    return " union all ".join(
        f"""
select '{c}' as "column", count({c}) as count, round(avg({c}), 4) as mean,
       round(stddev_samp({c}), 4) as std, min({c})::double as min,
       round(quantile_cont({c}, 0.25), 4) as q25, round(quantile_cont({c}, 0.5), 4) as q50,
       round(quantile_cont({c}, 0.75), 4) as q75, max({c})::double as max
from {source}"""
        for c in columns
    )


def text_sql(source: str, columns: list[str]) -> str:
    counts = " union all ".join(
        f"""select '{c}' as "column", {c} as value, count(*) as n from {source}
            where {c} is not null group by {c}"""
        for c in columns
    )
    return f"""
select "column", unique_count, first_value(value) over w as top_value,
       first_value(n) over w as top_frequency, rank, value, n
from (select *, row_number() over (partition by "column" order by n desc, value)::int as rank,
             count(*) over (partition by "column") as unique_count
      from ({counts}))
window w as (partition by "column" order by rank)
qualify rank <= 10"""


def pairs_sql(source: str, columns: list[str]) -> str:
    return " union all ".join(
        f"""
select '{a}' as variable1, '{b}' as variable2,
       case when min(case when {b} is not null then {a} end)
               = max(case when {b} is not null then {a} end)
              or min(case when {a} is not null then {b} end)
               = max(case when {a} is not null then {b} end) then null
            else corr({a}, {b}) end as r
from {source}"""
        for a, b in combinations(columns, 2)
    )


def matrix_sql(pairs: str, source: str, columns: list[str]) -> str:
    diagonal = " union all ".join(
        f"""select '{c}' as variable1, '{c}' as variable2,
            case when min({c}) < max({c}) then 1.0::double end as r from {source}"""
        for c in columns
    )
    return f"""
with p as ({pairs})
select variable1, variable2, round(r, 6) as r from (
  select * from p union all select variable2, variable1, r from p union all {diagonal})"""


LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax"]
LINE_TYPES = [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
              ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
              ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
              ("l_linestatus", "string"), ("l_shipdate", "timestamp_ntz")]


@query("profile_basic_info", " union all ".join(
    f"""select {i}::int as position, '{c}' as "column", '{t}' as type, count(*) as rows,
        {len(LINE_TYPES)}::int as columns from lineitem"""
    for i, (c, t) in enumerate(LINE_TYPES)
))
def profile_basic_info(spark, sf_dir):
    return profile.basic_info(table(spark, sf_dir, "lineitem"))


def _missing(column: str) -> str:
    return f"""
select '{column}' as "column", count(*) - count({column}) as missing_count,
       round((count(*) - count({column})) / count(*) * 100, 2) as missing_percentage
from ({GAPPY_ORDERS}) having count(*) > count({column})"""


@query("profile_missing", " union all ".join(
    _missing(c) for c in ("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
))
def profile_missing(spark, sf_dir):
    return profile.missing_report(gappy_orders(spark, sf_dir))


_ROUND = ("mean", "std", "q25", "q50", "q75")


@query("profile_numeric", numeric_sql("lineitem", LINE_NUMBERS))
def profile_numeric(spark, sf_dir):
    return rounded(profile.numeric_summary(table(spark, sf_dir, "lineitem")), 4, *_ROUND)


@query("profile_categorical", text_sql("documents", ["text", "lang", "source"]))
def profile_categorical(spark, sf_dir):
    return profile.text_summary(table(spark, sf_dir, "documents"))


@query("profile_correlation",
       f"select variable1, variable2, round(r, 6) as r "
       f"from ({pairs_sql('lineitem', LINE_NUMBERS)})")
def profile_correlation(spark, sf_dir):
    return rounded(correlation.correlation_pairs(table(spark, sf_dir, "lineitem")), 6, "r")


_ORDER_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]
_ORDER_TYPES = [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_totalprice", "double"),
                ("o_orderstatus", "string")]
_UNPIVOT = ("count", "mean", "std", "min", "q25", "q50", "q75", "max")


def full_profile_sql() -> str:
    info = " union all ".join(
        f"""select 'basic_info' as section, '{c}' as "column", 'rows' as metric,
            count(*)::double as value, '{t}' as text from t"""
        for c, t in _ORDER_TYPES
    )
    missing = " union all ".join(
        f"""select 'missing_values', "column", '{m}', {m}::double, null from m"""
        for m in ("missing_count", "missing_percentage")
    )
    numeric = " union all ".join(
        f"""select 'numerical_summary', "column", '{m}', {m}::double, null from n"""
        for m in _UNPIVOT
    )
    category = " union all ".join(
        f"""select 'categorical_summary', "column", '{m}', {m}::double, null
            from c where rank = 1"""
        for m in ("unique_count", "top_frequency")
    )
    missing_rows = " union all ".join(_missing(c) for c, _ in _ORDER_TYPES)
    pairs = pairs_sql("t", _ORDER_NUMBERS)
    return f"""
with t as ({GAPPY_ORDERS}), m as ({missing_rows}),
     n as ({numeric_sql('t', _ORDER_NUMBERS)}), c as ({text_sql('t', ['o_orderstatus'])}),
     k as ({matrix_sql(pairs, 't', _ORDER_NUMBERS)})
select section, "column", metric, round(value, 4) as value, text from (
{info} union all {missing} union all {numeric} union all {category}
union all select 'value_counts', "column", rank::varchar, n::double, value from c
union all select 'correlation_matrix', variable1, variable2, r, null from k)"""


@query("profile_full", full_profile_sql())
def profile_full(spark, sf_dir):
    whole = profile.full_profile(gappy_orders(spark, sf_dir))
    return rounded(rounded(whole, 6, "value"), 4, "value")


_QUANTILES = """
select unnest([0.1::double, 0.25::double, 0.5::double, 0.75::double, 0.99::double]) as p,
       unnest([round(quantile_cont(l_extendedprice, 0.1), 4),
               round(quantile_cont(l_extendedprice, 0.25), 4),
               round(quantile_cont(l_extendedprice, 0.5), 4),
               round(quantile_cont(l_extendedprice, 0.75), 4),
               round(quantile_cont(l_extendedprice, 0.99), 4)]) as quantile
from lineitem"""
_PROBS = [0.1, 0.25, 0.5, 0.75, 0.99]


@query("exact_quantiles", _QUANTILES)
def exact_quantiles(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return rounded(order_stats.exact_quantiles(lines, "l_extendedprice", _PROBS), 4, "quantile")


@query("exact_quantiles_at_scale", _QUANTILES)
def exact_quantiles_at_scale(spark, sf_dir):
    """The path of tables too large for one task's value map."""
    lines = table(spark, sf_dir, "lineitem")
    found = order_stats.exact_quantiles(lines, "l_extendedprice", _PROBS, limit=500)
    return rounded(found, 4, "quantile")


@query("exact_quantiles_tree", _QUANTILES)
def exact_quantiles_tree(spark, sf_dir):
    """Small sketches, from scan parts of unequal size, that must be narrowed again."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice")
    few = F.col("l_orderkey") % 50 == 0
    parts = lines.filter(~few).unionAll(lines.filter(few).repartition(20, "l_orderkey"))
    found = order_stats.quantile_values(
        parts, ["l_extendedprice"], _PROBS, limit=500, sketch_size=200)["l_extendedprice"]
    rows = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.lit(v).cast("double").alias("quantile"))
                     for p, v in zip(_PROBS, found)])
    return rounded(spark.range(1).select(F.inline(rows)), 4, "quantile")


@query("approximate_quantiles", """
select unnest([0.1, 0.25, 0.5, 0.75, 0.99])::double as probability, true as within""")
def approximate_quantiles(spark, sf_dir):
    """Whether the rank of each sketched value lies within a thousandth of the rows."""
    lines = table(spark, sf_dir, "lineitem")
    found = order_stats.approximate_quantiles(lines, "l_extendedprice", _PROBS, 1000).collect()
    price, n, slack = F.col("l_extendedprice"), F.count("l_extendedprice"), 1 / 1000
    return lines.agg(F.array(*[
        F.struct(
            F.lit(float(p)).alias("probability"),
            ((F.count_if(price < F.lit(q)) <= (p + slack) * n)
             & (F.count_if(price <= F.lit(q)) >= (p - slack) * n)).alias("within"))
        for p, q in found
    ]).alias("r")).select(F.inline("r"))


