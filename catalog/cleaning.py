"""Missing values, conversion, duplicates, outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import GAPPY_ORDERS, gappy_orders, query, rounded, table
from tabulyze.functions.text import clean_currency as clean_currency_expr
from tabulyze.operators import conversion, missing, outliers
from tabulyze.plans.prepare import prepare_table as prepare
from tabulyze.session import scratch_path
from tabulyze.sources import export_csv


@query("missing_none", GAPPY_ORDERS)
def missing_none(spark, sf_dir):
    return missing.handle_missing(gappy_orders(spark, sf_dir), "none")


@query("missing_drop", f"""
select * from ({GAPPY_ORDERS})
where o_custkey is not null and o_totalprice is not null and o_orderstatus is not null""")
def missing_drop(spark, sf_dir):
    return missing.handle_missing(gappy_orders(spark, sf_dir), "drop")


def _filled(measure: str) -> str:
    return f"""
with t as ({GAPPY_ORDERS})
select o_orderkey,
       round(coalesce(o_custkey::double, (select {measure.format('o_custkey')} from t)), 4)
         as o_custkey,
       round(coalesce(o_totalprice, (select {measure.format('o_totalprice')} from t)), 4)
         as o_totalprice,
       o_orderstatus
from t"""


@query("missing_fill_mean", _filled("avg({})"))
def missing_fill_mean(spark, sf_dir):
    filled = missing.handle_missing(gappy_orders(spark, sf_dir), "fill_mean")
    return rounded(filled, 4, "o_custkey", "o_totalprice")


@query("missing_fill_median", _filled("quantile_cont({}, 0.5)"))
def missing_fill_median(spark, sf_dir):
    filled = missing.handle_missing(gappy_orders(spark, sf_dir), "fill_median")
    return rounded(filled, 4, "o_custkey", "o_totalprice")


@query("missing_fill_large_ids", f"""
with t as ({GAPPY_ORDERS})
select 9007199254740993 + o_orderkey as big,
       round(coalesce(o_totalprice, (select avg(o_totalprice) from t)), 4) as o_totalprice
from t""")
def missing_fill_large_ids(spark, sf_dir):
    """A column without a gap keeps every digit."""
    orders = gappy_orders(spark, sf_dir).select(
        (F.lit(9007199254740993) + F.col("o_orderkey")).alias("big"), "o_totalprice")
    return rounded(missing.handle_missing(orders, "fill_mean"), 4, "o_totalprice")


@query("missing_fill_mode", f"""
with t as ({GAPPY_ORDERS})
select o_orderkey, o_custkey, o_totalprice,
       coalesce(o_orderstatus, (
         select o_orderstatus from t where o_orderstatus is not null
         group by o_orderstatus order by count(*) desc, o_orderstatus limit 1)) as o_orderstatus
from t""")
def missing_fill_mode(spark, sf_dir):
    return missing.handle_missing(gappy_orders(spark, sf_dir), "fill_mode")


# Orders as text: a fifth of the dates cannot be read, amounts carry symbols and commas.
TEXTS = """
select o_orderkey,
       case when o_orderkey % 5 = 0 then 'soon' else strftime(o_orderdate, '%Y-%m-%d') end
         as iso_date,
       case when o_orderkey % 5 = 1 then null
            else strftime(o_orderdate, '%m/%d/%Y') end as us_date,
       case when o_orderkey % 5 < 3 then '?' else strftime(o_orderdate, '%Y-%m-%d') end
         as mostly_bad,
       case when o_orderkey % 6 = 0 then '(5)' else '$' || format('{:,.2f}', o_totalprice) end
         as amount,
       case when o_totalprice > 200000 then 'Yes' else 'no' end as large,
       o_orderpriority
from orders"""


def order_texts(spark, sf_dir):
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    iso = F.date_format(day, "yyyy-MM-dd")
    money = F.concat(F.lit("$"), F.format_number("o_totalprice", 2))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(key % 5 == 0, "soon").otherwise(iso).alias("iso_date"),
        F.when(key % 5 != 1, F.date_format(day, "MM/dd/yyyy")).alias("us_date"),
        F.when(key % 5 < 3, "?").otherwise(iso).alias("mostly_bad"),
        F.when(key % 6 == 0, "(5)").otherwise(money).alias("amount"),
        F.when(F.col("o_totalprice") > 200000, "Yes").otherwise("no").alias("large"),
        "o_orderpriority",
    )


def _date_share(column: str, layout: str, pattern: str) -> str:
    return f"""
select '{column}' as "column", 'date' as kind, '{pattern}' as pattern from t
having count(try_strptime({column}, '{layout}')) * 1.0 / count({column}) > 0.5"""


@query("detect_date_columns", f"with t as ({TEXTS}) " + " union all ".join(
    _date_share(c, layout, pattern)
    for c in ("iso_date", "us_date", "mostly_bad", "amount", "large", "o_orderpriority")
    for layout, pattern in (("%Y-%m-%d", "yyyy-MM-dd"), ("%m/%d/%Y", "M/d/yyyy"))
))
def detect_date_columns(spark, sf_dir):
    texts = order_texts(spark, sf_dir)
    return conversion.plan_frame(texts, conversion.detect_dates(texts))


@query("convert_dates", f"""
select o_orderkey, try_strptime(iso_date, '%Y-%m-%d') as iso_date,
       try_strptime(us_date, '%m/%d/%Y') as us_date, mostly_bad
from ({TEXTS})""")
def convert_dates(spark, sf_dir):
    texts = order_texts(spark, sf_dir).select("o_orderkey", "iso_date", "us_date", "mostly_bad")
    return conversion.apply_plan(texts, conversion.detect_dates(texts))


AMOUNT = r"try_cast(regexp_replace(amount, '[$,€£¥\s]', '', 'g') as double)"


@query("detect_currency_columns", f"""
with t as ({TEXTS})
select 'amount' as "column", 'currency' as kind from t
having count(*) filter (where regexp_matches(amount, '[$€£¥]')) * 10 >= count(amount)
   and count({AMOUNT}) * 2 > count(amount)""")
def detect_currency_columns(spark, sf_dir):
    texts = order_texts(spark, sf_dir)
    return conversion.plan_frame(texts, conversion.detect_currency(texts)).drop("pattern")


@query("clean_currency", f"select o_orderkey, {AMOUNT} as amount from ({TEXTS})")
def clean_currency(spark, sf_dir):
    texts = order_texts(spark, sf_dir)
    return texts.select("o_orderkey", clean_currency_expr(F.col("amount")).alias("amount"))


@query("convert_booleans", f"""
select o_orderkey, upper(large) = 'YES' as large, o_orderpriority from ({TEXTS})""")
def convert_booleans(spark, sf_dir):
    texts = order_texts(spark, sf_dir).select("o_orderkey", "large", "o_orderpriority")
    return conversion.apply_plan(texts, conversion.detect_booleans(texts))


@query("convert_types", f"""
select o_orderkey, try_strptime(iso_date, '%Y-%m-%d') as iso_date,
       try_strptime(us_date, '%m/%d/%Y') as us_date, mostly_bad, {AMOUNT} as amount,
       upper(large) = 'YES' as large, o_orderpriority
from ({TEXTS})""")
def convert_types(spark, sf_dir):
    return conversion.convert_types(order_texts(spark, sf_dir))


@query("dedupe_rows", f"""
select distinct o_custkey, o_orderstatus from ({GAPPY_ORDERS})""")
def dedupe_rows(spark, sf_dir):
    return missing.dedupe_rows(gappy_orders(spark, sf_dir).select("o_custkey", "o_orderstatus"))


@query("dedupe_copies", f"""
select distinct * from ({GAPPY_ORDERS} union all {GAPPY_ORDERS})""")
def dedupe_copies(spark, sf_dir):
    orders = gappy_orders(spark, sf_dir)
    return missing.dedupe_rows(orders.unionByName(orders))


@query("dedupe_counts", f"""
select (select count(*) from (select distinct * from ({GAPPY_ORDERS}))) as rows,
       2 * (select count(*) from ({GAPPY_ORDERS}))
         - (select count(*) from (select distinct * from ({GAPPY_ORDERS}))) as removed""")
def dedupe_counts(spark, sf_dir):
    """Told by the write of the deduplicated table."""
    orders = gappy_orders(spark, sf_dir)
    kept, counts = missing.dedupe_observed(orders.unionByName(orders))
    kept.write.parquet(scratch_path(spark, "deduped"))
    return spark.createDataFrame([tuple(counts().values())], "rows bigint, removed bigint")


@query("wide_numbers", """
select cast(cast(o_orderkey as hugeint) + 9223372036854775809 as varchar) as id from orders""")
def wide_numbers(spark, sf_dir):
    """Whole numbers beyond 64 bits keep their digits; their type is decimal(38,0)."""
    texts = table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey").cast("decimal(20,0)") + F.lit("9223372036854775809").cast(
            "decimal(20,0)")).cast("string").alias("id"))
    typed = conversion.apply_plan(texts, conversion.detect_numbers(texts))
    return typed.select((F.col("id") + 0).cast("decimal(38,0)").cast("string").alias("id"))


def _zscore_step(source: str, column: str, t: float) -> str:
    return f"""
(select s.* from {source} s, (select avg({column}) as m, stddev_samp({column}) as d from {source})
 where abs(({column} - m) / d) < {t})"""


def _iqr_step(source: str, column: str, t: float) -> str:
    return f"""
(select s.* from {source} s, (select quantile_cont({column}, 0.25) as q1,
                                     quantile_cont({column}, 0.75) as q3 from {source})
 where {column} >= q1 - {t} * (q3 - q1) and {column} <= q3 + {t} * (q3 - q1))"""


@query("outliers_zscore", f"select * from {_zscore_step('events', 'value', 1.5)}")
def outliers_zscore(spark, sf_dir):
    return outliers.remove_outliers(table(spark, sf_dir, "events"), ["value"], "zscore", 1.5)


@query("outliers_iqr", f"select * from {_iqr_step('events', 'value', 1.5)}")
def outliers_iqr(spark, sf_dir):
    return outliers.remove_outliers(table(spark, sf_dir, "events"), ["value"], "iqr", 1.5)


@query("outliers_multi_column", f"""
with a as {_zscore_step(f'({GAPPY_ORDERS})', 'o_totalprice', 1.6)}
select * from {_zscore_step('a', 'o_custkey', 1.6)}""")
def outliers_multi_column(spark, sf_dir):
    columns = ["o_totalprice", "nowhere", "o_orderstatus", "o_custkey"]
    return outliers.remove_outliers(gappy_orders(spark, sf_dir), columns, "zscore", 1.6)


@query("outliers_iqr_multi_column", f"""
with a as {_iqr_step(f'({GAPPY_ORDERS})', 'o_totalprice', 0.3)}
select * from {_iqr_step('a', 'o_custkey', 0.3)}""")
def outliers_iqr_multi_column(spark, sf_dir):
    columns = ["o_totalprice", "o_custkey"]
    return outliers.remove_outliers(gappy_orders(spark, sf_dir), columns, "iqr", 0.3)


@query("prepare_table", f"""
select distinct o_orderkey, try_strptime(iso_date, '%Y-%m-%d') as iso_date,
       try_strptime(us_date, '%m/%d/%Y') as us_date, {AMOUNT} as amount,
       upper(large) = 'YES' as large
from ({TEXTS})""")
def prepare_table(spark, sf_dir):
    path = scratch_path(spark, "orders.csv")
    texts = order_texts(spark, sf_dir).select(
        "o_orderkey", "iso_date", "us_date", "amount", "large"
    )
    export_csv(texts.unionByName(texts), path)
    return prepare(spark, path)
