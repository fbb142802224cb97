"""Scalar functions over whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import GAPPY_ORDERS, gappy_orders, query, table
from catalog.cleaning import TEXTS, order_texts
from tabulyze.functions import text


@query("fmt_number", f"""
select o_orderkey, coalesce(format('{{:,}}', o_custkey), 'N/A') as whole,
       coalesce(format('{{:,.2f}}', o_totalprice), 'N/A') as price,
       coalesce(format('{{:,.3f}}', o_totalprice / 7), 'N/A') as part
from ({GAPPY_ORDERS})""")
def fmt_number(spark, sf_dir):
    return gappy_orders(spark, sf_dir).select(
        "o_orderkey",
        text.fmt_number(F.col("o_custkey")).alias("whole"),
        text.fmt_number(F.col("o_totalprice")).alias("price"),
        text.fmt_number(F.col("o_totalprice") / 7, 3).alias("part"),
    )


@query("fmt_percentage", """
select l_orderkey, l_linenumber, l_discount, printf('%.2f%%', l_discount * 100) as share,
       printf('%.3f%%', l_extendedprice / 900000 * 100) as part
from lineitem""")
def fmt_percentage(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_discount",
        text.fmt_percentage(F.col("l_discount")).alias("share"),
        text.fmt_percentage(F.col("l_extendedprice") / 900000, 3).alias("part"),
    )


@query("safe_divide", """
select l_orderkey, l_linenumber,
       case when l_linenumber = 1 then -1
            else round(l_extendedprice / (l_linenumber - 1), 4) end as ratio
from lineitem""")
def safe_divide(spark, sf_dir):
    ratio = text.safe_divide(F.col("l_extendedprice"), F.col("l_linenumber") - 1, -1.0)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(ratio, 4).alias("ratio")
    )


@query("truncate_text", """
select doc_id, case when length(text) <= 50 then text
                    else substring(text, 1, 47) || '...' end as short,
       case when length(text) <= 20 then text
            else substring(text, 1, 18) || '>>' end as shorter
from documents""")
def truncate_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        text.truncate_text(F.col("text")).alias("short"),
        text.truncate_text(F.col("text"), 20, ">>").alias("shorter"),
    )


@query("parse_timestamp_or_null", f"""
select o_orderkey,
       coalesce(try_strptime(iso_date, '%Y-%m-%d'), try_strptime(iso_date, '%m/%d/%Y')) as iso,
       coalesce(try_strptime(us_date, '%Y-%m-%d'), try_strptime(us_date, '%m/%d/%Y')) as us,
       try_strptime(mostly_bad, '%Y-%m-%d') as bad
from ({TEXTS})""")
def parse_timestamp_or_null(spark, sf_dir):
    return order_texts(spark, sf_dir).select(
        "o_orderkey",
        text.parse_timestamp(F.col("iso_date")).alias("iso"),
        text.parse_timestamp(F.col("us_date")).alias("us"),
        text.parse_timestamp(F.col("mostly_bad"), "yyyy-MM-dd").alias("bad"),
    )


@query("parse_number_or_null", """
select o_orderkey, case when o_orderkey % 4 = 0 then null
                        when o_orderkey % 4 = 1 then o_totalprice * 1.0
                        when o_orderkey % 4 = 2 then null
                        else o_custkey::double end as number
from orders""")
def parse_number_or_null(spark, sf_dir):
    key = F.col("o_orderkey")
    shown = (
        F.when(key % 4 == 0, F.concat(F.col("o_custkey").cast("string"), F.lit("d")))
        .when(key % 4 == 1, F.col("o_totalprice").cast("string"))
        .when(key % 4 == 2, F.concat(F.lit("$"), F.col("o_custkey").cast("string")))
        .otherwise(F.concat(F.lit(" "), F.col("o_custkey").cast("string")))
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", text.parse_number(shown).alias("number")
    )
