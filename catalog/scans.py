"""Readers and writers: driver tables are written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.registry import GAPPY_ORDERS, gappy_orders, query, table
from tabulyze.session import scratch_path
from tabulyze.sources import (
    SourceRegistry, export_csv, load_table, read_csv, read_json, read_tsv,
)
from tabulyze.sources.readers import read_delimited

CHUNK = 1000


def _write_lines(df: DataFrame, path: str) -> None:
    # One record per file, since a JSON document is a file of its own.
    df.write.option("maxRecordsPerFile", 1).text(path)


@query("scan_csv", """
select o_orderkey, o_custkey, o_orderstatus, o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') as o_orderdate, o_orderpriority
from orders""")
def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "orders.csv")
    export_csv(table(spark, sf_dir, "orders"), path)
    return read_csv(spark, path)


@query("scan_csv_latin1", "select c_custkey, 'Café ' || c_name as c_name from customer")
def scan_csv_latin1(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "customer.csv")
    named = table(spark, sf_dir, "customer").select(
        "c_custkey", F.concat(F.lit("Café "), F.col("c_name")).alias("c_name")
    )
    named.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return read_csv(spark, path)


@query("scan_csv_mixed_encodings", """
select c_custkey, 'Café ' || c_name as c_name from customer
union all
select c_custkey, 'Café, ' || chr(10) || c_name as c_name from customer where c_custkey % 2 = 0""")
def scan_csv_mixed_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of UTF-8 and Latin-1 files, some with fields over several lines."""
    path = scratch_path(spark, "customer.csv")
    customer = table(spark, sf_dir, "customer")
    even = F.col("c_custkey") % 2 == 0
    one_line = F.concat(F.lit("Café "), F.col("c_name")).alias("c_name")
    two_lines = F.concat(F.lit("Café, \n"), F.col("c_name")).alias("c_name")
    for rows, encoding, name in ((customer.filter(even), "UTF-8", one_line),
                                 (customer.filter(~even), "ISO-8859-1", one_line),
                                 (customer.filter(even), "ISO-8859-1", two_lines)):
        rows.select("c_custkey", name).write.mode("append").option("header", True) \
            .option("escape", '"').option("encoding", encoding).csv(path)
    return read_csv(spark, path)


@query("scan_csv_multiline", """
select doc_id, 'a "quoted", ' || chr(10) || lang as note, n_chars from documents""")
def scan_csv_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "notes.csv")
    notes = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit('a "quoted", \n'), F.col("lang")).alias("note"), "n_chars"
    )
    export_csv(notes, path)
    return read_csv(spark, path)


NA_MARKS = ["N/A", "NULL", "nan", "#N/A", "None"]


@query("scan_na_tokens", """
select c_custkey,
       case when c_custkey % 9 < 5 then null else c_acctbal end as c_acctbal,
       case when c_custkey % 4 = 0 then null else c_mktsegment end as c_mktsegment
from customer""")
def scan_na_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "customer.csv")
    key = F.col("c_custkey")
    balance = F.col("c_acctbal").cast("string")
    marks = F.get(F.lit(NA_MARKS), (key % 9).cast("int"))
    export_csv(
        table(spark, sf_dir, "customer").select(
            "c_custkey",
            F.when(key % 9 < 5, marks).otherwise(balance).alias("c_acctbal"),
            F.when(key % 4 == 0, "<NA>").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
        ),
        path,
    )
    return read_csv(spark, path)


@query("scan_json_records",
       "select c_custkey, c_name, c_acctbal, c_nationkey::bigint as c_nationkey from customer")
def scan_json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "customer.json")
    record = F.struct("c_custkey", "c_name", "c_acctbal", "c_nationkey")
    _write_lines(
        table(spark, sf_dir, "customer")
        .groupBy(F.floor(F.col("c_custkey") / CHUNK).alias("chunk"))
        .agg(F.to_json(F.collect_list(record)).alias("value")).select("value"),
        path,
    )
    return read_json(spark, path)


@query("scan_json_lines", "select p_partkey, p_name, p_retailprice from part")
def scan_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "part.json")
    table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice").write.json(path)
    return read_json(spark, path)


@query("scan_json_columns", "select c_custkey, c_name, c_acctbal from customer")
def scan_json_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "customer.json")
    names = ["c_custkey", "c_name", "c_acctbal"]
    row = (F.col("c_custkey") % CHUNK).cast("string")
    columns = F.struct(
        *[F.map_from_entries(F.collect_list(F.struct(row, F.col(c)))).alias(c) for c in names]
    )
    _write_lines(
        table(spark, sf_dir, "customer")
        .groupBy(F.floor(F.col("c_custkey") / CHUNK).alias("chunk"))
        .agg(F.to_json(columns).alias("value")).select("value"),
        path,
    )
    return read_json(spark, path)


@query("scan_parquet", "select * from lineitem")
def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_table(spark, f"{sf_dir}/lineitem.parquet")


@query("scan_tsv", """
select p_partkey, p_name, p_brand, p_size::bigint as p_size, p_retailprice from part""")
def scan_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "part.tsv")
    part = table(spark, sf_dir, "part")
    export_csv(part.select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"), path, "\t")
    return read_tsv(spark, path)


@query("scan_dispatch", "select c_custkey, c_mktsegment, c_acctbal from customer")
def scan_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "customer.CSV")
    customer = table(spark, sf_dir, "customer")
    export_csv(customer.select("c_custkey", "c_mktsegment", "c_acctbal"), path)
    return load_table(spark, path)


@query("sink_csv", GAPPY_ORDERS)
def sink_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "orders.csv")
    export_csv(gappy_orders(spark, sf_dir), path)
    return read_csv(spark, path)


@query("register_source", "select s_suppkey, s_name, s_acctbal from supplier")
def register_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "supplier.psv")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    export_csv(supplier, path, "|")
    sources = SourceRegistry()
    sources.register(".psv", lambda session, p: read_delimited(session, p, "|"))
    return sources.load(spark, path)
