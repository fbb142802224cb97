"""The query table and the inputs several queries share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

CATALOG: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        if name in CATALOG:
            raise ValueError(f"Query {name} is registered twice")
        CATALOG[name] = (run, sql)
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), places) for c in columns})


# The driver tables have no missing values; this gives orders some, by rule, in all rows.
GAPPY_ORDERS = """
select o_orderkey,
       case when o_orderkey % 11 = 0 then null else o_custkey end as o_custkey,
       case when o_orderkey % 7 = 0 then null else o_totalprice end as o_totalprice,
       case when o_orderkey % 5 = 0 then null else o_orderstatus end as o_orderstatus
from orders"""


def gappy_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(key % 11 != 0, F.col("o_custkey")).alias("o_custkey"),
        F.when(key % 7 != 0, F.col("o_totalprice")).alias("o_totalprice"),
        F.when(key % 5 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
    )


LINE_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
