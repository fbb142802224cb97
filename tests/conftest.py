import os
import sys
import tempfile

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").appName("tabulyze-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tabulyze-test-"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def lines(spark):
    return spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")


@pytest.fixture(scope="session")
def events(spark):
    return spark.read.parquet("/root/testdata/sf0.001/events.parquet")


@pytest.fixture(scope="session")
def parcels(spark):
    rows = [
        (11, "Nord", 3, 120, "north", "2021-06-01"), (12, "Kite", 8, 75, "south", "2021-06-03"),
        (13, "Otter", 8, 310, "south", "2021-06-04"), (14, "Reed", 15, 95, "west", "2021-06-09"),
        (15, "Moss", 22, 60, "north", "2021-06-12"), (16, "Fern", 30, 15, "south", "2021-07-01"),
    ]
    schema = "id long, carrier string, weight long, price long, depot string, sent string"
    return spark.createDataFrame(rows, schema).withColumn(
        "sent", F.col("sent").cast("timestamp_ntz")
    )


@pytest.fixture(scope="session")
def readings(spark):
    return spark.createDataFrame(
        [(4.0, "up", 1.5), (None, "up", 2.5), (8.0, None, None), (6.0, "down", 7.0),
         (2.0, "mid", None), (10.0, "up", 3.0)],
        "level double, tag string, flow double",
    )
