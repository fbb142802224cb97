import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulyze.operators import profile, ranking


def test_basic_info(parcels):
    rows = profile.basic_info(parcels).collect()
    assert [(r["column"], r["type"]) for r in rows] == parcels.dtypes
    assert {(r["rows"], r["columns"]) for r in rows} == {(6, 6)}


def test_missing_report(readings):
    rows = [tuple(r) for r in profile.missing_report(readings).collect()]
    assert rows == [("flow", 2, 33.33), ("level", 1, 16.67), ("tag", 1, 16.67)]


def test_missing_report_counts_nan(spark):
    df = spark.createDataFrame([(float("nan"), 1), (None, None), (1.0, 2)], "a double, b long")
    rows = [tuple(r) for r in profile.missing_report(df).collect()]
    assert rows == [("a", 2, 66.67), ("b", 1, 33.33)]


def test_numeric_summary_equals_pandas(lines):
    got = profile.numeric_summary(lines, limit=50).toPandas().set_index("column")
    want = lines.toPandas().select_dtypes("number").describe().T
    want.columns = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]
    pd.testing.assert_frame_equal(
        got.loc[want.index].astype(float), want.astype(float), check_names=False, rtol=1e-10
    )


def test_summaries_of_tables_without_such_columns(spark):
    df = spark.createDataFrame([("a",)], "t string")
    assert profile.numeric_summary(df).count() == 0
    numbers = spark.createDataFrame([(1,)], "n long")
    assert profile.text_summary(numbers).count() == 0
    assert profile.full_profile(df).filter("section = 'correlation_matrix'").count() == 0


def test_text_summary(parcels):
    rows = profile.text_summary(parcels).filter("column = 'depot'").orderBy("rank")
    assert [(r.unique_count, r.top_value, r.top_frequency, r.rank, r.value, r.n)
            for r in rows.collect()] == [
        (3, "south", 3, 1, "south", 3), (3, "south", 3, 2, "north", 2),
        (3, "south", 3, 3, "west", 1),
    ]


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame(
        [("a", 10, 1.0), ("a", 5, None), ("b", 7, 2.0), ("c", None, None), ("c", None, 4.0),
         (None, 100, 9.0), ("d", -3, float("nan"))],
        "product string, sales long, revenue double",
    )


@pytest.mark.parametrize("aggregation, want", [
    ("sum", {"a": 15, "b": 7, "c": 0, "d": -3}),
    ("mean", {"a": 7.5, "b": 7, "c": None, "d": -3}),
    ("count", {"a": 2, "b": 1, "c": 0, "d": 1}),
    ("median", {"a": 7.5, "b": 7, "c": None, "d": -3}),
    ("other", {"a": 15, "b": 7, "c": 0, "d": -3}),
])
def test_group_measure(sales, aggregation, want):
    got = ranking.group_measure(sales, "product", "sales", aggregation)
    assert {r["product"]: r["value"] for r in got.collect()} == want


def test_nan_is_not_a_value(sales):
    got = ranking.group_measure(sales, "product", "revenue", "sum")
    assert {r["product"]: r["value"] for r in got.collect()} == {"a": 1, "b": 2, "c": 4, "d": 0}


def test_top_bottom(sales):
    rows = ranking.top_bottom(sales, "sales", "product", 2, 2).orderBy("side", "rank").collect()
    assert [(r.side, r.rank, r.product, r.value) for r in rows] == [
        ("bottom", 1, "d", -3.0), ("bottom", 2, "c", 0.0),
        ("top", 1, "a", 15.0), ("top", 2, "b", 7.0),
    ]
    assert rows[2].contribution == pytest.approx(22 / 19)
    assert rows[0].side_total == -3.0 and rows[0].side_count == 2


def test_missing_aggregates_are_at_the_bottom(sales):
    rows = ranking.top_bottom(sales, "sales", "product", 5, 2, "mean").orderBy("side", "rank")
    assert [(r.side, r.product) for r in rows.collect()] == [
        ("bottom", "d"), ("bottom", "c"), ("top", "a"), ("top", "b"), ("top", "d"), ("top", "c"),
    ]


def test_top_bottom_direct(sales):
    rows = ranking.top_bottom(sales, "sales", top_n=2, bottom_n=1, keys=["product"])
    assert [(r.side, r.value) for r in rows.orderBy("side", "rank").collect()] == [
        ("bottom", -3.0), ("top", 100.0), ("top", 10.0),
    ]


def test_top_bottom_zero_total(spark):
    df = spark.createDataFrame([("a", 1), ("b", -1)], "k string, v long")
    assert {r.contribution for r in ranking.top_bottom(df, "v", "k").collect()} == {0.0}


def test_top_bottom_uses_top_k(lines):
    plan = ranking.top_bottom(lines, "l_extendedprice", "l_partkey")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("TakeOrderedAndProject") >= 2
    assert "l_comment" not in text and "NestedLoop" not in text


def test_category_series(sales):
    assert [tuple(r) for r in ranking.category_series(sales, "product").collect()] == [
        ("a", 2), ("c", 2), ("b", 1), ("d", 1),
    ]
    top = ranking.category_series(sales, "product", "sales", "sum", 2)
    assert [tuple(r) for r in top.collect()] == [("a", 15), ("b", 7)]
    counted = ranking.category_series(sales, "product", "sales", "count")
    assert counted.count() == 4 and counted.first()["value"] == 2


def test_category_share(sales):
    rows = ranking.category_share(sales, "product", "sales", "sum", 2).collect()
    assert [(r["product"], r["share"]) for r in rows] == [("a", 68.2), ("b", 31.8)]


def test_modes(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "x"), ("a", None), ("b", "y")], "p string, q string")
    assert {tuple(r) for r in ranking.column_modes(df, ["p", "q"]).collect()} == {
        ("p", "a", 2), ("q", "x", 2),
    }


def test_value_counts_combine_before_the_shuffle(lines):
    plan = ranking.value_counts(lines, "l_returnflag")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("HashAggregate") == 2
    assert "ReadSchema: struct<l_returnflag:string>" in text


def test_unknown_columns(sales):
    for call in (
        lambda: ranking.top_bottom(sales, "nope"),
        lambda: ranking.top_bottom(sales, "sales", "nope"),
        lambda: ranking.category_series(sales, "product", "nope"),
        lambda: ranking.value_counts(sales, "nope"),
    ):
        with pytest.raises(ValueError, match="Columns not found"):
            call()


def test_hot_group_is_combined_before_the_shuffle(spark):
    df = spark.range(20000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"),
        F.col("id").alias("v"),
    )
    top = ranking.top_bottom(df, "v", "k", 1, 1).filter("side = 'top'").first()
    assert (top["k"], top["value"]) == (0, float(sum(range(0, 20000, 3))))


def plain_tops(rows, top):
    counts = pd.Series([r for r in rows if r is not None], dtype=object).value_counts()
    ordered = sorted(counts.items(), key=lambda p: (-p[1], p[0].encode()))
    return [(i + 1, value, n) for i, (value, n) in enumerate(ordered[:top])]


def test_top_values_of_long_texts_and_ties(spark, monkeypatch):
    shared = "a head that all of these texts have in common, "
    texts = [shared + str(i % 23) for i in range(60)] + ["", "", "é" * 40, None, shared] * 2
    short = [f"s{i % 7}" if i % 5 else None for i in range(len(texts))]
    df = spark.createDataFrame(
        list(zip(texts, short, [None] * len(texts))), "t string, s string, none string")
    for few in (1000, 3):  # candidates sent to the tasks, or joined
        monkeypatch.setattr(ranking, "FEW", few)
        for top in (1, 10, 100):
            found = ranking.top_values(df, ["t", "s", "none"], top).collect()
            for name, rows in (("t", texts), ("s", short), ("none", [])):
                got = sorted((r.rank, r.value, r.n) for r in found if r.column == name)
                assert got == plain_tops(rows, top)
    empty = df.limit(0)
    assert ranking.top_values(empty, ["t"], 10).collect() == []
    assert profile.text_summary(empty).collect() == []


def test_no_exchange_carries_a_text(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    counts = ranking.hashed_counts(documents, ["text"])
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = counts._jdf.queryExecution().explainString(mode)
    inputs = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*?)\]\n", plan)
    assert len(inputs) == 1
    names = [re.sub(r"#\d+L?", "", name) for name in inputs[0].split(", ")]
    assert names == ["column", "h1", "h2", "count", "min", "max"]
