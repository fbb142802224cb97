import datetime as dt

import pandas as pd
import pytest

from tabulyze.operators import conversion, missing, outliers


def test_missing_strategies(readings):
    def gaps(df):
        return int(df.toPandas().isna().sum().sum())

    assert gaps(missing.handle_missing(readings, "none")) == 4
    assert gaps(missing.handle_missing(readings, "whatever")) == 4
    assert missing.handle_missing(readings, "drop").count() == 3
    mean = missing.handle_missing(readings, "fill_mean").toPandas()
    assert mean["level"].tolist() == [4, 6, 8, 6, 2, 10]
    assert mean["flow"].tolist() == [1.5, 2.5, 3.5, 7.0, 3.5, 3.0]
    assert mean["tag"].isna().sum() == 1
    median = missing.handle_missing(readings, "fill_median").toPandas()
    assert median["level"].tolist() == [4, 6, 8, 6, 2, 10]
    assert median["flow"].tolist() == [1.5, 2.5, 2.75, 7.0, 2.75, 3.0]
    mode = missing.handle_missing(readings, "fill_mode").toPandas()
    assert mode["tag"].tolist() == ["up", "up", "up", "down", "mid", "up"]


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "v double")
    assert missing.handle_missing(df, "drop").count() == 2
    assert [r.v for r in missing.handle_missing(df, "fill_mean").collect()] == [1.0, 2.0, 3.0]
    assert [r.v for r in missing.handle_missing(df, "fill_median").collect()] == [1.0, 2.0, 3.0]


def test_all_missing_columns(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "v double, t string")
    for strategy in ("fill_mean", "fill_median", "fill_mode"):
        rows = missing.handle_missing(df, strategy).collect()
        assert [tuple(r) for r in rows] == [(None, None)] * 2


def test_dedupe(spark):
    df = spark.createDataFrame(
        [(1, "a"), (2, "b"), (3, "c"), (2, "b"), (4, None), (4, None)], "id long, value string"
    )
    assert missing.dedupe_rows(df).count() == 4


def test_convert_types(spark):
    df = spark.createDataFrame(
        [("$100", "2024-01-01", "TRUE", "abc", "1/2/2021", "no"),
         ("$200", "2024-01-02", "FALSE", "def", None, "Yes"),
         ("$300", "bad", "TRUE", "ghi", "1/3/2021", None)],
        "price string, date string, bool_col string, words string, us string, answer string",
    )
    plan = conversion.detect_types(df)
    assert {c: s.kind for c, s in plan.items()} == {
        "price": "currency", "date": "date", "bool_col": "boolean", "us": "date",
        "answer": "boolean",
    }
    got = [tuple(r) for r in conversion.convert_types(df).collect()]
    assert got == [
        (100.0, dt.datetime(2024, 1, 1), True, "abc", dt.datetime(2021, 1, 2), False),
        (200.0, dt.datetime(2024, 1, 2), False, "def", None, True),
        (300.0, None, True, "ghi", dt.datetime(2021, 1, 3), None),
    ]
    assert conversion.convert_types(df, plan).dtypes == conversion.convert_types(df).dtypes


def test_detection_by_share(spark):
    half = spark.createDataFrame([("2024-01-01",), ("x",)], "d string")
    assert conversion.detect_dates(half) == {}
    prose = spark.createDataFrame([("costs $5 or so",), ("free",)], "t string")
    assert conversion.detect_currency(prose) == {}
    three = spark.createDataFrame([("yes",), ("no",), ("TRUE",)], "t string")
    assert conversion.detect_booleans(three) == {}
    empty = spark.createDataFrame([(None,)], "t string")
    assert conversion.detect_types(empty) == {}


def test_detect_numbers(spark):
    df = spark.createDataFrame(
        [("1", "1.5", "True", "x", "007", None), (" 2", "2", "false", "1", "12", None)],
        "i string, f string, b string, t string, z string, n string",
    )
    assert {c: s.kind for c, s in conversion.detect_numbers(df).items()} == {
        "i": "integer", "f": "number", "b": "boolean", "z": "integer",
    }


@pytest.mark.parametrize("method, threshold", [("zscore", 2.0), ("iqr", 1.5)])
def test_outliers(spark, method, threshold):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 4, 5, 100)], "values long")
    kept = outliers.remove_outliers(df, ["values"], method, threshold)
    assert [r[0] for r in kept.collect()] == [1, 2, 3, 4, 5]


def test_outliers_skip_and_constant(spark):
    df = spark.createDataFrame([(5.0, "a"), (5.0, "b"), (None, "c")], "v double, t string")
    assert outliers.remove_outliers(df, ["t", "nope"]).count() == 3
    assert outliers.remove_outliers(df, ["v"], "other").count() == 3
    assert outliers.remove_outliers(df, ["v"], "zscore").count() == 0
    assert outliers.remove_outliers(df, ["v"], "iqr").count() == 2


def test_outliers_in_turn_equal_pandas(lines):
    pdf = lines.select("l_extendedprice", "l_quantity").toPandas()
    for c in ("l_extendedprice", "l_quantity"):
        pdf = pdf[((pdf[c] - pdf[c].mean()) / pdf[c].std()).abs() < 1.4]
    kept = outliers.remove_outliers(lines, ["l_extendedprice", "l_quantity"], "zscore", 1.4)
    got = kept.select("l_extendedprice", "l_quantity").toPandas()
    order = ["l_extendedprice", "l_quantity"]
    pd.testing.assert_frame_equal(
        got.sort_values(order).reset_index(drop=True), pdf.sort_values(order).reset_index(drop=True)
    )


def test_removed_rows_are_observed(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None), (3, "b")], "k int, v string")
    kept, counts = missing.dedupe_observed(df)
    store = spark.sparkContext._jsc.sc().statusStore()
    assert kept.count() == 3
    jobs = store.jobsList(None).size()
    assert counts() == {"rows": 3, "removed": 2}
    assert store.jobsList(None).size() == jobs


def test_whole_numbers_keep_their_digits(spark):
    rows = [("9223372036854775809", "1" * 39, "1", "12"), (" -9223372036854775810", "2", "1.5", None)]
    df = spark.createDataFrame(rows, "wide string, wider string, number string, small string")
    plan = conversion.detect_numbers(df)
    assert {n: s.kind for n, s in plan.items()} == {
        "wide": "wide", "number": "number", "small": "integer"}
    found = conversion.apply_plan(df, plan).collect()
    assert [int(r.wide) for r in found] == [9223372036854775809, -9223372036854775810]
    assert [r.wider for r in found] == ["1" * 39, "2"]
