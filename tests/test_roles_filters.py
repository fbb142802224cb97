import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabulyze.functions.columns import column_types
from tabulyze.operators import filters, roles


def test_roles(parcels, spark):
    assert column_types(parcels) == {
        "numerical": ["id", "weight", "price"], "categorical": ["carrier", "depot"],
        "datetime": ["sent"],
    }
    odd = spark.sql(
        "select true as b, array(1) as a, 1.5BD as d, date'2024-01-01' as day, "
        "timestamp'2024-01-01' as ts, map('a', 1) as m"
    )
    assert column_types(odd) == {
        "numerical": ["d"], "categorical": [], "datetime": ["day", "ts"],
    }
    assert [r["column"] for r in roles.column_roles(odd).collect()] == ["d", "day", "ts"]


def test_require_columns(parcels):
    roles.require_columns(parcels, "weight")
    with pytest.raises(ValueError, match="Columns not found in DataFrame: nope, Weight"):
        roles.require_columns(parcels, ["weight", "nope", "Weight"])


def test_require_nonempty(parcels, spark):
    roles.require_nonempty(parcels)
    with pytest.raises(ValueError, match="cannot be None"):
        roles.require_nonempty(None)
    with pytest.raises(ValueError, match="Expected a Spark DataFrame"):
        roles.require_nonempty([1])
    with pytest.raises(ValueError, match="DataFrame is empty"):
        roles.require_nonempty(parcels.limit(0))


def test_odd_names(spark):
    df = spark.createDataFrame([(1.0, "x"), (None, "y")], "`a.b c` double, `t``k` string")
    assert roles.project_complete_rows(df, ["a.b c", "t`k"]).count() == 1
    assert filters.filter_numeric_range(df, "a.b c", 0).count() == 1
    assert roles.select_numeric(df).columns == ["a.b c"]


@pytest.mark.parametrize("low, high, rows", [(8, None, 5), (None, 8, 3), (8, 22, 4),
                                             (None, None, 6)])
def test_numeric_range(parcels, low, high, rows):
    assert filters.filter_numeric_range(parcels, "weight", low, high).count() == rows


def test_numeric_range_missing(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "v double")
    assert filters.filter_numeric_range(df, "v").count() == 3
    assert filters.filter_numeric_range(df, "v", 0).count() == 1


@pytest.mark.parametrize("values, rows", [(["south", "west"], 4), ([], 6), (None, 6),
                                          (["none"], 0)])
def test_in_values(parcels, values, rows):
    assert filters.filter_in_values(parcels, "depot", values).count() == rows


def test_in_values_missing(readings):
    assert filters.filter_in_values(readings, "tag", ["up", None]).count() == 4
    assert filters.filter_in_values(readings, "tag", [None]).count() == 1


def test_date_range(parcels):
    day = dt.date(2021, 6, 3)
    assert filters.filter_date_range(parcels, "sent", day, "2021-06-09").count() == 3
    end = dt.datetime(2021, 6, 9)
    assert filters.filter_date_range(parcels, "sent", end_date=end).count() == 4


def test_bare_end_date_is_midnight(spark):
    df = spark.sql("select timestamp_ntz'2024-01-02 08:00:00' as ts")
    assert filters.filter_date_range(df, "ts", end_date="2024-01-02").count() == 0


def test_date_range_on_text(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-05",), ("soon",)], "d string")
    kept = filters.filter_date_range(df, "d", "2024-01-02")
    assert [r["d"] for r in kept.collect()] == [dt.datetime(2024, 1, 5)]
    assert filters.filter_date_range(df, "d").count() == 3


def test_compose(parcels):
    specs = [
        {"type": "numerical", "column": "weight", "min_val": 8},
        {"type": "categorical", "column": "depot", "values": ["south"]},
        {"type": "unknown", "column": "nowhere"},
        {"type": "date", "column": "sent", "start_date": "2021-06-20"},
    ]
    assert [r["carrier"] for r in filters.apply_filters(parcels, specs).collect()] == ["Fern"]
    assert filters.filter_row_counts(parcels, specs).first().asDict() == {
        "total": 6, "remaining": 1,
    }
    assert filters.apply_filters(parcels, []).count() == 6
    with pytest.raises(ValueError, match="Columns not found"):
        filters.apply_filters(parcels, [{"type": "numerical", "column": "zzz", "min_val": 1}])


def test_filters_reach_the_scan(spark, lines):
    spark.conf.set("spark.sql.maxMetadataStringLength", 10000)
    specs = [
        {"type": "numerical", "column": "l_quantity", "min_val": 10, "max_val": 20},
        {"type": "categorical", "column": "l_returnflag", "values": ["A", "R"]},
        {"type": "date", "column": "l_shipdate", "start_date": "1997-01-01"},
    ]
    kept = filters.apply_filters(lines, specs).groupBy("l_suppkey").agg(F.sum("l_tax"))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):plan.index("ReadSchema")]
    for part in ("GreaterThanOrEqual(l_quantity", "LessThanOrEqual(l_quantity",
                 "In(l_returnflag", "GreaterThanOrEqual(l_shipdate"):
        assert part in pushed
    assert "l_extendedprice" not in plan[plan.index("ReadSchema"):]
