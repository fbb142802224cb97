"""Values, rows and digits that readers and cleaning must not lose."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabulyze.functions.text import parse_timestamp
from tabulyze.operators import correlation, distribution, filters, missing, ranking
from tabulyze.plans.views import scatter_view
from tabulyze.sources import readers

BIG = 9007199254740993


@pytest.fixture
def offset(spark):
    """x lies near 1e6 where y is present and near -1e6 elsewhere; z has no gap."""
    return spark.range(4000).select(
        F.when(F.col("id") % 2 == 0, 1e6 + F.col("id") / 7).otherwise(-1e6 - F.col("id")).alias("x"),
        F.when(F.col("id") % 2 == 0, 2e6 + F.col("id") / 3).alias("y"),
        F.when(F.col("id") % 3 > 0, F.col("id") * F.col("id")).cast("double").alias("w"),
        F.sin(F.col("id").cast("double")).alias("z"),
        F.when(F.col("id") % 2 == 0, 5.0).otherwise(F.col("id")).alias("flat_with_y"),
    )


def test_pearson_is_the_same_at_any_width(offset):
    rows, names = correlation._selected(offset, None)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    results = []
    for wide in (0, 10_000):
        found = correlation._pearson_pairs(rows, names, pairs, wide).collect()
        results.append({(r.variable1, r.variable2): r.r for r in found})
    narrow, wide = results[1], results[0]
    assert narrow.keys() == wide.keys()
    for pair, r in narrow.items():
        assert wide[pair] == (None if r is None else pytest.approx(r, abs=1e-9)), pair
    assert wide["x", "y"] == pytest.approx(1.0)
    assert wide["y", "flat_with_y"] is None


def test_filling_leaves_whole_columns_alone(spark):
    df = spark.createDataFrame([(BIG, 1), (BIG + 2, None)], "id long, v int")
    for how in ("fill_mean", "fill_median"):
        out = missing.handle_missing(df, how)
        assert dict(out.dtypes) == {"id": "bigint", "v": "double"}
        assert [r.id for r in out.orderBy("id").collect()] == [BIG, BIG + 2]


def test_filling_keeps_decimals(spark):
    df = spark.sql("select * from values (1.50BD), (null), (2.50BD) as t(v)")
    out = missing.fill_mean(df)
    assert out.schema["v"].dataType == df.schema["v"].dataType
    assert sorted(float(r.v) for r in out.collect()) == [1.5, 2.0, 2.5]


def test_dedupe_sees_maps(spark):
    df = spark.sql("""
        select 1 as a, map('x', 1) as m, named_struct('k', array(map('y', 1))) as s union all
        select 1, map('x', 2), named_struct('k', array(map('y', 1))) union all
        select 1, map('x', 1), named_struct('k', array(map('y', 2))) union all
        select 1, map('x', 1), named_struct('k', array(map('y', 1)))""")
    out = missing.dedupe_rows(df)
    assert out.columns == df.columns and out.count() == 3
    same = spark.sql("select map('a', 1, 'b', 2) as m union all select map('b', 2, 'a', 1)")
    assert missing.dedupe_rows(same).count() == 1


def test_rankings_list_whole_numbers_as_they_are(spark):
    df = spark.createDataFrame([(i, BIG + i) for i in range(6)], "k long, v long")
    for rows in (ranking.top_bottom(df, "v", keys=["k"], top_n=2, bottom_n=2),
                 ranking.top_bottom(df, "v", group_by="k", top_n=2, bottom_n=2)):
        listed = {(r.side, r["rank"]): r.value for r in rows.collect()}
        assert listed["top", 1] == BIG + 5 and listed["bottom", 1] == BIG


def test_times_do_not_go_by_the_zone(spark):
    texts = ["2024-03-10 02:30:00", "2024-03-10T02:30:00.5", "3/10/2024 2:30", "3/10/2024",
             "2024-03-10", "2024-02-30", "13/1/2024"]
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
            parse_timestamp(F.col("t")).alias("v")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    day = dt.datetime(2024, 3, 10)
    assert [r.v for r in rows] == [
        day.replace(hour=2, minute=30), day.replace(hour=2, minute=30, microsecond=500_000),
        day.replace(hour=2, minute=30), day, day, None, None]


def test_values_of_another_type_match_nothing(spark):
    df = spark.createDataFrame([("a", 1), ("1", 2)], "t string, n long")
    assert df.filter(filters.in_values(df, "t", [1, 2])).count() == 0
    assert df.filter(filters.in_values(df, "n", ["x", 2])).count() == 1


def test_histogram_refuses_infinite_values(spark):
    df = spark.createDataFrame([(1.0,), (float("inf"),)], "v double")
    with pytest.raises(ValueError, match="not finite"):
        distribution.histogram(df, "v")


def write(tmp_path, **files):
    for name, text in files.items():
        (tmp_path / name.replace("_", ".")).write_text(text)
    return str(tmp_path)


def test_surplus_fields_raise_or_are_kept(spark, tmp_path):
    path = write(tmp_path, a_csv="a,b\n1,2\n3,4,5\n6\n")
    with pytest.raises(Exception, match="more fields than the header"):
        readers.read_csv(spark, path).collect()
    rows = readers.read_csv(spark, path, surplus="more").collect()
    assert sorted((r.a, r.b, r.more) for r in rows if r.b) == [(1, 2, None), (3, 4, 5)]
    assert len(rows) == 3


def test_json_lines_with_numeric_keys_stay_lines(spark, tmp_path):
    path = write(tmp_path, a_json='{"scores": {"1": 5, "2": 6}, "id": 7}\n')
    assert readers.json_layout(spark, path) == "lines"
    assert readers.read_json(spark, path).first().id == 7


@pytest.mark.parametrize("text, layout", [
    ('{\n "a": 1,\n "b": {"c": 2}\n}\n', "records"), ('[\n{"a": 1}, {"a": 2}]', "records"),
    ('{"a": {"0": 1, "1": 2},\n "b": {"0": 3, "1": 4}}', "columns"),
    ('{"a": {"0": 1}, "b": {"0": 3}}', "columns"), ('{"a": 1}\n{"a": 2}\n', "lines"), ("", "lines"),
])
def test_json_layouts(spark, tmp_path, text, layout):
    path = write(tmp_path, a_json=text)
    assert readers.json_layout(spark, path) == layout


def test_broken_column_json_raises(spark, tmp_path):
    path = write(tmp_path, a_json='{"a": {"0": 1}, "b": {"0": 3}}', b_json='{"a": {"0": 1}, "b"')
    with pytest.raises(Exception, match="Not column-oriented"):
        readers.read_json(spark, path, layout="columns").collect()


def test_trendline_keeps_a_column_called_fitted(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a"), (2.0, 4.0, "b")],
                               "x double, y double, fitted string")
    points = scatter_view(df, "x", "y", color_column="fitted", show_trend=True)
    assert sorted(r.fitted for r in points.collect()) == ["a", "b"]
    assert "fitted_" in points.columns
