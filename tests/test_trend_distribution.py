import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabulyze.operators import distribution, outliers, scatter, trend


@pytest.fixture(scope="module")
def walk():
    rng = np.random.default_rng(1)
    stamps = pd.date_range("2024-01-01 06:30", periods=200, freq="7h")
    return pd.DataFrame({"date": stamps, "value": rng.normal(0, 5, 200).cumsum() + 100})


def test_trend_equals_pandas(spark, walk):
    row = trend.trend(spark.createDataFrame(walk), "date", "value", "weekly", limit=20).first()
    days = (walk.date - walk.date.min()).dt.days.values
    first, last = walk.value.iloc[0], walk.value.iloc[-1]
    assert row.period == "weekly" and row.error is None and row.rows == 200
    assert (row.first_value, row.last_value) == (first, last)
    assert row.absolute_change == pytest.approx(last - first)
    assert row.percentage_change == pytest.approx((last - first) / first)
    assert row.growth_rate == pytest.approx(np.polyfit(days, walk.value, 1)[0])
    assert row.median == pytest.approx(walk.value.median())
    assert row.std_deviation == pytest.approx(walk.value.std())
    assert row.start_date == "2024-01-01" and row.days == int(days.max())
    assert row.trend_direction == ("increasing" if last > first else "decreasing")


def test_trend_needs_two_rows(spark):
    df = spark.createDataFrame([("2024-01-01", 100), (None, 5), ("bad", 7)], "d string, v long")
    row = trend.trend(df, "d", "v").first()
    assert row.error == "Insufficient data for trend analysis"
    assert row.mean is None and row.trend_direction is None
    assert trend.trend(df.limit(0), "d", "v").first().error is not None


def test_trend_without_growth(spark):
    df = spark.createDataFrame([("2024-01-01", 0.0), ("2024-01-01", 0.0)], "d string, v double")
    row = trend.trend(df, "d", "v").first()
    assert row.growth_rate is None and row.percentage_change == 0.0
    assert row.trend_direction == "stable" and row.volatility == "low"


@pytest.mark.parametrize("std, mean, level", [
    (0.5, 10.0, "low"), (2.0, 10.0, "moderate"), (4.0, 10.0, "high"), (4.0, -10.0, "low"),
    (1.0, 0.0, "low"), (3.0, 10.0, "high"),
])
def test_volatility(spark, std, mean, level):
    level_of = trend.volatility_level(F.lit(std), F.lit(mean))
    assert spark.range(1).select(level_of).first()[0] == level


def test_time_series(spark):
    df = spark.createDataFrame(
        [("2024-01-02", 1), ("2024-01-01", 2), ("2024-01-02", 4), ("x", 9), ("2024-01-03", None)],
        "d string, v long",
    )
    day = [dt.datetime(2024, 1, i) for i in (1, 2, 3)]

    def series(how):
        return [tuple(r) for r in trend.time_series(df, "d", "v", how).collect()]

    assert series("sum") == [(day[0], 2), (day[1], 5), (day[2], 0)]
    assert series("mean") == [(day[0], 2.0), (day[1], 2.5), (day[2], None)]
    assert series("count") == [(day[0], 1), (day[1], 2), (day[2], 0)]
    assert series("median") == [(day[0], 2.0), (day[1], 2.5), (day[2], None)]
    assert series("none") == [(day[0], 2), (day[1], 1), (day[1], 4), (day[2], None)]
    assert series("whatever") == series("none")


def test_trendline(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 5.0), (3.0, 7.0), (None, 1.0)], "x double, y double")
    assert [r.fitted for r in trend.scatter_trendline(df, "x", "y").collect()] == [3, 5, 7]
    flat = spark.createDataFrame([(1.0, 3.0), (1.0, 5.0)], "x double, y double")
    assert [r.fitted for r in trend.scatter_trendline(flat, "x", "y").collect()] == [None, None]


@pytest.mark.parametrize("values", [
    [1, 2, 2, 3, 9], [5, 5, 5, 5], [1.5], [1, 2], [1, 2, 4], list(np.random.default_rng(0).gamma(2, 3, 300)),
])
def test_numeric_distribution_equals_pandas(spark, values):
    s = pd.Series(values, dtype=float)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    row = distribution.numeric_distribution(df, "v", limit=20).first()
    for name, want in {
        "count": len(s), "mean": s.mean(), "median": s.median(), "mode": s.mode()[0],
        "std": s.std(), "min": s.min(), "max": s.max(), "range": s.max() - s.min(),
        "q1": s.quantile(.25), "q3": s.quantile(.75), "skewness": s.skew(),
        "kurtosis": s.kurtosis(),
    }.items():
        if isinstance(want, float) and math.isnan(want):
            assert row[name] is None, name
        else:
            assert row[name] == pytest.approx(want, abs=1e-9), name


def test_distribution_of_nothing(spark):
    df = spark.createDataFrame([(None, None), (None, None)], "v double, t string")
    assert distribution.numeric_distribution(df, "v").first().error == "No valid data"
    assert distribution.categorical_distribution(df, "t").first().error == "No valid data"
    with pytest.raises(ValueError, match="No valid data in column 'v'"):
        distribution.histogram(df, "v")
    with pytest.raises(ValueError, match="No valid data"):
        distribution.box_stats(df, "v")


@pytest.mark.parametrize("skew, kurt, label", [
    (0.1, 0.1, "approximately normal"), (0.6, 0.0, "right-skewed (positive skew)"),
    (-0.6, 0.0, "left-skewed (negative skew)"), (0.0, 1.5, "heavy-tailed (leptokurtic)"),
    (0.0, -1.5, "light-tailed (platykurtic)"), (0.0, 0.7, "mixed characteristics"),
    (0.5, 0.0, "mixed characteristics"), (None, None, "mixed characteristics"),
])
def test_shapes(spark, skew, kurt, label):
    made = distribution.shape_label(F.lit(skew).cast("double"), F.lit(kurt).cast("double"))
    assert spark.range(1).select(made).first()[0] == label


def test_categorical_distribution(parcels):
    row = distribution.categorical_distribution(parcels, "depot").first()
    assert tuple(row)[:-1] == (6, 3, "south", 3, 0.5, "west", 1)


@pytest.mark.parametrize("bins", [1, 7, 30])
@pytest.mark.parametrize("values", [
    [0.1 * i for i in range(101)], [3.0, 3.0], [1.0, 2.0, 10.0], [-5.0, 5.0, 0.0, 0.1, 0.3],
])
def test_histogram_equals_numpy(spark, values, bins):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    rows = distribution.histogram(df, "v", bins).collect()
    counts, edges = np.histogram(values, bins=bins)
    assert sum(r.n for r in rows) == len(values)
    assert [r.n for r in rows] == counts.tolist()
    assert [r.low for r in rows] == pytest.approx(edges[:-1].tolist())


def test_box(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 5, 100)], "v double")
    row = distribution.box_stats(df, "v").first()
    assert (row.q1, row.median, row.q3) == (2.25, 3.5, 4.75)
    assert (row.whisker_low, row.whisker_high, row.outliers, row.n) == (1.0, 5.0, 1, 6)
    assert [tuple(r) for r in distribution.box_outliers(df, "v").collect()] == [(100.0, 1)]


def test_density_covers_the_mass(events):
    curve = distribution.density_curve(events, "value").toPandas()
    assert len(curve) == 100
    mass = np.trapezoid(curve.density, curve.x)
    assert 0.95 < mass < 1.01
    flat = events.select(F.lit(2.0).alias("v"))
    assert [tuple(r) for r in distribution.density_curve(flat, "v").collect()] == [(0, 2.0, None)]


def test_anomalies(spark):
    rng = np.random.default_rng(5)
    values = [*rng.normal(100, 10, 95), 200.0, 10.0, 250.0, 5.0, 220.0]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)] + [(-1, None)],
                               "k long, v double")
    s = pd.Series(values)
    z = ((s - s.mean()) / s.std()).abs()
    got = {r.k for r in outliers.anomalies(df, "v", "zscore", 2.0).collect()}
    assert got == set(np.flatnonzero(z > 2.0))
    q1, q3 = s.quantile(.25), s.quantile(.75)
    outside = (s < q1 - 1.5 * (q3 - q1)) | (s > q3 + 1.5 * (q3 - q1))
    assert {r.k for r in outliers.anomalies(df, "v", "iqr", 1.5).collect()} == set(
        np.flatnonzero(outside))
    row = outliers.anomaly_summary(df, "v", "iqr", 1.5, limit=10).first()
    assert (row.total_points, row.anomaly_count) == (100, outside.sum())
    assert row.max_anomaly == 250.0 and row.min_anomaly == 5.0
    assert row.median == pytest.approx(s.median())
    worst = outliers.anomaly_sample(df, "v", "zscore", 2.0, 2, ["k"]).collect()
    assert [r.v for r in worst] == s[z.nlargest(2).index].tolist()


def test_anomaly_limits(spark):
    df = spark.createDataFrame([(5.0, "a"), (5.0, "b"), (5.0, "c")], "v double, t string")
    assert outliers.anomaly_summary(df, "v").first().anomaly_count == 0
    assert outliers.anomaly_summary(df.limit(2), "v").first().error == "Insufficient data"
    assert outliers.anomaly_summary(df, "t").first().error == "Column t is not numerical"
    for call in (outliers.anomalies, outliers.anomaly_summary):
        with pytest.raises(ValueError, match="Unsupported method: mad"):
            call(df, "v", "mad")


@pytest.mark.parametrize("limit", [100, 1])
def test_scatter_codes(spark, limit):
    rows = [(float(i), float(-i), "bca"[i % 3] if i % 2 else "b", i) for i in range(300)]
    df = spark.createDataFrame([*rows, (1.0, None, "a", 1), (1.0, 1.0, None, 1)],
                               "x double, y double, c string, s long")
    got = scatter.scatter_points(df, "x", "y", "c", "s", limit=limit)
    assert got.count() == 300
    assert {(r.c, r.color_code) for r in got.collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert scatter.scatter_points(df, "x", "y", "s").columns == ["x", "y", "s"]
