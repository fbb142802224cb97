import datetime as dt

import pytest
from pyspark.sql import functions as F

from tabulyze.operators import outliers, ranking, scatter
from tabulyze.plans.insights import InsightRegistry, insights
from tabulyze.plans.views import ViewRegistry, recommend_views, views


def metrics(df):
    return {r.metric: r.text if r.value is None else r.value for r in df.collect()}


@pytest.fixture(scope="module")
def shop(spark):
    rows = [(10 * i + (500 if i == 7 else 0), i % 3, "ab"[i % 2],
             dt.datetime(2024, 1, 1) + dt.timedelta(days=i)) for i in range(1, 21)]
    return spark.createDataFrame(rows, "sales long, kind long, region string, day timestamp_ntz")


def test_dispatch(shop):
    assert insights.available() == ["top_bottom", "trend", "anomaly", "distribution", "correlation"]
    with pytest.raises(ValueError, match="Unsupported insight type: nope"):
        insights.generate("nope", shop)


def test_top_bottom_sentences(shop):
    got = metrics(insights.generate("top_bottom", shop, column="sales", group_by="region"))
    assert got["summary"] == (
        "Top performer in sales: 'b' with 1,500. Bottom performer: 'a' with 1,100. "
        "Top 2 performers contribute 100.00% of total."
    )
    direct = metrics(insights.generate("top_bottom", shop, column="sales"))
    assert direct["summary"] == "Highest value in sales: 570. Lowest value: 10. Range: 560"
    mean = metrics(insights.generate("top_bottom", shop, column="sales", group_by="region",
                                     aggregation="mean"))
    assert "with 150.00." in mean["summary"]


def test_trend_sentence(shop):
    got = metrics(insights.generate("trend", shop, date_column="day", value_column="sales"))
    assert got["summary"] == (
        "sales shows a increasing trend with 1900.00% increase. Absolute change: 190. "
        "Volatility: high."
    )
    assert got["period"] == "overall" and got["days"] == 19
    short = metrics(insights.generate("trend", shop.limit(1), date_column="day",
                                      value_column="sales"))
    assert short["error"] == "Insufficient data for trend analysis"
    assert short["summary"] == "Not enough data points to analyze trends."


def test_anomaly_sentences(shop, spark):
    got = metrics(insights.generate("anomaly", shop, column="sales"))
    assert got["summary"] == (
        "Detected 1 anomalies (5.00%) in sales. Range of anomalies: 570 to 570."
    )
    none = metrics(insights.generate("anomaly", shop, column="kind", method="iqr"))
    assert none["summary"] == "No anomalies detected in kind using iqr method."
    zero = spark.createDataFrame([(0,)] + [(100,)] * 30, "v long")
    assert metrics(insights.generate("anomaly", zero, column="v"))["summary"] == (
        "Detected 1 anomalies (3.23%) in v. "
    )
    text = metrics(insights.generate("anomaly", shop, column="region"))
    assert text["error"] == "Column region is not numerical"
    assert text["summary"] == "Cannot detect anomalies in non-numerical column region."
    few = metrics(insights.generate("anomaly", shop.limit(2), column="sales"))
    assert few["summary"] == "Not enough data points to detect anomalies."


def test_distribution_sentences(shop):
    got = metrics(insights.generate("distribution", shop, column="region"))
    assert got["summary"] == "region has 2 unique values. Most common: 'a' (50.00%)."
    number = metrics(insights.generate("distribution", shop, column="kind"))
    assert number["summary"].startswith("kind has a light-tailed (platykurtic) distribution. Mean:")
    assert number["summary"].endswith("Range: 0 to 2.")
    empty = metrics(insights.generate("distribution", shop.limit(0), column="kind"))
    assert empty["summary"] == "No valid data in column kind."


def test_correlation_sentences(shop):
    related = shop.select("sales", (F.col("sales") * 2).alias("double"), "kind")
    got = metrics(insights.generate("correlation", related))
    assert got["summary"] == (
        "Found 1 strong correlations. Strongest: sales and double (positive, 1.00)."
    )
    assert got["pairs_analyzed"] == 3
    none = metrics(insights.generate("correlation", shop))
    assert none["summary"] == "No strong correlations (threshold: 0.7) found."
    one = metrics(insights.generate("correlation", shop.select("sales")))
    assert one["error"] == "Insufficient numerical columns"
    assert one["summary"] == "Need at least 2 numerical columns for correlation analysis."


def test_lists_inside_insights(shop):
    top = metrics(insights.generate("top_bottom", shop, column="sales", group_by="region", top_n=1))
    assert {m for m in top if m.startswith("top_")} >= {"top_1"} and "top_2" not in top
    rows = {r.metric: r for r in insights.generate(
        "distribution", shop, column="region").collect()}
    assert (rows["common_1"].value, rows["common_1"].text) == (10.0, "a")
    assert "common_3" not in rows
    odd = metrics(insights.generate("anomaly", shop, column="sales"))
    assert odd["anomaly_1"] == 570.0 and "anomaly_2" not in odd
    related = shop.select("sales", (F.col("sales") * 2).alias("double"), "kind")
    pairs = {r.metric: r for r in insights.generate("correlation", related).collect()}
    assert pairs["pair_1"].text == "sales, double" and "pair_2" not in pairs


def test_shared_facts_change_nothing(shop):
    sales = shop.select("sales")
    every = insights.generate_all(sales)
    for name in ("distribution", "anomaly"):
        alone = insights.generate(name, sales, column="sales")
        got = every.filter(F.col("insight") == name).drop("insight")
        assert sorted(map(str, got.collect())) == sorted(map(str, alone.collect()))


def test_all_insights(shop):
    rows = insights.generate_all(shop, {"top_bottom": {"top_n": 3}}).collect()
    assert {r.insight for r in rows} == {
        "top_bottom", "distribution", "anomaly", "correlation", "trend",
    }
    counts = {r.value for r in rows if (r.insight, r.metric) == ("top_bottom", "top_count")}
    assert counts == {3.0}
    assert insights.summaries(shop).count() == 5
    assert {r.insight for r in insights.generate_all(shop.select("kind")).collect()} == {
        "top_bottom", "distribution", "anomaly",
    }
    assert insights.generate_all(shop.select("region")).count() == 0


def test_failing_insight_is_left_out(shop):
    rows = insights.generate_all(shop, {"anomaly": {"method": "nope"}, "trend": {"zzz": 1}})
    assert {r.insight for r in rows.collect()} == {"top_bottom", "distribution", "correlation"}


def test_register_insight(shop):
    registry = InsightRegistry()
    before = len(registry.available())
    registry.register("rows", lambda df: df.agg(F.count("*").alias("value")))
    assert len(registry.available()) == before + 1
    assert registry.generate("rows", shop).first().value == 20
    assert "rows" not in insights.available()


def test_views(shop):
    assert views.available() == ["time_series", "distribution", "category", "scatter", "correlation"]
    assert views.required_params("time_series") == ["date_column", "value_column"]
    assert views.required_params("correlation") == []
    for call in (views.required_params, lambda n: views.create(n, shop)):
        with pytest.raises(ValueError, match="Unsupported visualization type: nope"):
            call("nope")
    for kind, rows in (("histogram", 30), ("box", 1), ("violin", 100)):
        made = views.create("distribution", shop, column="sales", plot_type=kind)
        assert made.count() == rows
    for name, options in (("distribution", {"column": "sales", "plot_type": "radar"}),
                          ("category", {"column": "region", "plot_type": "radar"})):
        with pytest.raises(ValueError, match="Unsupported plot type: radar"):
            views.create(name, shop, **options)
    pie = views.create("category", shop, column="region", plot_type="pie")
    assert [r.share for r in pie.collect()] == [50.0, 50.0]
    points = views.create("scatter", shop, x_column="kind", y_column="sales", show_trend=True)
    assert points.columns == ["kind", "sales", "fitted"]
    coloured = views.create("scatter", shop, x_column="kind", y_column="sales",
                            color_column="region", show_trend=True)
    assert coloured.columns == ["kind", "sales", "region", "color_code", "fitted"]
    assert views.create("correlation", shop).count() == 4


def test_register_view(shop):
    registry = ViewRegistry()
    registry.register("rows", lambda df, column: df.select(column), ["column"])
    assert registry.required_params("rows") == ["column"]
    assert registry.create("rows", shop, column="kind").count() == 20


def test_recommendations(shop, spark):
    rows = recommend_views(shop).collect()
    assert [(r.rank, r.type, r.priority) for r in rows] == [
        (1, "time_series", "high"), (2, "category", "high"), (3, "distribution", "medium"),
        (4, "scatter", "medium"),
    ]
    assert rows[1].params == {"column": "region", "plot_type": "bar"}
    assert rows[1].reason == 'Found categorical column "region" with 2 categories'
    many = spark.range(11).select(F.col("id").cast("string").alias("t"))
    assert recommend_views(many).count() == 0
    ten = many.limit(10)
    assert [r.type for r in recommend_views(ten).collect()] == ["category"]


def test_column_names_that_results_use(spark):
    df = spark.createDataFrame(
        [(i, float(i % 5), "ab"[i % 2], "xy"[i % 2], i * 1.0) for i in range(40)],
        "rank long, value double, n string, code string, z double",
    )
    assert {r.insight for r in insights.generate_all(df).collect()} == {
        "top_bottom", "distribution", "anomaly", "correlation",
    }
    listed = ranking.top_bottom(df, "rank", "value")
    assert listed.columns[:4] == ["side", "rank", "value_", "value"]
    assert ranking.top_bottom(df, "z").filter("side = 'top'").count() == 5
    assert ranking.category_series(df, "value").columns == ["value", "value_"]
    assert ranking.category_share(df, "value").count() == 5
    assert ranking.sorted_value_counts(df, "n").columns == ["n", "n_"]
    assert outliers.anomaly_sample(df, "rank", "zscore", 1.5).columns[-1] == "z_"
    for limit in (10, 1):
        points = scatter.scatter_points(df, "rank", "value", "code", limit=limit)
        assert {(r.code, r.color_code) for r in points.collect()} == {("x", 0), ("y", 1)}


def test_tasks_do_not_import_the_package():
    from pyspark import cloudpickle

    from tabulyze.operators import kendall

    shipped = cloudpickle.dumps(kendall._x_bucket_discordant)
    assert b"lexsort" in shipped
