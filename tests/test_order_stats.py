"""The paths for large tables, forced on small ones and checked against pandas."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tabulyze.functions import facts, order_stats

PROBS = [0.0, 0.25, 0.5, 0.99, 1.0]


def tables():
    rng = np.random.default_rng(7)
    n = 3000
    hot = np.where(rng.random(n) < 0.35, 42.0, rng.normal(50, 20, n))
    return {
        "smooth": rng.normal(0, 1, n),
        "hot": hot,
        "few": rng.integers(0, 4, n).astype(float),
        "constant": np.full(n, 3.25),
        "skewed": np.exp(rng.normal(0, 3, n)),
        "gaps": np.where(rng.random(n) < 0.3, np.nan, rng.normal(0, 1, n)),
    }


@pytest.fixture(scope="module")
def sample():
    return pd.DataFrame(tables())


@pytest.fixture(scope="module")
def sample_df(spark, sample):
    return spark.createDataFrame(sample)


@pytest.mark.parametrize("limit, sketch_size", [(10_000, 1024), (100, 64)])
def test_quantiles_equal_pandas(sample_df, sample, limit, sketch_size):
    columns = list(sample.columns) if limit > 1000 else ["hot", "gaps"]
    found = order_stats.quantile_values(
        sample_df, columns, PROBS, limit=limit, sketch_size=sketch_size)
    for name in columns:
        assert found[name] == pytest.approx(sample[name].quantile(PROBS).tolist(), abs=1e-9)


@pytest.mark.parametrize("limit", [50, 10_000])
def test_quantiles_among_infinite_values(spark, limit):
    """Many rows of each infinity; ranks among them, beside them and between finite values."""
    values = [float("inf")] * 600 + [float("-inf")] * 300 + [float(i % 700) for i in range(2101)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    probs = [0.0, 0.05, 0.1, 0.3, 0.5, 0.79, 0.9, 1.0]
    found = order_stats.quantile_values(df, ["v"], probs, limit=limit)["v"]
    inf = float("inf")
    assert found == [-inf, -inf, 0.0, 199.0, 399.0, 689.0, inf, inf]
    only = spark.createDataFrame([(float("inf"),)] * 90, "v double")
    assert order_stats.quantile_values(only, ["v"], [0.5], limit=limit)["v"] == [float("inf")]


def test_facts_are_asked_once(spark, sample_df, sample):
    """Equal aggregates of two operators are one column of one job."""
    asks = [facts.Asked({"m": F.avg("smooth"), "n": F.count("hot")},
                        {"q": (F.col("hot"), [0.5])}),
            facts.Asked({"mean": F.avg("smooth")}, {"h": (F.col("hot"), [0.25, 0.5])})]
    merged = facts._Merged()
    assert [merged.add(a) for a in (F.avg("x"), F.avg("y"), F.avg("x"), F.lit(1), F.lit("1"))] \
        == [0, 1, 0, 2, 3]
    first, second = facts.answered(sample_df, *asks)
    assert first["m"] == second["mean"] == pytest.approx(sample["smooth"].mean())
    assert first["n"] == len(sample)
    assert second["h"] == pytest.approx(sample["hot"].quantile([0.25, 0.5]).tolist())
    assert first["q"] == second["h"][1:]
    assert facts.answered(sample_df) == []


def test_quantiles_take_two_jobs(spark, sample_df, monkeypatch):
    """One aggregation with sketches, one that ranks the few values around each quantile."""
    calls = []
    for name in ("_narrow", "_finish"):
        whole = getattr(facts, name)
        monkeypatch.setattr(facts, name, lambda *a, whole=whole, name=name:
                            calls.append(name) or whole(*a))
    order_stats.quantile_values(sample_df, ["smooth", "skewed"], [0.25, 0.5, 0.75], limit=500)
    assert calls == ["_finish"]


def test_sketches_leave_few_values_to_rank(spark, monkeypatch):
    """No pass in between up to 200 times the limit: the ranges are half a percent wide."""
    def narrowed(*a):
        raise AssertionError("a pass in between")

    monkeypatch.setattr(facts, "_narrow", narrowed)
    df = spark.range(100_000).select(
        ((F.col("id") * 7919) % 100_000).cast("double").alias("v"), (F.col("id") % 7).alias("few"))
    found = order_stats.quantile_values(df, ["v", "few"], [0.25, 0.5, 0.75], limit=500)
    assert found["v"] == [24999.75, 49999.5, 74999.25]
    assert found["few"] == [1.0, 3.0, 5.0]


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,), (None,)], "v double")
    assert order_stats.quantile_values(df, ["v"], [0.5]) == {"v": [None]}
    assert order_stats.quantile_values(df, ["v"], [0.5], limit=0) == {"v": [None]}
    one = spark.createDataFrame([(7.0,)], "v double")
    assert order_stats.quantile_values(one, ["v"], [0.1, 0.9], limit=0) == {"v": [7.0, 7.0]}


@settings(max_examples=12, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.integers(-5, 5) | st.floats(-1e6, 1e6), min_size=1, max_size=60))
def test_quantiles_of_any_list(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    found = order_stats.quantile_values(df, ["v"], [0.25, 0.5], limit=2, sketch_size=8)["v"]
    assert found == pytest.approx(list(np.quantile(np.array(values, float), [0.25, 0.5])),
                                  rel=1e-9, abs=1e-6)


@pytest.mark.parametrize("limit, buckets", [(10_000, None), (10, 1), (10, 8), (10, 200)])
def test_grouped_median_equals_pandas(spark, sample, limit, buckets):
    rng = np.random.default_rng(3)
    keys = np.where(rng.random(len(sample)) < 0.4, 0, rng.integers(0, 30, len(sample)))
    for name in ("hot", "gaps", "few", "smooth"):
        pdf = pd.DataFrame({"k": keys, "v": sample[name]})
        pdf = pd.concat([pdf, pd.DataFrame({"k": [99, 99], "v": [np.nan, np.nan]})])
        df = spark.createDataFrame(pdf)
        got = order_stats.grouped_median(df, ["k"], "v", "m", limit, buckets).toPandas()
        want = pdf.groupby("k")["v"].median()
        assert len(got) == len(want)
        pd.testing.assert_series_equal(
            got.set_index("k")["m"].sort_index(), want.rename("m"), check_index_type=False
        )


@pytest.mark.parametrize("buckets", [1, 4, 100])
def test_average_ranks_equal_pandas(spark, sample, buckets):
    pdf = sample[["smooth", "hot", "few", "constant"]]
    distinct = spark.createDataFrame(pdf).groupBy(*pdf.columns).agg(F.count("*").alias("n"))
    ranked, total = order_stats.add_average_ranks(distinct, list(pdf.columns), "n", buckets)
    assert total == len(pdf)
    got = ranked.toPandas()
    want = pdf.rank()
    for name in pdf.columns:
        by_value = dict(zip(pdf[name], want[name]))
        assert got[f"rank_{name}"].tolist() == [by_value[v] for v in got[name]]


def test_a_wrong_guess_is_noticed(sample_df, sample, monkeypatch):
    """Sketches only place the work: with useless ones the quantiles are the same."""
    monkeypatch.setattr(facts, "_even_quantiles", lambda v, size: F.array(*[F.lit(41.5)] * 257))
    found = order_stats.quantile_values(sample_df, ["smooth", "hot"], [0.5, 0.99], limit=500)
    for name in ("smooth", "hot"):
        want = sample[name].quantile([0.5, 0.99]).tolist()
        assert found[name] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("tree_rows", [10 ** 9, 0])
def test_open_buckets_stay_small(spark, sample, tree_rows):
    df = spark.createDataFrame(sample[["hot"]]).repartition(7)
    cuts = order_stats.bucket_cuts(df, ["hot"], 50, len(sample), tree_rows)
    placed = order_stats.with_buckets(df, cuts, {"hot": "b"})
    sizes = placed.groupBy("b").agg(
        F.count("*").alias("n"), F.min("hot").alias("lo"), F.max("hot").alias("hi")
    ).orderBy("b").toPandas()
    assert sizes.loc[sizes.b % 2 == 0, "n"].max() <= 3 * len(sample) / 50
    assert (sizes.lo.iloc[1:].values > sizes.hi.iloc[:-1].values).all()


def test_no_single_task_window_over_rows(lines):
    """Ranks and grouped medians of a large table never sort it in one task."""
    medians = order_stats.grouped_median(
        lines.select("l_suppkey", "l_extendedprice"), ["l_suppkey"], "l_extendedprice", "m",
        limit=10, buckets=8,
    )
    distinct = lines.groupBy("l_extendedprice").agg(F.count("*").alias("n"))
    ranked, _ = order_stats.add_average_ranks(distinct, ["l_extendedprice"], "n", 8)
    for df in (medians, ranked):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("sketch_size", [1024, 16])
def test_only_few_rows_reach_one_task(spark, monkeypatch, sketch_size):
    """Parts of unequal size, sorted values: what is ranked at the end stays about the limit."""
    big = spark.range(0, 30_000, 1, 1).select(F.col("id").cast("double").alias("v"))
    small = spark.range(30_000, 30_400, 1, 40).select(F.col("id").cast("double").alias("v"))
    df, n, limit = small.unionAll(big), 30_400, 500
    seen = []
    finish = facts._finish

    def watched(df, wanted, values):
        seen.extend((w.hi - w.lo) for w in wanted)
        finish(df, wanted, values)

    monkeypatch.setattr(facts, "_finish", watched)
    found = order_stats.quantile_values(df, ["v"], PROBS, limit, sketch_size)["v"]
    assert found == pytest.approx([p * (n - 1) for p in PROBS], abs=1e-6)
    assert all(width <= 2 * limit for width in seen)
