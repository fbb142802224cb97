import itertools

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st

from tabulyze.operators import correlation, kendall


@pytest.fixture(scope="module")
def numbers():
    rng = np.random.default_rng(42)
    x = rng.normal(0, 1, 500)
    return pd.DataFrame({
        "x": x, "y": 2 * x + rng.normal(0, 0.5, 500), "z": -1.5 * x + rng.normal(0, 1, 500),
        "w": rng.integers(0, 3, 500).astype(float), "flat": np.full(500, 0.1),
        "hot": np.where(rng.random(500) < 0.4, 7.0, rng.normal(0, 1, 500)),
    })


@pytest.fixture(scope="module")
def gappy(numbers):
    rng = np.random.default_rng(1)
    return numbers.mask(pd.DataFrame(rng.random(numbers.shape) < 0.1, columns=numbers.columns))


def as_pairs(df):
    return {(r.variable1, r.variable2): r.r for r in df.collect()}


def expect(pairs, pdf, method):
    want = pdf.corr(method=method)
    for a, b in itertools.combinations(pdf.columns, 2):
        if pd.isna(want.loc[a, b]):
            assert pairs[a, b] is None, (a, b)
        else:
            assert pairs[a, b] == pytest.approx(want.loc[a, b], abs=1e-9), (a, b)
    assert len(pairs) == len(pdf.columns) * (len(pdf.columns) - 1) // 2


@pytest.mark.parametrize("wide", [1000, 0])
def test_pearson(spark, numbers, gappy, wide):
    for pdf in (numbers, gappy):
        expect(as_pairs(correlation.correlation_pairs(spark.createDataFrame(pdf), wide=wide)),
               pdf, "pearson")


def test_pearson_of_large_offsets(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"a": 1e9 + rng.normal(0, 1, 200), "b": -1e9 + rng.normal(0, 1, 200)})
    for wide in (1000, 0):
        pairs = correlation.correlation_pairs(spark.createDataFrame(pdf), wide=wide)
        assert as_pairs(pairs)["a", "b"] == pytest.approx(pdf.corr().iloc[0, 1], abs=1e-6)


@pytest.mark.parametrize("buckets", [None, 1, 20])
def test_spearman(spark, numbers, gappy, buckets):
    kept = ["x", "z", "w", "flat", "hot"]
    df = spark.createDataFrame(numbers[kept])
    expect(as_pairs(correlation.correlation_pairs(df, method="spearman", buckets=buckets)),
           numbers[kept].rank(), "pearson")


@pytest.mark.parametrize("buckets", [None, 1, 20])
def test_spearman_with_gaps(spark, gappy, buckets):
    kept = gappy[["x", "w", "hot"]]
    pairs = as_pairs(correlation.correlation_pairs(
        spark.createDataFrame(kept), method="spearman", buckets=buckets))
    for a, b in itertools.combinations(kept.columns, 2):
        both = kept[[a, b]].dropna().rank()
        assert pairs[a, b] == pytest.approx(both.corr().iloc[0, 1], abs=1e-9)


def test_pairs_without_common_rows(spark):
    df = spark.createDataFrame(
        [(1.0, None, 3.0), (2.0, None, 1.0), (None, 4.0, 9.0), (None, 5.0, 9.0)],
        "a double, b double, c double")
    for method in ("spearman", "kendall"):
        pairs = as_pairs(correlation.correlation_pairs(df, method=method))
        assert pairs == {("a", "b"): None, ("a", "c"): pytest.approx(-1.0), ("b", "c"): None}


@pytest.mark.parametrize("method", ["spearman", "kendall"])
def test_jobs_do_not_grow_with_the_pairs(spark, method):
    rng = np.random.default_rng(5)
    values = rng.normal(0, 1, (60, 30))
    values[rng.random(values.shape) < 0.2] = np.nan
    df = spark.createDataFrame(pd.DataFrame(values, columns=[f"c{i}" for i in range(30)]))
    context, group = spark.sparkContext, f"build-{method}"
    context.setJobGroup(group, group)
    correlation.correlation_pairs(df, method=method)
    jobs = context.statusTracker().getJobIdsForGroup(group)
    context.setJobGroup("", "")
    assert len(jobs) < 10


def tau_b(x, y):
    s = ties_x = ties_y = 0
    n = len(x)
    for i in range(n):
        dx, dy = np.sign(x[i + 1:] - x[i]), np.sign(y[i + 1:] - y[i])
        s += (dx * dy).sum()
        ties_x += (dx == 0).sum()
        ties_y += (dy == 0).sum()
    total = n * (n - 1) / 2
    scale = np.sqrt((total - ties_x) * (total - ties_y))
    return s / scale if scale else None


@pytest.mark.parametrize("rows_per_bucket", [10 ** 9, 100, 7])
@pytest.mark.parametrize("a, b", [("x", "y"), ("x", "w"), ("hot", "w"), ("z", "hot"), ("x", "flat")])
def test_kendall(spark, numbers, a, b, rows_per_bucket):
    df = spark.createDataFrame(numbers[[a, b]])
    got = kendall.kendall_pair(df, a, b, rows_per_bucket).first().r
    want = tau_b(numbers[a].to_numpy(), numbers[b].to_numpy())
    assert got == (None if want is None else pytest.approx(want, abs=1e-12))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6), st.integers(1, 3)), max_size=40))
def test_discordant_counts_pairs(rows):
    x, y, n = (np.array([r[i] for r in rows], dtype=float) for i in range(3))
    want = sum(
        n[i] * n[j] for i in range(len(rows)) for j in range(len(rows))
        if x[i] < x[j] and y[i] > y[j]
    )
    assert kendall.discordant(x, y, n) == want


@settings(max_examples=6, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=2, max_size=60))
def test_kendall_of_any_rows(spark, rows):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in rows], "a double, b double")
    got = kendall.kendall_pair(df, "a", "b", rows_per_bucket=3).first().r
    want = tau_b(*(np.array([r[i] for r in rows], dtype=float) for i in range(2)))
    assert got == (None if want is None else pytest.approx(want, abs=1e-12))


def test_matrix(spark, numbers):
    df = spark.createDataFrame(numbers[["x", "y", "flat"]])
    cells = as_pairs(correlation.correlation_matrix(df))
    assert len(cells) == 9
    assert cells["x", "x"] == 1.0 and cells["flat", "flat"] is None
    assert cells["x", "y"] == cells["y", "x"] and cells["x", "flat"] is None
    with pytest.raises(ValueError, match="at least 2 numerical columns"):
        correlation.correlation_matrix(df.select("x"))
    with pytest.raises(ValueError, match="Unsupported method"):
        correlation.correlation_pairs(df, method="cosine")
    assert correlation.correlation_pairs(df.select("x")).count() == 0


def test_strong_pairs(spark, numbers):
    df = spark.createDataFrame(numbers[["x", "y", "z", "w"]])
    rows = correlation.strong_pairs(df).collect()
    assert [(r.variable1, r.variable2) for r in rows] == [("x", "y"), ("x", "z"), ("y", "z")]
    assert [r.direction for r in rows] == ["positive", "negative", "negative"]
    assert rows[0].strength == "very strong" and rows[0].pairs_analyzed == 6
    assert rows[0].strong_found == 3
    assert len(correlation.strong_pairs(df, limit=1).collect()) == 1
    assert correlation.strong_pairs(df, threshold=0.999).count() == 0
