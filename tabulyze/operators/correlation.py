"""Pearson, Spearman and Kendall correlation over pairs of numeric columns.

Every method gives the pair frame `variable1`, `variable2`, `r` (upper triangle, column
order). A constant column has no correlation: r is NULL.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabulyze.functions.columns import as_double, col, nan_to_null, numeric_columns
from tabulyze.functions.moments import pearson
from tabulyze.functions.order_stats import add_average_ranks, buckets_for
from tabulyze.operators.kendall import kendall_of_pairs
from tabulyze.operators.pairwise import spearman_of_pairs
from tabulyze.operators.roles import require_columns

METHODS = ("pearson", "spearman", "kendall")
PAIR_SCHEMA = "variable1 string, variable2 string, r double"
# Pairs whose aggregates go into one job. Spark generates code for up to 100 fields; a pair
# takes one, or about twenty where values are missing.
PAIRS_PER_JOB = 60
GAP_PAIRS_PER_JOB = 30
# Pairs beyond which one matrix pass is cheaper than several aggregate passes.
WIDE_PAIRS = 60
TOO_FEW = "Need at least 2 numerical columns for correlation heatmap"
STRONG_LIMIT = 10


def _selected(df: DataFrame, columns: Sequence[str] | None) -> tuple[DataFrame, list[str]]:
    if columns:
        require_columns(df, columns)
    names = numeric_columns(df, columns or None)
    return nan_to_null(df.select(*[as_double(c).alias(c) for c in names])), names


def _pair_rows(values: list[tuple[str, str, Column]]) -> Column:
    return F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(a).alias("variable1"), F.lit(b).alias("variable2"),
                    r.cast("double").alias("r"),
                )
                for a, b, r in values
            ]
        )
    )


def _centred(rows: DataFrame, names: list[str]) -> tuple[DataFrame, set[str], set[str]]:
    """Columns less their means; the names with missing values; the names that vary.

    One job over all columns. Sums of centred values keep their digits.
    """
    asks = []
    for i, c in enumerate(names):
        asks += [F.avg(col(c)).alias(f"m{i}"), F.count_if(col(c).isNull()).alias(f"g{i}"),
                 (F.min(col(c)) < F.max(col(c))).alias(f"v{i}")]
    row = rows.agg(*asks).first()
    centred = rows.select(
        *[(col(c) - F.lit(row[f"m{i}"]).cast("double")).alias(c) for i, c in enumerate(names)]
    )
    gaps = {c for i, c in enumerate(names) if row[f"g{i}"]}
    varied = {c for i, c in enumerate(names) if row[f"v{i}"]}
    return centred, gaps, varied


def _batched(rows: DataFrame, pairs: list[tuple[str, str]], gaps: set[str]) -> DataFrame:
    """Pearson by sums, few enough per job to stay in one generated loop."""
    size = GAP_PAIRS_PER_JOB if gaps else PAIRS_PER_JOB
    batches = []
    for at in range(0, len(pairs), size):
        batch = pairs[at:at + size]
        squares = {
            c: F.sum(col(c) * col(c)) for c in dict.fromkeys(n for p in batch for n in p)
            if c not in gaps
        }
        at_square = {c: f"s{i}" for i, c in enumerate(squares)}
        asks = [v.alias(at_square[c]) for c, v in squares.items()]
        out = []
        for i, (a, b) in enumerate(batch):
            if a in gaps or b in gaps:
                asks.append(pearson(col(a), col(b)).alias(f"r{i}"))
                out.append((a, b, F.col(f"r{i}")))
                continue
            asks.append(F.sum(col(a) * col(b)).alias(f"x{i}"))
            scale = F.sqrt(F.col(at_square[a])) * F.sqrt(F.col(at_square[b]))
            out.append((a, b, F.try_divide(F.col(f"x{i}"), scale)))
        batches.append(rows.agg(*asks).select(_pair_rows(out)))
    return reduce(DataFrame.unionByName, batches)


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Values of a batch, 0 where missing, and which are present."""
    x = np.column_stack(
        [c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns]
    )
    present = ~np.isnan(x)
    return np.where(present, x, 0.0), present


def _pair_means(rows: DataFrame, k: int) -> np.ndarray:
    """[a, b]: the mean of column a over the rows where a and b are present. One row per pair
    of columns reaches the driver."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, plain = np.zeros((k, k)), np.zeros((k, k))
        for batch in batches:
            x, present = _matrix(batch)
            m = present.astype(np.float64)
            count += m.T @ m
            plain += x.T @ m
        yield pa.RecordBatch.from_pydict({
            "cell": np.arange(k * k, dtype=np.int32), "n": count.ravel(), "s": plain.ravel(),
        })

    cells = rows.mapInArrow(add_up, "cell int, n double, s double").groupBy("cell").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    means = np.zeros(k * k)
    for r in cells:
        means[r["cell"]] = r["s"] / r["n"] if r["n"] else 0.0
    return means.reshape(k, k)


def _gram(
    rows: DataFrame, names: list[str], pairs: list[tuple[str, str]], gaps: set[str]
) -> DataFrame:
    """Pearson for wide tables: each task adds up products of its batches.

    Values are taken less their mean over the rows of the pair, so sums keep their digits
    whatever lies on other rows. Without gaps that is the mean of the column, which the rows are
    centred by, and matrix products do; with gaps one more pass finds the means of the pairs. A
    task emits one row per pair, so the shuffle carries tasks x pairs rows whatever the table size.
    """
    k = len(names)
    at = {c: i for i, c in enumerate(names)}
    left = np.array([at[a] for a, _ in pairs])
    right = np.array([at[b] for _, b in pairs])
    means = _pair_means(rows, k) if gaps else np.zeros((k, k))
    sums = ("n", "sa", "sb", "saa", "sbb", "sab")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {f: np.zeros((k, k)) for f in sums}
        low, high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
        for batch in batches:
            x, present = _matrix(batch)
            if not gaps:
                ones = np.ones_like(x)
                total["n"] += len(x)
                total["sa"] += x.T @ ones
                total["saa"] += (x * x).T @ ones
                total["sab"] += x.T @ x
                low = np.minimum(low, x.min(axis=0, initial=np.inf)[:, None])
                high = np.maximum(high, x.max(axis=0, initial=-np.inf)[:, None])
                continue
            for a in range(k):
                both = present & present[:, [a]]
                own = np.where(both, x[:, [a]] - means[a], 0.0)
                other = np.where(both, x - means[:, a], 0.0)
                total["n"][a] += both.sum(axis=0)
                total["sa"][a] += own.sum(axis=0)
                total["saa"][a] += (own * own).sum(axis=0)
                total["sab"][a] += (own * other).sum(axis=0)
                value = x[:, [a]]
                low[a] = np.minimum(
                    low[a], np.where(both, value, np.inf).min(axis=0, initial=np.inf))
                high[a] = np.maximum(
                    high[a], np.where(both, value, -np.inf).max(axis=0, initial=-np.inf))
        yield pa.RecordBatch.from_pydict({
            "pair": np.arange(len(pairs), dtype=np.int32),
            "n": total["n"][left, right],
            "sa": total["sa"][left, right], "sb": total["sa"][right, left],
            "saa": total["saa"][left, right], "sbb": total["saa"][right, left],
            "sab": total["sab"][left, right],
            "la": low[left, right], "ha": high[left, right],
            "lb": low[right, left], "hb": high[right, left],
        })

    schema = "pair int, " + ", ".join(f"{f} double" for f in (*sums, "la", "ha", "lb", "hb"))
    summed = rows.mapInArrow(add_up, schema).groupBy("pair").agg(
        *[F.sum(f).alias(f) for f in sums],
        *[F.min(f).alias(f) for f in ("la", "lb")], *[F.max(f).alias(f) for f in ("ha", "hb")],
    )
    n, sa, sb = F.col("n"), F.col("sa"), F.col("sb")
    va = F.col("saa") - F.try_divide(sa * sa, n)
    vb = F.col("sbb") - F.try_divide(sb * sb, n)
    cab = F.col("sab") - F.try_divide(sa * sb, n)
    varies = (F.col("la") < F.col("ha")) & (F.col("lb") < F.col("hb"))
    r = F.when(varies, F.try_divide(cab, F.sqrt(va) * F.sqrt(vb)))
    named = F.array(
        *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs]
    )
    return summed.withColumn("p", F.get(named, F.col("pair"))).select(
        F.col("p.a").alias("variable1"), F.col("p.b").alias("variable2"), r.alias("r")
    )


def _pearson_pairs(
    rows: DataFrame, names: list[str], pairs: list[tuple[str, str]], wide: int
) -> DataFrame:
    centred, gaps, varied = _centred(rows, names)
    sound = [(a, b) for a, b in pairs if a in varied and b in varied]
    parts = []
    if sound:
        used = [c for c in names if c in varied]
        if len(sound) > wide:
            parts.append(_gram(centred.select(*map(col, used)), used, sound,
                               gaps & set(used)))
        else:
            parts.append(_batched(centred, sound, gaps))
    constant = [(a, b, None) for a, b in pairs if a not in varied or b not in varied]
    if constant:
        parts.append(rows.sparkSession.createDataFrame(constant, PAIR_SCHEMA))
    return reduce(DataFrame.unionByName, parts)


def _spearman_complete(
    rows: DataFrame, names: list[str], pairs: list[tuple[str, str]], buckets: int | None
) -> DataFrame:
    """Pairs of columns without missing values: each column is ranked once for all pairs."""
    plain = {c: f"c{i}" for i, c in enumerate(names)}
    distinct = rows.groupBy(*[col(c).alias(plain[c]) for c in names]).agg(F.count("*").alias("n"))
    size = rows.count()
    ranked, total = add_average_ranks(
        distinct, list(plain.values()), "n", buckets or buckets_for(size), size
    )
    # The mean rank is (rows + 1) / 2 for every column; taking it off first keeps digits.
    spread = {c: F.col(f"rank_{plain[c]}") - (total + 1) / 2 for c in names}
    n = F.col("n").cast("double")
    at = {c: i for i, c in enumerate(names)}
    sums = [F.sum(n * spread[c] * spread[c]).alias(f"s{at[c]}") for c in names]
    sums += [F.sum(n * spread[a] * spread[b]).alias(f"x{at[a]}_{at[b]}") for a, b in pairs]
    one = ranked.agg(*sums)

    def coefficient(a: str, b: str) -> Column:
        scale = F.sqrt(F.col(f"s{at[a]}")) * F.sqrt(F.col(f"s{at[b]}"))
        return F.try_divide(F.col(f"x{at[a]}_{at[b]}"), scale)

    return one.select(_pair_rows([(a, b, coefficient(a, b)) for a, b in pairs]))


def _spearman_pairs(
    rows: DataFrame, names: list[str], pairs: list[tuple[str, str]], buckets: int | None
) -> DataFrame:
    """Ranks are taken over the rows complete in both columns of a pair."""
    counts = rows.agg(*[F.count_if(col(c).isNull()) for c in names], F.count("*")).first()
    missing = {c for c, n in zip(names, counts) if n}
    whole = [c for c in names if c not in missing]
    clean = [(a, b) for a, b in pairs if a not in missing and b not in missing]
    parts = []
    if clean:
        parts.append(_spearman_complete(rows.select(*map(col, whole)), whole, clean, buckets))
    if gappy := [(a, b) for a, b in pairs if a in missing or b in missing]:
        size = counts[-1]
        parts.append(spearman_of_pairs(rows, gappy, buckets or buckets_for(size), size))
    return reduce(DataFrame.unionByName, parts)


def correlation_pairs(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    method: str = "pearson",
    buckets: int | None = None,
    wide: int = WIDE_PAIRS,
) -> DataFrame:
    """`variable1`, `variable2`, `r` for each pair; no rows below two numeric columns."""
    if method not in METHODS:
        raise ValueError(f"Unsupported method: {method}")
    rows, names = _selected(df, columns)
    pairs = list(combinations(names, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], PAIR_SCHEMA)
    if method == "spearman":
        return _spearman_pairs(rows, names, pairs, buckets)
    if method == "kendall":
        return kendall_of_pairs(rows, pairs)
    return _pearson_pairs(rows, names, pairs, wide)


def correlation_matrix(
    df: DataFrame, columns: Sequence[str] | None = None, method: str = "pearson"
) -> DataFrame:
    """Every cell as `variable1`, `variable2`, `r`; the diagonal is 1, NULL if constant."""
    rows, names = _selected(df, columns)
    if len(names) < 2:
        raise ValueError(TOO_FEW)
    pairs = correlation_pairs(df, columns, method)
    both = pairs.select(
        F.inline(
            F.array(
                F.struct("variable1", "variable2", "r"),
                F.struct(
                    F.col("variable2").alias("variable1"),
                    F.col("variable1").alias("variable2"), "r",
                ),
            )
        )
    )
    spread = rows.agg(
        *[
            F.when(F.min(col(c)) < F.max(col(c)), F.lit(1.0)).alias(f"r{i}")
            for i, c in enumerate(names)
        ]
    )
    diagonal = spread.select(_pair_rows([(c, c, F.col(f"r{i}")) for i, c in enumerate(names)]))
    return both.unionByName(diagonal)


def strength_label(r: Column) -> Column:
    size = F.abs(r)
    return (
        F.when(size >= 0.9, "very strong").when(size >= 0.7, "strong")
        .when(size >= 0.5, "moderate").when(size >= 0.3, "weak").otherwise("very weak")
    )


def with_strength(pairs: DataFrame) -> DataFrame:
    """Add `strength` and `direction` to a pair frame."""
    return pairs.withColumns(
        {
            "strength": F.when(F.col("r").isNotNull(), strength_label(F.col("r"))),
            "direction": F.when(F.col("r") > 0, "positive").when(F.col("r") <= 0, "negative"),
        }
    )


def strong_pairs(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    threshold: float = 0.7,
    method: str = "pearson",
    limit: int = STRONG_LIMIT,
) -> DataFrame:
    """Pairs with |r| >= threshold, strongest first, at most `limit` of them listed.

    `pairs_analyzed` and `strong_found` count all pairs, listed or not.
    """
    pairs = correlation_pairs(df, columns, method)
    size = F.abs("r")
    # All pairs of the schema, a few thousand rows at most.
    every = W.partitionBy()
    counted = pairs.withColumns(
        {
            "pairs_analyzed": F.count("*").over(every),
            "strong_found": F.count(F.when(size >= threshold, 1)).over(every),
        }
    )
    return (
        with_strength(counted.filter(size >= threshold))
        .select("variable1", "variable2", "r", "strength", "direction", "pairs_analyzed",
                "strong_found")
        .orderBy(size.desc(), "variable1", "variable2")
        .limit(limit)
    )
