"""Exact quantiles, grouped medians and average ranks without a one-task sort.

Quantiles of columns are those of `facts`. For medians and ranks by group Spark's `median` keeps
every distinct value of a group in one task, and a global `rank` window sends all rows to one task.
The first is used here only below a measured size. Beyond it the value axis is cut at approximate
quantiles, counted per bucket, and only rows of the bucket that holds the wanted rank are looked
at. Results stay exact: the cuts decide how work is split, never what is returned.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabulyze.functions.columns import as_double, col, nan_to_null
from tabulyze.functions.facts import SKETCH_SIZE, VALUE_LIMIT, Asked, answered

# Most rows of a group whose median is found by one aggregate.
GROUP_LIMIT = 200_000

# Rows beyond which sketches are merged in two levels, the tasks of the first level, and the
# quantiles each of them hands on.
TREE_ROWS = 50_000_000
TREE_PARTS = 512
TREE_GRID = 1000
# Most cuts per value axis, and the rows aimed at between two cuts.
BUCKETS = 4096
ROWS_PER_BUCKET = 100_000


def _even(points: int) -> list[float]:
    return [i / points for i in range(points + 1)]


def _scan(
    df: DataFrame,
    facts: Sequence[tuple[str, Column]],
    sketches: Sequence[tuple[Column, Sequence[float]]],
    rows: int,
    accuracy: int,
    tree_rows: int,
) -> tuple[list, list[list[float] | None]]:
    """Counts, minima and maxima next to approximate quantiles, from one pass.

    Facts are ("count" | "min" | "max", column). Every scan task hands on a sketch of up to
    some hundred KB. Beyond `tree_rows` rows these are merged by TREE_PARTS tasks instead of
    one, and the last task sees only an even grid of weighted quantiles from each.
    """
    merge = {"count": F.count, "min": F.min, "max": F.max}
    asks = [merge[kind](c).alias(f"f{i}") for i, (kind, c) in enumerate(facts)]
    if rows <= tree_rows or not sketches:
        asks += [
            F.percentile_approx(c, doubles(shares), accuracy).alias(f"q{i}")
            for i, (c, shares) in enumerate(sketches)
        ]
        row = df.agg(*asks).first()
    else:
        grid = max([TREE_GRID, *[len(shares) for _, shares in sketches]])
        asks += [
            F.struct(
                F.lit(i).alias("i"),
                F.percentile_approx(c, doubles(_even(grid)), 2 * grid).alias("q"),
                # Every part hands on as many points, so each weighs as the part has rows.
                F.count(c).alias("w"),
            ).alias(f"s{i}")
            for i, (c, _) in enumerate(sketches)
        ]
        parts = df.withColumn("__part", F.spark_partition_id() % TREE_PARTS)
        known = [f"f{i}" for i in range(len(facts))]
        points = (
            parts.groupBy("__part").agg(*asks)
            .select(*known, F.inline(F.array(*[F.col(f"s{i}") for i in range(len(sketches))])))
            .select(*known, "i", "w", F.posexplode_outer("q").alias("at", "v"))
        )
        # Facts are repeated on every point of a part; one of them counts.
        once = (F.col("i") == 0) & F.coalesce(F.col("at") == 0, F.lit(True))
        again = {"count": F.sum, "min": F.min, "max": F.max}
        row = points.agg(
            *[
                again[kind](F.when(once, F.col(f"f{i}"))).alias(f"f{i}")
                for i, (kind, _) in enumerate(facts)
            ],
            *[
                F.percentile(
                    F.when(F.col("i") == i, F.col("v")), doubles(shares), F.col("w")
                ).alias(f"q{i}")
                for i, (_, shares) in enumerate(sketches)
            ],
        ).first()
    return (
        [row[f"f{i}"] for i in range(len(facts))],
        [row[f"q{i}"] for i in range(len(sketches))],
    )


def quantile_values(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    limit: int = VALUE_LIMIT,
    sketch_size: int = SKETCH_SIZE,
) -> dict[str, list[float | None]]:
    """Exact interpolated quantiles as numbers, one list per column; see `facts`."""
    if not columns:
        return {}
    asked = Asked(quantiles={f"q{i}": (as_double(c), probs) for i, c in enumerate(columns)})
    found = answered(df, asked, limit=limit, sketch_size=sketch_size)[0]
    return {c: found[f"q{i}"] for i, c in enumerate(columns)}


def exact_quantiles(
    df: DataFrame,
    column: str,
    probs: Sequence[float] = (0.25, 0.5, 0.75),
    limit: int = VALUE_LIMIT,
    sketch_size: int = SKETCH_SIZE,
) -> DataFrame:
    """One row (`p`, `quantile`) per asked probability."""
    values = quantile_values(df, [column], probs, limit, sketch_size)[column]
    pairs = F.array(
        *[
            F.struct(F.lit(float(p)).alias("p"), F.lit(v).cast("double").alias("quantile"))
            for p, v in zip(probs, values)
        ]
    )
    return df.sparkSession.range(1).select(F.inline(pairs))


def approximate_quantiles(
    df: DataFrame, column: str, probs: Sequence[float], accuracy: int
) -> DataFrame:
    """Sketch quantiles for callers who ask for an accuracy instead of exact values."""
    clean = nan_to_null(df.select(col(column)))
    row = clean.agg(
        F.arrays_zip(
            F.lit([float(p) for p in probs]).alias("p"),
            F.percentile_approx(as_double(column), list(probs), accuracy).alias("quantile"),
        ).alias("z")
    )
    return row.select(F.inline("z")).toDF("p", "quantile")


def buckets_for(rows: int, most: int = BUCKETS) -> int:
    """Enough buckets to keep each near ROWS_PER_BUCKET rows, within [1, most]."""
    return max(1, min(most, rows // ROWS_PER_BUCKET))


def doubles(values: Sequence[float]) -> Column:
    """A constant array<double>, sent to the JVM as one text."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def longs(values: Sequence[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def bucket_cuts(
    df: DataFrame,
    columns: Sequence[str],
    buckets: int,
    rows: int = 0,
    tree_rows: int = TREE_ROWS,
) -> dict[str, list[float]]:
    """Increasing cut values per column, at most `buckets` + 1 of them, from one pass."""
    asks = [(as_double(c), _even(buckets)) for c in columns]
    _, grids = _scan(df, [], asks, rows, max(1000, 10 * buckets), tree_rows)
    return {
        c: sorted({x for x in grid or [] if math.isfinite(x)}) for c, grid in zip(columns, grids)
    }


def with_buckets(
    df: DataFrame, cuts: dict[str, Sequence[float]], outs: dict[str, str]
) -> DataFrame:
    """Add the bucket number of each column in `outs`, increasing with the value.

    Odd numbers hold exactly one value, a cut; even numbers hold the open range between two
    cuts. A value frequent enough to make a bucket large is always a cut, so open buckets
    have a bounded row count. Columns are doubles without missing values.
    """
    cut = [c for c in outs if cuts[c]]
    whole = {out: F.lit(0) for c, out in outs.items() if not cuts[c]}
    placed = df.withColumns(whole) if whole else df
    if not cut:
        return placed
    infinity = float("inf")
    placed = Bucketizer(
        splitsArray=[[-infinity, *cuts[c], infinity] for c in cut],
        inputCols=cut, outputCols=[f"__at_{c}" for c in cut], handleInvalid="keep",
    ).transform(placed)
    numbers = {}
    for c in cut:
        # `at` counts the cuts that are not above the value.
        at = F.col(f"__at_{c}").cast("int")
        on_cut = (at > 0) & (F.col(c) == F.get(doubles(cuts[c]), at - 1))
        numbers[outs[c]] = F.when(on_cut, at * 2 - 1).otherwise(at * 2)
    return placed.withColumns(numbers).drop(*[f"__at_{c}" for c in cut])


def grouped_median(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    out: str,
    limit: int = GROUP_LIMIT,
    buckets: int | None = None,
) -> DataFrame:
    """Exact median per key. Keys and values must already be free of missing keys.

    Groups up to `limit` rows use the `median` aggregate; when a larger group exists, all go
    through (key, bucket) counts so that no task holds a whole group.
    """
    names = [col(k) for k in keys]
    rows = nan_to_null(df.select(*names, as_double(value).alias("v")))
    total = df.count()
    if total <= limit:
        largest = 0
    else:
        sizes = rows.groupBy(*names).agg(F.count("v").alias("n"))
        largest = sizes.agg(F.max("n")).first()[0] or 0
    if largest <= limit:
        return rows.groupBy(*names).agg(F.median("v").alias(out))

    cuts = bucket_cuts(rows, ["v"], buckets or buckets_for(total), total)["v"]
    axis = doubles(cuts)
    filled = with_buckets(rows.filter(F.col("v").isNotNull()), {"v": cuts}, {"v": "b"})
    by_key = W.partitionBy(*names)
    upto_bucket = by_key.orderBy("b").rowsBetween(W.unboundedPreceding, W.currentRow)
    targets = (
        filled.groupBy(*names, "b")
        .agg(F.count("*").alias("n"))
        .withColumn("upto", F.sum("n").over(upto_bucket))
        .withColumn("total", F.sum("n").over(by_key))
        .withColumn("before", F.col("upto") - F.col("n"))
        .withColumn("k0", F.floor((F.col("total") - 1) / 2))
        .withColumn("k1", F.floor(F.col("total") / 2))
        .filter((F.col("upto") > F.col("k0")) & (F.col("before") <= F.col("k1")))
        .drop("n", "total")
    )
    single = F.col("b") % 2 == 1
    points = targets.filter(single).select(
        *names, F.get(axis, F.expr("(b - 1) div 2").cast("int")).alias("v"),
        F.col("before").alias("from"), "upto", "k0", "k1",
    )
    upto_value = W.partitionBy(*names, "b").orderBy("v").rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    ranged = (
        filled.filter(~single)
        .join(targets.filter(~single).drop("upto"), [*keys, "b"])
        .groupBy(*names, "b", "v", "before", "k0", "k1")
        .agg(F.count("*").alias("n"))
        .withColumn("upto", F.col("before") + F.sum("n").over(upto_value))
        .withColumn("from", F.col("upto") - F.col("n"))
        .select(*names, "v", "from", "upto", "k0", "k1")
    )

    def holds(k: str) -> Column:
        return (F.col("from") <= F.col(k)) & (F.col(k) < F.col("upto"))

    medians = (
        points.unionByName(ranged)
        .groupBy(*names)
        .agg(
            ((F.max(F.when(holds("k0"), F.col("v"))) + F.max(F.when(holds("k1"), F.col("v")))) / 2)
            .alias(out)
        )
    )
    empty = (
        rows.groupBy(*names).agg(F.count("v").alias("n")).filter("n = 0")
        .select(*names, F.lit(None).cast("double").alias(out))
    )
    return medians.unionByName(empty)


def add_average_ranks(
    df: DataFrame, columns: Sequence[str], weight: str, buckets: int, rows: int = 0
) -> tuple[DataFrame, int]:
    """Add `rank_<column>`, the average rank of the value among all weighted rows.

    Returns the ranked rows and the total weight.

    `df` holds distinct rows with a repeat count, so copies are already folded together.
    Each column costs one shuffle on its bucket number. Rows whose value fills a bucket alone
    get their rank from bucket totals and are spread by a hash of the row.
    """
    cuts = bucket_cuts(df, columns, buckets, rows)
    outs = {c: f"__b{i}" for i, c in enumerate(columns)}
    tagged = F.explode(
        F.array(*[F.struct(F.lit(i).alias("i"), F.col(f"__b{i}").alias("b"))
                  for i in range(len(columns))])
    )
    totals = (
        with_buckets(df, cuts, outs).select(col(weight).alias("w"), tagged.alias("s"))
        .groupBy("s.i", "s.b").agg(F.sum("w").alias("n"))
        .collect()  # at most 2 * buckets + 3 rows per column
    )
    ranked = df
    base = [col(c) for c in df.columns]
    for i, name in enumerate(columns):
        width = 2 * len(cuts[name]) + 1
        sizes = [0] * width
        for row in totals:
            if row["i"] == i:
                sizes[row["b"]] = row["n"]
        before = [0] * width
        for b in range(1, width):
            before[b] = before[b - 1] + sizes[b - 1]
        start = F.get(longs(before), F.col("__b"))
        size = F.get(longs(sizes), F.col("__b"))
        single = F.col("__b") % 2 == 1
        part = W.partitionBy("__b", "__salt")
        upto = part.orderBy(col(name)).rangeBetween(W.unboundedPreceding, W.currentRow)
        ties = F.sum(col(weight)).over(
            part.orderBy(col(name)).rangeBetween(W.currentRow, W.currentRow)
        )
        ranked = (
            with_buckets(ranked, cuts, {name: "__b"})
            .withColumn("__salt", F.when(single, F.pmod(F.xxhash64(*base), F.lit(1024))).otherwise(0))
            .withColumn("__upto", F.sum(col(weight)).over(upto))
            .withColumn("__ties", ties)
            .withColumn(
                f"rank_{name}",
                F.when(single, start + (size + 1) / 2)
                .otherwise(start + F.col("__upto") - F.col("__ties") + (F.col("__ties") + 1) / 2),
            )
            .drop("__b", "__salt", "__upto", "__ties")
        )
    return ranked, sum(row["n"] for row in totals if row["i"] == 0)
