"""Rows of many pairs of columns in one frame, the pair being a key column.

Columns with missing values have rows of their own in every pair. All pairs share the cuts of their
columns, so what takes a job before the plan stands does not grow with the number of pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tabulyze.functions.columns import col
from tabulyze.functions.order_stats import bucket_cuts, with_buckets

Pairs = Sequence[tuple[str, str]]
SALTS = 1024


def pair_rows(rows: DataFrame, pairs: Pairs, buckets: int, size: int) -> DataFrame:
    """`p`, `x`, `y`, `xb`, `yb`, `n`: distinct complete values of pair `p`, their buckets, copies.

    `rows` holds doubles, NULL where missing. One job finds the cuts.
    """
    names = list(dict.fromkeys(c for pair in pairs for c in pair))
    at = {c: i for i, c in enumerate(names)}
    plain = rows.select(*[col(c).alias(f"v{i}") for c, i in at.items()])
    values = plain.columns
    cuts = bucket_cuts(plain, values, buckets, size) if buckets > 1 else dict.fromkeys(values, [])
    # Only buckets of present values are read below.
    filled = plain.withColumns({f"f{i}": F.coalesce(f"v{i}", F.lit(0.0)) for i in at.values()})
    placed = with_buckets(
        filled, {f"f{i}": cuts[f"v{i}"] for i in at.values()},
        {f"f{i}": f"b{i}" for i in at.values()})
    both = [
        F.when(
            F.col(f"v{at[a]}").isNotNull() & F.col(f"v{at[b]}").isNotNull(),
            F.struct(F.lit(p).alias("p"), F.col(f"v{at[a]}").alias("x"),
                     F.col(f"v{at[b]}").alias("y"), F.col(f"b{at[a]}").alias("xb"),
                     F.col(f"b{at[b]}").alias("yb")))
        for p, (a, b) in enumerate(pairs)
    ]
    return (
        placed.select(F.inline(F.array_compact(F.array(*both))))
        .groupBy("p", "x", "y", "xb", "yb").agg(F.count("*").alias("n"))
    )


def named_pairs(found: DataFrame, pairs: Pairs) -> DataFrame:
    """`variable1`, `variable2`, `r` of all pairs from `p` and `r`; NULL for pairs without rows."""
    listed = [F.struct(F.lit(p).alias("p"), F.lit(a).alias("variable1"),
                       F.lit(b).alias("variable2")) for p, (a, b) in enumerate(pairs)]
    every = found.sparkSession.range(1).select(F.inline(F.array(*listed)))
    # One row per pair of columns of the schema.
    return every.join(F.broadcast(found), "p", "left").select("variable1", "variable2", "r")


def _with_rank_inside(rows: DataFrame, value: str, bucket: str, out: str) -> DataFrame:
    """Average rank among the rows of the same open bucket; 0 where a bucket is one value.

    Open buckets have a bounded row count; rows of one value are spread, their rank follows from
    the totals.
    """
    single = F.col(bucket) % 2 == 1
    part = W.partitionBy("p", bucket, "salt")
    upto = part.orderBy(value).rangeBetween(W.unboundedPreceding, W.currentRow)
    same = part.orderBy(value).rangeBetween(W.currentRow, W.currentRow)
    salt = F.when(single, F.pmod(F.xxhash64("p", "x", "y"), F.lit(SALTS))).otherwise(F.lit(0))
    return (
        rows.withColumn("salt", salt)
        .withColumn("upto", F.sum("n").over(upto)).withColumn("ties", F.sum("n").over(same))
        .withColumn(out, F.when(single, F.lit(0.0)).otherwise(
            F.col("upto") - F.col("ties") + (F.col("ties") + 1) / 2))
        .drop("salt", "upto", "ties")
    )


def _bases(cells: DataFrame, bucket: str, out: str) -> DataFrame:
    """What a bucket adds to the ranks inside it, less the mean rank of the pair.

    A pair has at most as many rows here as there are buckets.
    """
    sizes = cells.groupBy("p", bucket).agg(F.sum("n").alias("size"))
    before = W.partitionBy("p").orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(before), F.lit(0))
    middle = F.when(F.col(bucket) % 2 == 1, (F.col("size") + 1) / 2).otherwise(F.lit(0.0))
    mean = (F.sum("size").over(W.partitionBy("p")) + 1) / 2
    return sizes.select("p", bucket, (start + middle - mean).alias(out))


def spearman_of_pairs(rows: DataFrame, pairs: Pairs, buckets: int, size: int) -> DataFrame:
    """Spearman over the complete rows of each pair.

    A rank is the base of its bucket plus the rank inside it. Sums of products are taken per cell
    of two buckets first, so bases are joined to cells and never to rows.
    """
    ranked = _with_rank_inside(pair_rows(rows, pairs, buckets, size), "x", "xb", "lx")
    ranked = _with_rank_inside(ranked, "y", "yb", "ly")
    n, lx, ly = F.col("n").cast("double"), F.col("lx"), F.col("ly")
    cells = ranked.groupBy("p", "xb", "yb").agg(
        F.sum("n").alias("n"), F.sum(n * lx).alias("sx"), F.sum(n * ly).alias("sy"),
        F.sum(n * lx * lx).alias("sxx"), F.sum(n * ly * ly).alias("syy"),
        F.sum(n * lx * ly).alias("sxy"),
        F.min("x").alias("x0"), F.max("x").alias("x1"),
        F.min("y").alias("y0"), F.max("y").alias("y1"),
    )
    based = cells.join(_bases(cells, "xb", "bx"), ["p", "xb"]) \
        .join(_bases(cells, "yb", "by"), ["p", "yb"])
    bx, by = F.col("bx"), F.col("by")
    sums = based.groupBy("p").agg(
        F.sum(n * bx * bx + 2 * bx * F.col("sx") + F.col("sxx")).alias("xx"),
        F.sum(n * by * by + 2 * by * F.col("sy") + F.col("syy")).alias("yy"),
        F.sum(n * bx * by + bx * F.col("sy") + by * F.col("sx") + F.col("sxy")).alias("xy"),
        ((F.min("x0") < F.max("x1")) & (F.min("y0") < F.max("y1"))).alias("varies"),
    )
    r: Column = F.try_divide("xy", F.sqrt("xx") * F.sqrt("yy"))
    return named_pairs(sums.select("p", F.when(F.col("varies"), r).alias("r")), pairs)
