"""Kendall tau-b without comparing all pairs.

Complete rows are folded to distinct (x, y) with a repeat count. tau-b needs the tied pairs,
which follow from value counts, and the discordant ones. Both axes are cut into value buckets
so that ties never cross a cut. Discordant pairs are then counted in three places:

* pairs apart on both axes: from the cell counts of the bucket grid;
* pairs in one x bucket: inside that bucket, in Arrow batches of bounded size;
* pairs in one y bucket but apart on x: inside the y bucket, less those of shared cells.

A bucket that holds a single x value (or y value) has no discordant pair and is not read, so
a value that fills much of the table costs nothing.
"""

from __future__ import annotations

import sys
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from tabulyze.functions.columns import col, nan_to_null
from tabulyze.functions.order_stats import ROWS_PER_BUCKET
from tabulyze.operators.pairwise import Pairs, named_pairs, pair_rows

# Most cuts per axis: the grid of cells, four times this squared, is held by one task.
GRID_BUCKETS = 1024

# Executors need not have this package: its functions travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def discordant(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Weighted number of pairs with x_i < x_j and y_i > y_j, in O(m log m).

    Rows are put in (x, y) order and then split by the bits of their y rank, highest first.
    At each bit, the rows that agree so far are compared: a row with bit 0 is discordant with
    every earlier one with bit 1.
    """
    if len(x) < 2:
        return 0.0
    order = np.lexsort((y, x))
    rank = np.unique(y, return_inverse=True)[1][order].astype(np.int64)
    weight = n[order].astype(np.float64)
    found = 0.0
    for bit in range(int(rank.max()).bit_length() - 1, -1, -1):
        high = (rank >> bit) & 1
        ones = weight * high
        upto = np.cumsum(ones)
        family = rank >> (bit + 1)
        starts = np.flatnonzero(np.r_[True, family[1:] != family[:-1]])
        sizes = np.diff(np.r_[starts, len(rank)])
        earlier = upto - ones - np.repeat((upto - ones)[starts], sizes)
        found += float(np.sum(weight * (1 - high) * earlier))
        resort = np.argsort(rank >> bit, kind="stable")
        rank, weight = rank[resort], weight[resort]
    return found


def _grid_discordant(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
    """Pairs in different x buckets and different y buckets, from at most B x B cells."""
    xb = np.unique(cells["xb"], return_inverse=True)[1]
    yb = np.unique(cells["yb"], return_inverse=True)[1]
    grid = np.zeros((xb.max() + 1, yb.max() + 1))
    grid[xb, yb] = cells["n"]
    above, total = np.zeros(grid.shape[1]), 0.0
    for row in grid:
        total += float(np.sum(row * above))
        # Weight seen so far in strictly higher y buckets.
        above += np.r_[np.cumsum(row[::-1])[::-1][1:], 0.0]
    return pd.DataFrame({"p": [key[0]], "d": [total]})


def _bucket_discordant(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    x, y, n = (rows[c].to_numpy() for c in ("x", "y", "n"))
    return pd.DataFrame({"p": [key[0]], "d": [discordant(x, y, n)]})


def _x_bucket_discordant(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """One x bucket, less its cells: these are counted with the y buckets."""
    x, y, n, yb = (rows[c].to_numpy() for c in ("x", "y", "n", "yb"))
    total = discordant(x, y, n)
    order = np.argsort(yb, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(yb[order])) + 1):
        total -= discordant(x[part], y[part], n[part])
    return pd.DataFrame({"p": [key[0]], "d": [total]})


def kendall_of_pairs(
    rows: DataFrame,
    pairs: Pairs,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    max_buckets: int = GRID_BUCKETS,
) -> DataFrame:
    """`variable1`, `variable2`, `r`: tau-b over the complete rows of each pair of columns.

    `rows` holds doubles, NULL where missing. Two jobs, whatever the number of pairs, count the
    rows and find the cuts.
    """
    size = rows.count()
    buckets = max(1, min(max_buckets, size // rows_per_bucket))
    placed = pair_rows(rows, pairs, buckets, size)

    def wide(name: str) -> Column:
        return F.col(name) % 2 == 0

    def tied(*keys: str) -> DataFrame:
        per_value = placed.groupBy("p", *keys).agg(F.sum("n").cast("double").alias("t"))
        return per_value.select("p", (F.col("t") * (F.col("t") - 1) / 2).alias("d"))

    cells = placed.groupBy("p", "xb", "yb").agg(F.sum("n").cast("double").alias("n"))
    schema = "p int, d double"
    parts = [
        ("every", tied()), ("x", tied("x")), ("y", tied("y")), ("xy", tied("x", "y")),
        # The grid is bounded by the cuts, not by the rows.
        ("discordant", cells.groupBy("p").applyInPandas(_grid_discordant, schema)),
        ("discordant", placed.filter(wide("xb")).groupBy("p", "xb").applyInPandas(
            _x_bucket_discordant, schema)),
        ("discordant", placed.filter(wide("yb")).groupBy("p", "yb").applyInPandas(
            _bucket_discordant, schema)),
    ]
    counted = reduce(DataFrame.unionByName, [
        part.select("p", F.lit(name).alias("part"), "d") for name, part in parts])

    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("part") == name, F.col("d"))), F.lit(0.0)).alias(name)

    one = counted.groupBy("p").agg(*[total(n) for n in ("every", "discordant", "x", "y", "xy")])
    strict = F.col("every") - F.col("x") - F.col("y") + F.col("xy")
    scale = F.sqrt(F.col("every") - F.col("x")) * F.sqrt(F.col("every") - F.col("y"))
    r = F.try_divide(strict - 2 * F.col("discordant"), scale)
    return named_pairs(one.select("p", r.alias("r")), pairs)


def kendall_pair(
    df: DataFrame,
    x: str,
    y: str,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    max_buckets: int = GRID_BUCKETS,
) -> DataFrame:
    """One row, `r`: tau-b of two numeric columns over their complete rows."""
    rows = nan_to_null(df.select(*[col(c).cast("double").alias(c) for c in dict.fromkeys((x, y))]))
    return kendall_of_pairs(rows, [(x, y)], rows_per_bucket, max_buckets).select("r")
