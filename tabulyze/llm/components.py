"""Connected components by alternating large-star and small-star steps.

Each step keeps one row per edge and takes minima by aggregation; no neighbour list is gathered.
Tables between rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabulyze.llm.stamping import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is tied to the smallest node around it."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return (
        both.filter(F.col("b") > F.col("a")).join(least, "a")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .filter(F.col("a") != F.col("b")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, are tied to the smallest of them."""
    down = edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).filter(F.col("a") != F.col("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return tied.union(own).filter(F.col("a") != F.col("b")).distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(
        F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")),
    ).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node it reaches.

    Nodes without an edge to another node are not listed. Repeated and reversed edges are allowed.
    """
    edges = written(edges.filter(F.col("a") != F.col("b")).distinct(), "edges")
    before = _digest(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        edges = written(_small_star(_large_star(edges)), "edges")
        after = _digest(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"Components did not settle in {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root"))
    ).distinct()
