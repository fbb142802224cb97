"""SimHash near-duplicates through segment popcounts.

A fingerprint of 64 bits is cut into 32 segments of two bits; the vector of their bit counts is
its embedding, packed as two bits a count. The Manhattan distance of two embeddings is never more
than the Hamming distance of the fingerprints. Vectors within distance 3 differ in at most 3 of
the 5 blocks of coordinates, so they share a cell in one of the 10 grids that fix the counts of
two blocks. Members of a cell are compared by Manhattan distance, then by Hamming distance.

Only distinct fingerprints enter the join. A cell with more members than `cell_limit` is dealt
into chunks, and each pair of chunks is compared by a task of its own. Tasks return the edges of
a spanning forest, never all pairs.

Defined results: null and empty texts have fingerprint zero, which links like any other; repeated
rows and ids are kept; a component whose ids are all null has a null component id; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from tabulyze.functions.columns import col
from tabulyze.llm.batches import as_bytes
from tabulyze.llm.components import components
from tabulyze.llm.stamping import stamped, unused, written

SHINGLE_WORDS = 3
MAX_DISTANCE = 3
SEED = 42
BLOCKS = 5
CELL_LIMIT = 4096
LANES = 0x5555555555555555


def _fingerprint(text: bytes, size: int) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(len(words) - size + 1, 1)
    spans = zip(starts[:n].tolist(), ends[min(size, len(words)) - 1:].tolist())
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, n)
    # Eight counters of a byte each, one for bit k of every byte; a run of 255 cannot overflow.
    counts = np.zeros((8, 8), np.int64)
    runs = np.arange(0, n, 255)
    for k in range(8):
        lanes = (hashes >> np.uint64(k)) & np.uint64(0x0101010101010101)
        sums = np.add.reduceat(lanes, runs)
        counts[k] = sums.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    bits = (2 * counts > n).astype(np.uint64)
    places = (np.arange(8)[None, :] * 8 + np.arange(8)[:, None]).astype(np.uint64)
    return int((bits << places).sum(dtype=np.uint64))


def fingerprint(text: Column, size: int = SHINGLE_WORDS) -> Column:
    """The SimHash of a text's word shingles as a signed 64-bit number."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        values = [_fingerprint(t, size) for lo in range(0, len(texts), 256)
                  for t in as_bytes(texts.slice(lo, 256))]
        return pa.array(np.array(values, np.uint64).view(np.int64))

    return of(text)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def embedding(fp: Column) -> Column:
    """Bit counts of the 32 segments, two bits each."""
    low = fp.bitwiseAND(F.lit(LANES))
    high = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LANES))
    return F.shiftleft(low.bitwiseAND(high), 1).bitwiseOR(low.bitwiseXOR(high))


def grid_masks(blocks: int = BLOCKS, distance: int = MAX_DISTANCE) -> list[int]:
    """For each grid the mask of the segments whose counts it fixes, as a signed number."""
    bounds = np.linspace(0, 32, blocks + 1).round().astype(int)
    parts = [sum(3 << (2 * s) for s in range(a, b)) for a, b in zip(bounds[:-1], bounds[1:])]
    masks = [sum(chosen) for chosen in combinations(parts, blocks - distance)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _packed(fps: np.ndarray) -> np.ndarray:
    return (fps & np.uint64(LANES)) + ((fps >> np.uint64(1)) & np.uint64(LANES))


def within(a: np.ndarray, b: np.ndarray, va: np.ndarray, vb: np.ndarray,
           distance: int) -> np.ndarray:
    """Positions whose Manhattan distance, and then Hamming distance, is within `distance`."""
    d = va ^ vb
    odd = d & np.uint64(LANES)
    two = (d >> np.uint64(1)) & ~d & np.uint64(LANES)
    near = np.flatnonzero(np.bitwise_count(odd) + 2 * np.bitwise_count(two) <= distance)
    return near[np.bitwise_count(a[near] ^ b[near]) <= distance]


class Forest:
    """Smallest member of each group of linked positions, from pairs given in portions."""

    def __init__(self, n: int) -> None:
        self.label = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            low, high = np.minimum(x, y), np.maximum(x, y)
            if (open_ := low != high).any():
                np.minimum.at(label, high[open_], low[open_])
                while (label[label] != label).any():
                    label[:] = label[label]
            else:
                return


def _cell_edges(keys: np.ndarray, fps: np.ndarray, chunk: np.ndarray,
                distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges among members of equal key; sorted by key. Chunk pairs cross only."""
    n = len(keys)
    end = np.searchsorted(keys, keys, side="right")
    packed, forest = _packed(fps), Forest(n)
    alive, held_a, held_b, held, step = np.arange(n), [], [], 0, 1
    while len(alive := alive[alive + step < end[alive]]):
        pairs = alive if chunk is None else alive[chunk[alive] != chunk[alive + step]]
        other = pairs + step
        hit = within(fps[pairs], fps[other], packed[pairs], packed[other], distance)
        if len(hit):
            held_a.append(pairs[hit])
            held_b.append(other[hit])
            held += len(hit)
        if held > 500_000:
            forest.link(np.concatenate(held_a), np.concatenate(held_b))
            held_a, held_b, held = [], [], 0
        step += 1
    if held:
        forest.link(np.concatenate(held_a), np.concatenate(held_b))
    linked = np.flatnonzero(forest.label != np.arange(n))
    return fps[linked], fps[forest.label[linked]]


def _compare(distance: int):
    """mapInArrow over rows (task, fp, chunk, cross) sorted by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(part: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            tasks, fps, chunk, cross = part
            for crossing in (False, True):
                own = cross == crossing
                if own.any():
                    a, b = _cell_edges(tasks[own], fps[own].view(np.uint64),
                                       chunk[own] if crossing else None, distance)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        rest = None
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now)]
            cut = np.searchsorted(now[0], now[0][-1]) if len(now[0]) else 0
            rest = [x[cut:] for x in now]
            if cut:
                yield from edges([x[:cut] for x in now])
        if rest is not None and len(rest[0]):
            yield from edges(rest)

    return run


def near_edges(fps: DataFrame, blocks: int = BLOCKS, distance: int = MAX_DISTANCE,
               cell_limit: int = CELL_LIMIT) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints (fp) linked within `distance`."""
    masks = grid_masks(blocks, distance)
    vector = embedding(F.col("fp"))
    members = fps.select(
        "fp", F.explode(F.array(*(
            F.xxhash64(F.lit(i), vector.bitwiseAND(F.lit(m))) for i, m in enumerate(masks)
        ))).alias("cell"),
    )
    # A crowded cell of n members becomes c = ceil(n / limit) chunks and c * (c + 1) / 2 tasks.
    crowded = (
        members.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > cell_limit)
        .select("cell", F.ceil(F.col("n") / cell_limit).cast("int").alias("chunks"))
    )
    dealt = members.join(crowded, "cell", "left").withColumn(
        "chunk", F.when(F.col("chunks").isNull(), F.lit(0))
        .otherwise(F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")),
    )
    partner = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(0), F.col("chunks") - 1))
    spread = dealt.select("cell", "fp", "chunk", F.explode(partner).alias("partner")).select(
        F.xxhash64("cell", F.least("chunk", "partner"), F.greatest("chunk", "partner"))
        .alias("task"),
        "fp", "chunk", (F.col("chunk") != F.col("partner")).alias("cross"),
    )
    return (
        spread.repartition("task").sortWithinPartitions("task")
        .mapInArrow(_compare(distance), "a long, b long")
    )


def link_fingerprints(fps: DataFrame, **options: int) -> DataFrame:
    """(node, root) for the fingerprints (fp) that are linked to another one."""
    return components(near_edges(fps.select("fp").distinct(), **options))


def simhash_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                       shingle_words: int = SHINGLE_WORDS, **options: int) -> DataFrame:
    """(id, fingerprint, component_id): the smallest id among all texts reachable by links."""
    marked = written(docs.select(
        col(id_column).alias("id"), fingerprint(col(text_column), shingle_words).alias("fp"),
    ), "fingerprints")
    nodes = marked.groupBy("fp").agg(F.min("id").alias("least_id"))
    roots = link_fingerprints(nodes, **options).withColumnRenamed("node", "fp")
    rooted = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = written(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = written(rooted.join(least, "root").select("fp", "component_id"), "named")
    return marked.join(named, "fp").select(
        F.col("id").alias(id_column), as_hex(F.col("fp")).alias("fingerprint"), "component_id",
    )


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                shingle_words: int = SHINGLE_WORDS, distance: int = MAX_DISTANCE) -> DataFrame:
    """The rows of docs that stay when each component keeps its row with the smallest id.

    Null ids come last; among rows with the same id any one stays. All columns are kept.
    """
    fp, row = unused("fp", docs), unused("row_uid", docs)
    marked = stamped(docs.withColumn(fp, fingerprint(col(text_column), shingle_words)),
                     "near", row)
    slim = marked.select(F.col(row).alias("row"), col(id_column).alias("id"),
                         F.col(fp).alias("fp"))
    roots = written(
        link_fingerprints(slim, blocks=distance + 2, distance=distance)
        .withColumnRenamed("node", "fp"), "roots")
    first = (
        slim.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root"))
        .agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first"))
        .select(F.col("first.row").alias(row))
    )
    return marked.join(first, row, "left_semi").select(*(col(c) for c in docs.columns))
