"""Prefix trie of conversations, encoded per shard as balanced parentheses.

Each conversation is a row of turn keys. Rows sorted by their keys are the trie in preorder: from
one row to the next the turns they do not share are closed and opened. A task writes these
parentheses for its shard, a portion of the sorted rows. The matching parenthesis, found through a
range min-max tree of excess, delimits a node's subtree; ranks of `()` pairs count its leaves, and
cumulative arrays over the preorder give members and savings as differences.

Neighbouring shards share only nodes on the path of the row at their border (the spines). Spine
nodes are sums of their pieces, less what both sides of a border counted: the shared path below
the node. All other nodes are final in their shard.

Rows longer than `band` turns are cut into bands, each a trie under the node where the one above
ends; bands are done from the deepest up, and the totals of a band's roots enter the leaves above.
A task thus never holds more than a shard's turns, whatever the longest conversation.

Node ids are 128 bits: the exclusive or of hashes of (place, turn key) along the path, turn keys
are hashes of the MD5 of role and text.

Defined results: null roles and texts are empty; null turns come first, turns of equal number go by
their key; rows without a conversation id belong to none and are left out; an empty table has no
nodes; repeated rows are turns of their own; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabulyze.functions.columns import col
from tabulyze.llm.parentheses import Parentheses
from tabulyze.llm.runs import lists, numbers, ragged
from tabulyze.llm.stamping import written

BAND = 256
SHARD_TURNS = 1 << 20
SHARD_ROWS = 1 << 18
#: Ids of conversations in one piece of text that is hashed in order.
PIECE = 4096
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def numbered_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn",
                   role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, k1, k2, size): turns in order from 1, their key and their text's UTF-8 bytes.

    The order is that of one sort of the whole table, so that a conversation of any length is
    numbered by many tasks: a place in its task, after the counts of the tasks before.
    """
    name, body = F.coalesce(col(role), F.lit("")), F.coalesce(col(text), F.lit(""))
    digest = F.md5(F.concat(F.length(name).cast("string"), F.lit(":"), name, body))
    order = ["conv", "turn", "k1", "k2"]
    turns = conversations.filter(col(conv_id).isNotNull()).select(
        col(conv_id).cast("long").alias("conv"), col(turn).alias("turn"),
        digest.alias("d"), F.octet_length(body).cast("long").alias("size"),
    ).select("conv", "turn", F.xxhash64("d").alias("k1"),
             F.xxhash64(F.lit(1), "d").alias("k2"), "size")
    placed = written(
        turns.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("at", F.monotonically_increasing_id())
        .withColumn("task", F.shiftright("at", 33)).drop("turn"), "turns")
    pieces = placed.groupBy("conv", "task").agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv").orderBy("task").rowsBetween(
        Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return placed.join(pieces, ["conv", "task"]).select(
        "conv", (F.col("at") - F.col("first") + F.col("before") + 1).alias("pos"),
        "k1", "k2", "size")


def rebuilt(turns: DataFrame, family: int, prefix: Column) -> DataFrame:
    """Each conversation begins with the first `prefix` turns of its family's first one.

    From (conv, pos, k1, k2, size); `prefix`, below `family_turns`, is a function of conv. Rows of
    a conversation without turns have pos 0. Adds `total`, the turns of the conversation.
    """
    heads = turns.filter(F.col("pos") < 9).groupBy("conv").agg(
        F.array_sort(F.collect_list(F.struct("pos", "k1", "k2", "size"))).alias("head"))
    none = F.array().cast(heads.schema["head"].dataType)
    members = written(
        turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).withColumns({
            "h": prefix, "base": F.col("conv") - F.col("conv") % family})
        .join(heads.withColumnRenamed("conv", "base"), "base", "left")
        .withColumn("head", F.when(F.col("h") > 0, F.expr(
            "filter(head, x -> x.pos <= h)")).otherwise(none))
        .withColumn("head", F.coalesce("head", none))
        .withColumn("lead", F.size("head").cast("long"))
        .withColumn("total", F.col("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0))),
        "members")
    lent = members.select("conv", "total", F.explode("head").alias("x")).select(
        "conv", "x.*", "total")
    own = turns.join(members.select("conv", "h", "lead", "total"), "conv").filter(
        F.col("pos") > F.col("h")).select(
        "conv", (F.col("pos") - F.col("h") + F.col("lead")).alias("pos"), "k1", "k2", "size",
        "total")
    empty = members.filter(F.col("total") == 0).select(
        "conv", *(F.lit(0).cast("long").alias(c) for c in ("pos", "k1", "k2", "size")), "total")
    return own.unionByName(lent).unionByName(empty)


def segments(turns: DataFrame, band: int) -> DataFrame:
    """Rows of at most `band` turns: (band, i1, i2, e1, e2, path, sizes, more, conv).

    `path` has two numbers a turn; i1 and i2 are the id of the node the row starts from, e1 and e2
    that of its last; `more` says that the conversation goes on in the next band.
    """
    stepped = turns.withColumns({
        "band": F.greatest(F.floor((F.col("pos") - 1) / band), F.lit(0)).cast("int"),
        "s1": F.xxhash64("pos", "k1", "k2"), "s2": F.xxhash64(F.lit(1), "pos", "k1", "k2")})
    filled = F.col("pos") > 0
    held = stepped.groupBy("conv", "band").agg(
        F.array_sort(F.collect_list(F.when(filled, F.struct("pos", "s1", "s2", "size"))))
        .alias("x"),
        F.bit_xor(F.when(filled, F.col("s1"))).alias("x1"),
        F.bit_xor(F.when(filled, F.col("s2"))).alias("x2"), F.max("total").alias("total"))
    above = Window.partitionBy("conv").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    begun = held.withColumns({
        "i1": F.coalesce(F.bit_xor("x1").over(above), zero),
        "i2": F.coalesce(F.bit_xor("x2").over(above), zero)})
    return begun.select(
        "band", "conv", "i1", "i2",
        F.col("i1").bitwiseXOR(F.coalesce("x1", zero)).alias("e1"),
        F.col("i2").bitwiseXOR(F.coalesce("x2", zero)).alias("e2"),
        F.flatten(F.transform("x", lambda t: F.array(t["s1"], t["s2"]))).alias("path"),
        F.transform("x", lambda t: t["size"]).alias("sizes"),
        (F.col("total") > (F.col("band") + 1) * band).alias("more"))


#: A node of a shard, or (ids not null) ids of conversations that end at a spine node.
#: saved = weighted - cost; both are sums over the subtree, `cost` also of what lies below leaves.
PIECES = (
    "task int, shard int, i1 long, i2 long, p1 long, p2 long, depth long, conv long, "
    "parent_conv long, n_convs long, n_children long, n_leaves long, weighted long, cost long, "
    "bytes long, along long, left boolean, right boolean, tip boolean, ends string, ids string")
PIECES_ARROW = pa.schema([
    (name, {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(),
            "string": pa.string()}[kind])
    for name, kind in (part.split() for part in PIECES.split(", "))])
INPUT = ["i1", "i2", "path", "more", "conv", "sizes", "x_children", "x_leaves", "x_saved"]


def shared_turns(path: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Leading turns that each row has in common with the row before it; 0 for the first row."""
    n = np.diff(first)
    both = np.minimum(n[1:], n[:-1])
    at = ragged(first[1:-1], both)
    back = at - np.repeat(first[1:-1] - first[:-2], both)
    same = (path[at] == path[back]).all(axis=1)
    place = at - np.repeat(first[1:-1], both)
    ends = np.cumsum(both)
    differs = np.where(same, np.iinfo(np.int64).max, place)
    shared = both.copy()
    filled = np.flatnonzero(both)
    if len(filled):
        shared[filled] = np.minimum(
            both[filled], np.minimum.reduceat(differs, (ends - both)[filled]))
    return np.concatenate(([0], shared))


class Shard:
    """The trie of some sorted rows, in preorder."""

    def __init__(self, table: pa.Table) -> None:
        path, first = lists(table, "path")
        self.path, self.first = path.reshape(-1, 2), first // 2
        self.sizes = lists(table, "sizes")[0]
        self.root = np.stack([numbers(table, "i1"), numbers(table, "i2")], axis=1)
        self.conv = numbers(table, "conv")
        self.more = table.column("more").to_numpy()
        n = np.diff(self.first)
        lcp = shared_turns(self.path, self.first)
        lcp[0] = -1
        lcp[1:][(self.root[1:] != self.root[:-1]).any(axis=1)] = -1
        opened = n - lcp
        closed = np.concatenate(([0], n[:-1])) - lcp
        closed[0] = 0
        turns = np.stack([closed, opened], axis=1).ravel()
        bits = np.concatenate((np.repeat(np.arange(len(turns)) % 2, turns), np.zeros(n[-1] + 1)))
        self.trie = Parentheses(bits)
        at = self.trie.opens()
        close = self.trie.find_close(at)
        self.end = self.trie.rank(close)  # of the subtree, in preorder
        self.leaf_pairs = self.trie.rank_leaf(close) - self.trie.rank_leaf(at)
        self.open_at_end = close >= len(bits) - (n[-1] + 1)
        self.row = np.repeat(np.arange(len(n)), opened)  # that opened the node
        start = np.cumsum(opened) - opened
        self.depth = np.arange(len(at)) - start[self.row] + lcp[self.row] + 1
        self.tip = np.cumsum(opened) - 1  # where each row ends

    def parents(self) -> np.ndarray:
        """The last node before that is one level up; -1 for the roots."""
        n = len(self.depth)
        order = np.lexsort((np.arange(n), self.depth))
        keys = self.depth[order] * (n + 1) + order
        found = np.searchsorted(keys, (self.depth - 1) * (n + 1) + np.arange(n)) - 1
        return np.where(self.depth > 0, order[found], -1)

    def over_subtree(self, values: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(values)))
        return sums[self.end] - sums[:-1]

    def pieces(self, extra: dict[str, np.ndarray]) -> Iterator[dict[str, list]]:
        """Columns of the nodes, then of the ids that end on spines."""
        n, first, depth = len(self.depth), self.first, self.depth
        last = first[self.row] + depth - 1
        inner = depth > 0
        own = np.where(inner, self.sizes[np.where(inner, last, 0)], 0) if len(
            self.sizes) else np.zeros(n, np.int64)
        folded = np.concatenate((np.zeros((1, 2), np.int64),
                                 np.bitwise_xor.accumulate(self.path, axis=0)))
        ids = folded[last + 1] ^ folded[first[self.row]] ^ self.root[self.row]
        along = np.concatenate(([0], np.cumsum(self.sizes)))
        along = along[last + 1] - along[first[self.row]]
        parent = self.parents()
        members = self.over_subtree(np.bincount(self.tip, minlength=n))
        # A node's rows are those from the one that opened it on.
        spans = np.stack([self.row, self.row + members], axis=1).ravel()
        least = np.minimum.reduceat(
            np.append(self.conv, np.iinfo(np.int64).max), spans)[::2]
        below = {k: np.zeros(n, np.int64) for k in extra}
        for k, values in extra.items():
            below[k][self.tip[self.more]] = values[self.more]
        goes_on = np.zeros(n, bool)
        goes_on[self.tip[self.more]] = True
        children = np.bincount(parent[inner], minlength=n) + below["x_children"]
        leaves = self.leaf_pairs + self.over_subtree(np.where(goes_on, below["x_leaves"] - 1, 0))
        left, right = self.row == 0, self.open_at_end
        spine = left | right
        ends, pieces = self._ends(spine, ids)
        tip = np.zeros(n, bool)
        tip[self.tip[-1]] = True
        outer = np.where(inner, parent, 0)
        yield {
            "i1": ids[:, 0], "i2": ids[:, 1],
            "p1": np.where(inner, ids[outer, 0], 0), "p2": np.where(inner, ids[outer, 1], 0),
            "depth": depth, "conv": least,
            "parent_conv": pa.array(least[outer], mask=~inner | spine[outer]),
            "n_convs": members, "n_children": children, "n_leaves": leaves,
            "weighted": self.over_subtree(members * own),
            "cost": self.over_subtree(own - below["x_saved"]), "bytes": own, "along": along,
            "left": left, "right": right, "tip": tip, "ends": ends, "ids": pa.nulls(n, pa.string()),
        }
        if pieces:
            at, conv, text = zip(*pieces)
            yield {"i1": ids[list(at), 0], "i2": ids[list(at), 1], "conv": list(conv),
                   "ids": list(text)}

    def _ends(self, spine: np.ndarray, ids: np.ndarray) -> tuple[list, list]:
        """Hashes of the conversations that end at each node; for spine nodes their ids instead."""
        found: list[str | None] = np.where(spine, None, EMPTY_SHA).tolist()
        pieces = []
        rows = np.flatnonzero(~self.more)
        cut = np.flatnonzero(np.diff(self.tip[rows], prepend=-1))
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(rows)]):
            node, convs = int(self.tip[rows[a]]), self.conv[rows[a:b]].tolist()
            if not spine[node]:
                found[node] = hashlib.sha256(",".join(map(str, convs)).encode()).hexdigest()
                continue
            for lo in range(0, len(convs), PIECE):
                part = convs[lo:lo + PIECE]
                pieces.append((node, part[0], ",".join(map(str, part))))
        return found, pieces


def _encode(base: int, shard_turns: int):
    """mapInArrow over sorted segments: the pieces of each shard's nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, shard, held, turns, rows = TaskContext.get().partitionId(), 0, [], 0, 0

        def done() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            extra = {k: table.column(k).fill_null(0).to_numpy()
                     for k in ("x_children", "x_leaves", "x_saved")}
            for columns in Shard(table).pieces(extra):
                n = len(columns["i1"])
                if "depth" in columns:
                    columns["depth"] = columns["depth"] + base
                columns |= {"task": np.full(n, task, np.int32), "shard": np.full(n, shard, np.int32)}
                whole = pa.RecordBatch.from_arrays([
                    pa.array(columns[f.name], f.type) if f.name in columns
                    else pa.nulls(n, f.type) for f in PIECES_ARROW], schema=PIECES_ARROW)
                yield from (whole.slice(lo, 50_000) for lo in range(0, n, 50_000))

        for batch in batches:
            lo = 0
            for i, size in enumerate(np.diff(lists(pa.table([batch.column(INPUT.index("sizes"))],
                                                            ["sizes"]), "sizes")[1])):
                if rows and (turns + size > shard_turns or rows >= SHARD_ROWS):
                    held.append(batch.slice(lo, i - lo))
                    yield from done()
                    shard, held, turns, rows, lo = shard + 1, [], 0, 0, i
                turns, rows = turns + int(size), rows + 1
            held.append(batch.slice(lo))
        if rows:
            yield from done()

    return run


NODE = ["i1", "i2"]
SUMS = ["n_convs", "n_children", "n_leaves", "weighted", "cost"]


def _merged(pieces: DataFrame) -> DataFrame:
    """Spine nodes of all shards, each once, less what neighbouring shards both counted."""
    spark = pieces.sparkSession
    spine = pieces.filter(F.col("ids").isNull() & (F.col("left") | F.col("right")))
    # One row per task: the number of its first shard in the order of all shards.
    counts = pieces.groupBy("task").agg((F.max("shard") + 1).alias("n")).orderBy("task").collect()
    before = np.concatenate(([0], np.cumsum([r["n"] for r in counts]))).tolist()
    tasks = spark.createDataFrame(
        [(r["task"], before[k]) for k, r in enumerate(counts)], "task int, before long")
    spine = spine.join(F.broadcast(tasks), "task").withColumn(
        "border", F.col("before") + F.col("shard"))
    shared = spine.filter("right").join(
        spine.filter("left").select("i1", "i2", (F.col("border") - 1).alias("border")),
        ["border", *NODE])
    deepest = shared.groupBy("border").agg(F.max(F.struct(
        "depth", "along", "tip", "n_children", "n_leaves",
        (F.col("bytes") - F.col("cost")).alias("beyond"))).alias("x"))
    tip = F.col("x.tip")
    twice = shared.join(deepest, "border").select(
        *NODE, F.lit(0).cast("long").alias("n_convs"),
        (-F.when(F.col("depth") < F.col("x.depth"), 1).when(tip, F.col("x.n_children"))
         .otherwise(0)).cast("long").alias("n_children"),
        (-F.when(tip, F.col("x.n_leaves")).otherwise(0)).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("weighted"),
        (-(F.col("x.along") - F.col("along") + F.col("bytes")
           - F.when(tip, F.col("x.beyond")).otherwise(0))).cast("long").alias("cost"))
    kept = ["p1", "p2", "depth", "conv"]
    none = [F.lit(None).cast("long").alias(c) for c in kept]
    return spine.select(*NODE, *SUMS, *kept).union(twice.select(*NODE, *SUMS, *none)).groupBy(
        *NODE).agg(*(F.sum(c).alias(c) for c in SUMS),
                   *(F.max(c).alias(c) for c in kept[:3]), F.min("conv").alias("conv"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From texts (i1, i2, conv, ids) in order: one hash per node, read as a stream."""
    node, hashed, done = None, None, []
    for batch in batches:
        for i1, i2, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3))):
            if node != (i1, i2):
                if node:
                    done.append((*node, hashed.hexdigest()))
                node, hashed = (i1, i2), hashlib.sha256()
            else:
                hashed.update(b",")
            hashed.update(text.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)],
                                             ["i1", "i2", "ends"])
            done = []
    if node:
        yield pa.RecordBatch.from_arrays(
            [pa.array([x]) for x in (*node, hashed.hexdigest())], ["i1", "i2", "ends"])


def _band_nodes(rows: DataFrame, base: int, shard_turns: int) -> DataFrame:
    """All nodes of a band, its roots included; the parent's member is null for their children."""
    order = ["i1", "i2", "path", "more", "conv"]
    pieces = written(
        rows.select(*INPUT).repartitionByRange(*order).sortWithinPartitions(*order)
        .mapInArrow(_encode(base, shard_turns), PIECES), "trie-pieces")
    merged = written(_merged(pieces), "trie-spines")
    hashed = (
        pieces.filter(F.col("ids").isNotNull()).select(*NODE, "conv", "ids")
        .repartition(*NODE).sortWithinPartitions(*NODE, "conv")
        .mapInArrow(_hashed, "i1 long, i2 long, ends string")
    )
    above = merged.select(F.col("i1").alias("p1"), F.col("i2").alias("p2"),
                          F.col("conv").alias("of_spine"))
    columns = [*NODE, "p1", "p2", "depth", "conv", *SUMS, "parent_conv", "ends"]
    inner = pieces.filter(F.col("ids").isNull() & ~(F.col("left") | F.col("right")))
    known = F.col("parent_conv").isNotNull() | (F.col("depth") == base)
    joined = [
        inner.filter(~known).join(above, ["p1", "p2"]),
        merged.filter(F.col("depth") > base).join(hashed, NODE, "left").join(above, ["p1", "p2"]),
    ]
    spine_roots = merged.filter(F.col("depth") == base).join(hashed, NODE, "left").withColumn(
        "parent_conv", F.lit(None).cast("long"))
    return reduce(DataFrame.union, [
        inner.filter(known).select(*columns), spine_roots.select(*columns),
        *(x.withColumn("parent_conv", F.col("of_spine")).select(*columns) for x in joined),
    ]).withColumn("ends", F.coalesce("ends", F.lit(EMPTY_SHA)))


RESULT = {"conv_id": "conv", "depth": "depth", "parent_conv_id": "parent_conv",
          "n_convs": "n_convs", "n_children": "n_children", "n_leaves": "n_leaves",
          "saved_tokens": "saved", "ends_sha256": "ends"}


def trie_nodes(turns: DataFrame, *, band: int = BAND,
               shard_turns: int = SHARD_TURNS) -> DataFrame:
    """A row per node of the trie of sequences (conv, pos, k1, k2, size, total)."""
    rows = written(segments(turns, band), "segments")
    deepest = rows.agg(F.max("band")).first()[0]
    zero = [F.lit(None).cast("long").alias(c) for c in ("x_children", "x_leaves", "x_saved")]
    found, below = [], None
    for k in range(deepest or 0, -1, -1):
        own = rows.filter(F.col("band") == k)
        own = own.select("*", *zero) if below is None else own.join(
            below, (F.col("e1") == F.col("b1")) & (F.col("e2") == F.col("b2")) & F.col("more"),
            "left")
        nodes = written(
            _band_nodes(own, k * band, shard_turns)
            .withColumn("saved", F.col("weighted") - F.col("cost")), "trie-nodes")
        below = nodes.filter(F.col("depth") == k * band).select(
            F.col("i1").alias("b1"), F.col("i2").alias("b2"), F.col("n_children").alias("x_children"),
            F.col("n_leaves").alias("x_leaves"), F.col("saved").alias("x_saved"))
        found.append(nodes.filter(F.col("depth") > k * band) if k else nodes)
    nodes = reduce(DataFrame.union, found)
    if deepest:  # children of a band's roots: their parent is a node of the band above
        open_ = (F.col("depth") > 1) & (F.col("depth") % band == (1 if band > 1 else 0))
        above = reduce(DataFrame.union, found[1:]).filter(F.col("depth") % band == 0).select(
            F.col("i1").alias("p1"), F.col("i2").alias("p2"), F.col("conv").alias("of_band"))
        kept = [c for c in nodes.columns if c != "parent_conv"]
        nodes = nodes.filter(~open_).select(*kept, "parent_conv").union(
            nodes.filter(open_).join(above, ["p1", "p2"]).select(
                *kept, F.col("of_band").alias("parent_conv")))
    return nodes.select(*(F.col(v).alias(k) for k, v in RESULT.items()))


FAMILY = 5
PREFIX_TURNS = 9


def rebuilt_trie(conversations: DataFrame, **options: int) -> DataFrame:
    """The trie of conversations that begin with turns of the first of their family of five; how
    many is the CRC-32 of the id modulo nine."""
    taken = F.crc32(F.col("conv").cast("string")) % PREFIX_TURNS
    return trie_nodes(rebuilt(numbered_turns(conversations), FAMILY, taken), **options)
