"""Packing of documents into sequences by linear grouping.

Only the number of pieces of each length (at most `capacity` numbers) reaches the driver. There
the large lengths are dealt into groups of equal cardinality and rounded up to the longest of
their group; the linear program over configurations of these few sizes is solved by column
generation, and its whole parts are used. Real lengths take the places of the rounded ones, and
what is left over, with all small lengths, goes best-fit into the room that remains. Runs of equal
sequences are kept as one entry, so the plan's size does not grow with the documents.

Documents are matched with the plan by their rank among the pieces of their length: a rank inside
the task that tokenized them, plus the number in earlier tasks.

Defined results: null and empty texts are one piece of the end id; repeated rows and null ids are
packed like any other; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tabulyze.functions.columns import col
from tabulyze.llm.batches import slices
from tabulyze.llm.stamping import written
from tabulyze.llm.tokens import encoder, with_end

CAPACITY = 2048
END_ID = 0
GROUPS = 32
LARGE_SHARES = (2, 3, 4)


@dataclass
class Run:
    """`n` equal sequences from number `first` on; items are (length, first rank, copies)."""

    first: int
    n: int
    room: int
    items: list[tuple[int, int, int]] = field(default_factory=list)

    def cut(self, n: int) -> "Run":
        """Split off the sequences after the first n."""
        rest = Run(self.first + n, self.n - n, self.room,
                   [(size, rank + n * copies, copies) for size, rank, copies in self.items])
        self.n = n
        return rest


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int,
                   rounds: int = 1500) -> list[tuple[np.ndarray, int]]:
    """Whole parts of a linear-program optimum: (copies of each size, number of sequences)."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(rounds):
        prices = np.linalg.solve(basis.T, np.ones(k))
        column = _best_filling(sizes, prices, capacity)
        if prices @ column <= 1 + 1e-9:
            break
        use = np.linalg.solve(basis, demand.astype(float))
        step = np.linalg.solve(basis, column)
        ratio = np.where(step > 1e-9, np.maximum(use, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    use = np.linalg.solve(basis, demand.astype(float))
    whole = np.floor(use + 1e-9).astype(np.int64)
    return [(basis[:, j].round().astype(np.int64), int(n)) for j, n in enumerate(whole) if n > 0]


def _best_filling(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """Copies of each size of greatest total price that fit one sequence."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1, np.int32)
    for room in range(int(sizes.min()), capacity + 1):
        fits = np.flatnonzero(sizes <= room)
        gain = best[room - sizes[fits]] + prices[fits]
        j = int(np.argmax(gain))
        best[room], took[room] = best[room - 1], -1
        if gain[j] > best[room] + 1e-12:
            best[room], took[room] = gain[j], fits[j]
    column, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if took[room] < 0:
            room -= 1
        else:
            column[took[room]] += 1
            room -= int(sizes[took[room]])
    return column


class Supply:
    """Lengths in descending order with counts, handed out in order."""

    def __init__(self, lengths: list[tuple[int, int, int]]) -> None:
        self.left = lengths[::-1]  # (length, first rank, count), shortest first

    def take(self, n: int) -> list[tuple[int, int, int]]:
        taken = []
        while n and self.left:
            length, rank, count = self.left.pop()
            now = min(n, count)
            taken.append((length, rank, now))
            if now < count:
                self.left.append((length, rank + now, count - now))
            n -= now
        return taken


def grouped(lengths: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int, int]]]:
    """(length, count) in descending order, dealt into groups of equal cardinality."""
    total = sum(n for _, n in lengths)
    bounds = [total * (g + 1) // groups for g in range(groups)]
    out, at, g = [[] for _ in range(groups)], 0, 0
    for length, count in lengths:
        rank = 0
        while rank < count:
            while at >= bounds[g]:
                g += 1
            now = min(count - rank, bounds[g] - at)
            out[g].append((length, rank, now))
            rank, at = rank + now, at + now
    return [x for x in out if x]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS,
         large_shares: tuple[int, ...] = LARGE_SHARES) -> list[Run]:
    """Runs of sequences that hold every piece of the histogram (length -> count).

    Lengths above capacity // share are large; of the shares the one with the fewest sequences.
    """
    plans = [_plan(histogram, capacity, groups, share) for share in large_shares]
    return min(plans, key=lambda runs: sum(r.n for r in runs))


def _plan(histogram: dict[int, int], capacity: int, groups: int, share: int) -> list[Run]:
    runs: list[Run] = []
    made = 0
    by_room: dict[int, list[Run]] = {}

    def keep(run: Run) -> None:
        runs.append(run)
        by_room.setdefault(run.room, []).append(run)

    full = histogram.get(capacity, 0)
    if full:
        keep(Run(0, full, 0, [(capacity, 0, 1)]))
        made = full
    least = capacity // share
    large = [(s, histogram[s]) for s in sorted(histogram, reverse=True) if least < s < capacity]
    small = [(s, 0, histogram[s]) for s in sorted(histogram, reverse=True) if s <= least]
    rest: list[tuple[int, int, int]] = []
    if large:
        dealt = grouped(large, groups)
        supplies = [Supply(g) for g in dealt]
        sizes = np.array([g[0][0] for g in dealt])
        demand = np.array([sum(n for _, _, n in g) for g in dealt])
        used = np.zeros(len(dealt), np.int64)
        for copies, n in configurations(sizes, demand, capacity):
            lanes = []
            # Rounding in the linear program must not ask for more than a group holds.
            n = min([n, *((demand[g] - used[g]) // c for g, c in enumerate(copies) if c)])
            for g, c in enumerate(copies):
                used[g] += c * n
                lanes += [supplies[g].take(n) for _ in range(c)]
            cuts = np.unique(np.concatenate(
                [[0, n], *(np.cumsum([x[2] for x in lane]) for lane in lanes)]).astype(int))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                items = [_at(lane, a) for lane in lanes]
                room = capacity - sum(s for s, _, _ in items)
                keep(Run(made + a, b - a, room, items))
            made += int(n)
        rest = [x for s in supplies for x in s.left]
    for length, rank, count in sorted([*rest, *small], key=lambda x: (-x[0], x[1])):
        while count:
            room = min((r for r, held in by_room.items() if held and r >= length), default=None)
            if room is None:
                each = capacity // length
                keep(Run(made, -(-count // each), capacity))
                made += runs[-1].n
                continue
            run, each = by_room[room].pop(), room // length
            whole = min(run.n, count // each)
            if whole == 0:  # the last few share one sequence
                whole, each = 1, count
            if whole < run.n:
                keep(run.cut(whole))
            run.items.append((length, rank, each))
            run.room -= each * length
            by_room.setdefault(run.room, []).append(run)
            rank, count = rank + whole * each, count - whole * each
    return runs


def _at(lane: list[tuple[int, int, int]], place: int) -> tuple[int, int, int]:
    for length, rank, count in lane:
        if place < count:
            return length, rank + place, 1
        place -= count
    raise IndexError(place)


def slots(runs: list[Run]) -> dict[str, np.ndarray]:
    """The plan by length: ranks low.. go to sequence first + (rank - low) // copies."""
    rows = []
    for run in runs:
        offset = 0
        for length, rank, copies in run.items:
            rows.append((length, rank, run.first, copies, offset))
            offset += length * copies
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "low", "first", "copies", "offset"), table.T.copy()))


def placed(table: dict[str, np.ndarray], lengths: np.ndarray,
           ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces by length and rank."""
    shift = np.int64(1) << np.int64(48)
    keys = table["length"] * shift + table["low"]
    at = np.searchsorted(keys, lengths * shift + ranks, side="right") - 1
    nth = ranks - table["low"][at]
    copies = table["copies"][at]
    return table["first"][at] + nth // copies, table["offset"][at] + nth % copies * lengths


def pieces(docs: DataFrame, definition: str, id_column: str, text_column: str,
           capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row per piece, with its rank among pieces of its length in this task (`shard`)."""
    id_type = docs.schema[id_column].dataType
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    ids_too = ", ids array<long>" if with_ids else ""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        encode = encoder(shared.value)
        for batch in batches:
            for part in slices(batch.column(1)):
                ids, bounds = with_end(*encode.encode(part), end_id)
                sizes = np.diff(bounds)
                n = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(sizes)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                head = (sizes - 1) % capacity + 1
                length = np.where(piece == 0, head[doc], capacity)
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                raw, lo = memoryview(ids).cast("B"), bounds[:-1][doc] + start
                crc = [zlib.crc32(raw[4 * a:4 * b])
                       for a, b in zip(lo.tolist(), (lo + length).tolist())]
                order = np.argsort(length, kind="stable")
                sorted_ = length[order]
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(length)) - np.searchsorted(sorted_, sorted_)
                rank += seen[length]
                seen += np.bincount(length, minlength=capacity + 1)
                columns = [
                    batch.column(0).slice(part.first, len(part)).take(pa.array(doc)),
                    pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                    pa.array(np.array(crc, np.int64)),
                    pa.array(np.full(len(doc), shard, np.int32)), pa.array(rank),
                ]
                names = ["id", "piece", "start", "length", "ids_crc32", "shard", "rank"]
                if with_ids:
                    ends = np.append(lo, lo[-1:] + length[-1:])
                    columns.append(pa.ListArray.from_arrays(
                        pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(col(id_column).alias("id"), col(text_column).alias("text")).mapInArrow(
        cut, f"id {id_type.simpleString()}, piece int, start long, length long, ids_crc32 long, "
             f"shard int, rank long{ids_too}")


def packed(docs: DataFrame, definition: str, id_column: str = "doc_id",
           text_column: str = "text", capacity: int = CAPACITY, end_id: int = END_ID,
           groups: int = GROUPS, with_ids: bool = False) -> DataFrame:
    """Where each piece of each document goes: sequence_id and offset (and ids, if asked)."""
    cut = written(pieces(docs, definition, id_column, text_column, capacity, end_id, with_ids),
                  "pieces")
    tally = written(cut.groupBy("shard", "length").agg(F.count(F.lit(1)).alias("n")), "tally")
    histogram = {r["length"]: r["n"] for r in
                 tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = slots(plan(histogram, capacity, groups))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(
        Window.unboundedPreceding, -1)
    earlier = tally.select(
        "shard", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))

    @F.arrow_udf("sequence_id long, offset long")
    def place(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        both = placed(table, lengths.to_numpy(zero_copy_only=False),
                      ranks.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(x) for x in both],
                                          names=["sequence_id", "offset"])

    return (
        cut.join(earlier, ["shard", "length"])
        .withColumn("at", place(F.col("length"), F.col("rank") + F.col("earlier")))
        .select(F.col("id").alias(id_column), "piece", "start", "length", "ids_crc32",
                "at.sequence_id", "at.offset", *(["ids"] if with_ids else []))
    )
