"""Ranked lexical search by Block-Max MaxScore over sharded inverted indexes.

A shard indexes all terms of some rows in reading order. Its rows are cut into ranges of 256; the
postings of a term in one range are a block of one-byte places and counts, and the block's header
has the largest count and the shortest text in it, which bound what the term can add there.

A search sorts a query's lists by their bound over the shard. Lists whose bounds together stay
below the tenth best score are not essential: rows found in them alone cannot enter the result.
Postings of the essential lists are summed by windows of ranges. A row found there is followed
through the other lists, from the largest bound down, as long as its sum and the bounds that are
left reach the tenth best score; the header of its block is asked first, and only blocks that some
row still needs are read. Each task hands on its ten best rows per query, and a ranking merges them.

Queries are taken through the driver in blocks of `block_bytes` of text, each against the whole
index; counts of rows, terms and rows per term are of all documents.

Defined results: null and empty texts have no terms and are never found; an item without known
terms has no rows; repeated items are answered one by one, as are repeated documents; null
document ids come after others of the same score; extra columns are ignored. Terms are told apart
by 64-bit hashes.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from tabulyze.functions.columns import col
from tabulyze.llm.batches import LOWER, byte_table, slices
from tabulyze.llm.runs import ragged
from tabulyze.llm.stamping import written

#: Term bytes before lower-casing: digits, ASCII letters, and whatever is not ASCII.
TERM = byte_table(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B),
                         *range(0x80, 0x100)]))

TOP = 10
RANGE = 256
WINDOW_RANGES = 16
SHARD_ROWS = 16_384
SHARD_BYTES = 16 << 20
BLOCK_BYTES = 8 << 20
#: Largest count a posting byte holds; larger ones stand in a list of their own.
MANY = 255

INDEX = ("n_rows long, n_filled long, n_terms long, ids binary, lengths binary, terms binary, "
         "list_start binary, block_range binary, block_start binary, block_count binary, "
         "block_shortest binary, places binary, counts binary, large_at binary, large binary")


def _term_hashes(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For slices of the texts: term hashes, the row each is from, and bytes of text."""
    for part in slices(texts):
        spans = part.words(TERM)
        yield spans.hashes(LOWER[part.data]), part.first + spans.text_index(), len(part.data)


@dataclass
class Shard:
    """The index of some rows; lists are in ascending order of term hash."""

    ids: np.ndarray
    lengths: np.ndarray
    terms: np.ndarray
    list_start: np.ndarray
    block_range: np.ndarray
    block_start: np.ndarray
    block_count: np.ndarray
    block_shortest: np.ndarray
    places: np.ndarray
    counts: np.ndarray
    large_at: np.ndarray
    large: np.ndarray

    TYPES = {"ids": "<i8", "lengths": "<i8", "terms": "<u8", "list_start": "<i8",
             "block_range": "<u4", "block_start": "<i8", "block_count": "<u4",
             "block_shortest": "<u4", "places": "u1", "counts": "u1", "large_at": "<i8",
             "large": "<u4"}

    @classmethod
    def build(cls, ids: np.ndarray, hashes: np.ndarray, rows: np.ndarray) -> "Shard":
        """`ids` are places of the rows in the batch table; `rows` ascend."""
        lengths = np.bincount(rows, minlength=len(ids)).astype(np.int64)
        order = np.argsort(hashes, kind="stable")
        hashes, rows = hashes[order], rows[order]
        first = np.flatnonzero(np.concatenate(
            ([True], (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])))[:len(rows)])
        tf = np.diff(np.append(first, len(rows)))
        hashes, rows = hashes[first], rows[first]
        ranges = rows // RANGE
        head = np.flatnonzero(np.concatenate(
            ([True], (hashes[1:] != hashes[:-1]) | (ranges[1:] != ranges[:-1])))[:len(rows)])
        own = hashes[head]
        list_head = np.flatnonzero(
            np.concatenate(([True], own[1:] != own[:-1]))[:len(own)])
        big = np.flatnonzero(tf >= MANY)
        none = np.zeros(0, np.int64)
        return cls(
            ids, lengths, own[list_head], np.append(list_head, len(head)), ranges[head],
            np.append(head, len(rows)),
            np.maximum.reduceat(tf, head) if len(head) else none,
            np.minimum.reduceat(lengths[rows], head) if len(head) else none,
            rows % RANGE, np.minimum(tf, MANY), big, tf[big])

    def packed(self) -> dict[str, bytes]:
        return {k: getattr(self, k).astype(t).tobytes() for k, t in self.TYPES.items()}

    @classmethod
    def unpacked(cls, row: dict[str, bytes]) -> "Shard":
        return cls(**{k: np.frombuffer(row[k], t) for k, t in cls.TYPES.items()})

    def lists(self, wanted: np.ndarray) -> np.ndarray:
        """Number of each wanted term's list, -1 where the shard has none."""
        if not len(self.terms):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(self.terms, wanted), len(self.terms) - 1)
        return np.where(self.terms[at] == wanted, at, -1)

    def rows_per_list(self, lists: np.ndarray) -> np.ndarray:
        start = self.block_start[self.list_start]
        return start[lists + 1] - start[lists]

    def postings(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Decodes blocks: for each posting the number of its block in `blocks`, row and count."""
        start, size = self.block_start[blocks], self.block_start[blocks + 1] - \
            self.block_start[blocks]
        of = np.repeat(np.arange(len(blocks)), size)
        at = ragged(start, size)
        tf = self.counts[at].astype(np.int64)
        if len(self.large_at) and (many := np.flatnonzero(tf == MANY)).size:
            tf[many] = self.large[np.searchsorted(self.large_at, at[many])]
        rows = self.block_range[blocks].astype(np.int64)[of] * RANGE + self.places[at]
        return of, rows, tf


def index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per shard, written to the shared folder. Row ids are kept as Arrow data."""
    frame = docs.select(col(id_column).cast("long").alias("id"), col(text_column).alias("text"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        ids: list[pa.Array] = []
        size = 0

        def shard() -> pa.RecordBatch:
            base, rows, hashes = 0, [], []
            for part, (h, r) in zip(ids, held):
                rows.append(r + base)
                hashes.append(h)
                base += len(part)
            own = Shard.build(np.arange(base), np.concatenate(hashes), np.concatenate(rows))
            row = own.packed()
            row["ids"] = _ids_to_bytes(pa.concat_arrays(ids))
            row |= {"n_rows": base, "n_filled": int((own.lengths > 0).sum()),
                    "n_terms": int(own.lengths.sum())}
            return pa.RecordBatch.from_pylist([row], INDEX_ARROW)

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = list(_term_hashes(part.column(1)))
                held.append((np.concatenate([h for h, _, _ in found]),
                             np.concatenate([r for _, r, _ in found])))
                ids.append(part.column(0))
                size += sum(n for _, _, n in found)
                if size >= SHARD_BYTES or sum(map(len, ids)) >= SHARD_ROWS:
                    yield shard()
                    held, ids, size = [], [], 0
        if ids:
            yield shard()

    return written(frame.mapInArrow(build, INDEX), "search-index")


INDEX_ARROW = pa.schema(
    [(n, pa.int64()) for n in ("n_rows", "n_filled", "n_terms")]
    + [(n, pa.binary()) for n in Shard.TYPES])


def _ids_to_bytes(ids: pa.Array) -> bytes:
    """Ids as 8 bytes each, followed by a byte each that is 1 where the id is null."""
    values = np.array(ids.fill_null(0), dtype="<i8")
    return values.tobytes() + np.array(ids.is_null(), dtype="u1").tobytes()


def _ids_from_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(data) // 9
    return np.frombuffer(data, "<i8", n), np.frombuffer(data, "u1", n, 8 * n) > 0


@dataclass
class Queries:
    """A block of queries: distinct terms, and for each query its terms with their repeats."""

    terms: np.ndarray
    own: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, texts: list[str | None]) -> "Queries":
        array = pa.array(texts, pa.large_string())
        found = list(_term_hashes(array))
        hashes = np.concatenate([h for h, _, _ in found])
        rows = np.concatenate([r for _, r, _ in found])
        terms, at = np.unique(hashes, return_inverse=True)
        cuts = np.searchsorted(rows, np.arange(len(texts) + 1))
        return cls(terms, [np.unique(at[a:b], return_counts=True)
                           for a, b in zip(cuts[:-1], cuts[1:])])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def rows_per_term(shards: DataFrame, terms: np.ndarray) -> np.ndarray:
    """In how many rows of the index each term occurs; one row per term reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for row in _shards(batches):
            own = Shard.unpacked(dict.fromkeys(Shard.TYPES, b"") | row)
            lists = own.lists(terms)
            there = lists >= 0
            total[there] += own.rows_per_list(lists[there])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    found = (
        shards.select("terms", "list_start", "block_start")
        .mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    )
    df = np.zeros(len(terms), np.int64)
    df[found["term"].to_numpy()] = found["n"].to_numpy()
    return df


@dataclass
class Measure:
    """Term weights, and what the length of a text does to them, from counts of all documents."""

    n_docs: int
    n_terms: int

    def weights(self, df: np.ndarray) -> np.ndarray:
        top = 2 * self.n_docs + 2
        return np.array([math.floor(1000 * math.log(top / (2 * int(d) + 1))) for d in df],
                        np.int64)

    def penalty(self, lengths: np.ndarray) -> np.ndarray:
        product = 75 * self.n_docs
        if len(lengths) and int(lengths.max()) * product >= 1 << 63:
            rates = [int(n) * product // self.n_terms for n in lengths]
            return 8 * (25 + np.array(rates, np.int64))
        return 8 * (25 + lengths.astype(np.int64) * product // self.n_terms)


def impact(tf: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + penalty)


class Best:
    """The best rows of a query so far, and the score that another must reach."""

    def __init__(self, top: int) -> None:
        self.top, self.heap = top, []

    @property
    def bar(self) -> int:
        """A row below this score cannot enter; one at it may, by its id."""
        return self.heap[0][0] if len(self.heap) == self.top else 1

    def offer(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        for score, doc, null in zip(scores.tolist(), ids.tolist(), nulls.tolist()):
            entry = (score, not null, -doc)  # the smallest entry is the worst row
            if len(self.heap) < self.top:
                heapq.heappush(self.heap, entry)
            elif entry > self.heap[0]:
                heapq.heapreplace(self.heap, entry)


class Searcher:
    """Answers queries on one shard."""

    def __init__(self, row: dict, terms: np.ndarray, weights: np.ndarray,
                 measure: Measure) -> None:
        ids = row["ids"]
        self.ids, self.nulls = _ids_from_bytes(ids)
        self.shard = Shard.unpacked(row | {"ids": b""})
        self.penalty = measure.penalty(self.shard.lengths)
        self.list_of, self.weights = self.shard.lists(terms), weights
        # What a term can add in a block: its largest count in its shortest text.
        self.bounds = impact(self.shard.block_count.astype(np.int64),
                             measure.penalty(self.shard.block_shortest))
        starts = self.shard.list_start
        self.list_bound = np.maximum.reduceat(self.bounds, starts[:-1]) if len(
            self.bounds) else np.zeros(0, np.int64)

    def search(self, query: tuple[np.ndarray, np.ndarray], best: Best) -> None:
        lists = self.list_of[query[0]]
        there = (lists >= 0) & (self.weights[query[0]] > 0)
        lists = lists[there]
        factor = (self.weights[query[0]] * query[1])[there]
        bound = factor * self.list_bound[lists] if len(lists) else factor
        order = np.argsort(bound, kind="stable")
        lists, factor, bound = lists[order], factor[order], bound[order]
        below = np.concatenate(([0], np.cumsum(bound)))  # of the lists before each
        shard = self.shard
        starts, ends = shard.list_start[lists], shard.list_start[lists + 1]
        for low in range(0, len(self.ids), RANGE * WINDOW_RANGES):
            bar = best.bar
            essential = int(np.searchsorted(below, bar, side="left")) - 1
            if essential >= len(lists):
                return
            at = low // RANGE
            cut = np.array([
                (a + np.searchsorted(shard.block_range[a:b], at),
                 a + np.searchsorted(shard.block_range[a:b], at + WINDOW_RANGES))
                for a, b in zip(starts[essential:].tolist(), ends[essential:].tolist())])
            size = cut[:, 1] - cut[:, 0]
            blocks = ragged(cut[:, 0], size)
            if not len(blocks):
                continue
            of, rows, tf = shard.postings(blocks)
            gain = np.repeat(factor[essential:], size)[of] * impact(tf, self.penalty[rows])
            sums = np.zeros(RANGE * WINDOW_RANGES, np.int64)
            np.add.at(sums, rows - low, gain)
            found = np.flatnonzero(sums + below[essential] >= bar)
            self._follow(found + low, sums[found], lists[:essential], factor, below, bar, best)

    def _follow(self, rows: np.ndarray, scores: np.ndarray, lists: np.ndarray,
                factor: np.ndarray, below: np.ndarray, bar: int, best: Best) -> None:
        """Completes the scores of rows from lists that are not essential."""
        shard = self.shard
        for k in range(len(lists) - 1, -1, -1):
            keep = scores + below[k + 1] >= bar
            rows, scores = rows[keep], scores[keep]
            if not len(rows):
                return
            a, b = shard.list_start[lists[k]], shard.list_start[lists[k] + 1]
            ranges = shard.block_range[a:b]
            at = np.minimum(np.searchsorted(ranges, rows // RANGE), b - a - 1)
            listed = ranges[at] == rows // RANGE
            most = np.where(listed, factor[k] * self.bounds[a + at], 0)
            keep = scores + most + below[k] >= bar
            rows, scores, at, listed = rows[keep], scores[keep], at[keep], listed[keep]
            if listed.any():
                _, held, tf = shard.postings(np.unique(a + at[listed]))
                place = np.minimum(np.searchsorted(held, rows), len(held) - 1)
                hit = held[place] == rows
                scores[hit] += factor[k] * impact(tf[place[hit]], self.penalty[rows[hit]])
        keep = scores >= bar
        rows, scores = rows[keep], scores[keep]
        if len(rows) > best.top:  # whatever is below the tenth of these cannot enter
            least = np.partition(scores, len(scores) - best.top)[len(scores) - best.top]
            rows, scores = rows[scores >= least], scores[scores >= least]
        best.offer(scores, self.ids[rows], self.nulls[rows])


def _best_rows(shards: DataFrame, queries: Queries, weights: np.ndarray, measure: Measure,
               top: int) -> DataFrame:
    """(query, id, score): the best rows of each task's shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(top) for _ in queries.own]
        for row in _shards(batches):
            searcher = Searcher(row, queries.terms, weights, measure)
            for own, kept in zip(queries.own, best):
                searcher.search(own, kept)
        rows = [(q, -entry[2] if entry[1] else None, entry[0])
                for q, kept in enumerate(best) for entry in kept.heap]
        yield pa.RecordBatch.from_pylist(
            [dict(zip(("query", "id", "score"), r)) for r in rows],
            pa.schema([("query", pa.int64()), ("id", pa.int64()), ("score", pa.int64())]))

    return shards.mapInArrow(run, "query long, id long, score long")


def _blocks(items: DataFrame, limit: int) -> Iterator[list]:
    """Rows (item, text) in blocks of about `limit` bytes of text, through the driver."""
    held, size = [], 0
    for row in items.toLocalIterator():
        held.append(row)
        size += len(row["text"] or "") + 64
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def ranked(docs: DataFrame, items: DataFrame, *, id_column: str = "doc_id",
           text_column: str = "text", item_id: str = "item_id", item_text: str = "text",
           top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item, rank, id, score): the `top` documents of each item, best first, equal scores by id."""
    shards = index(docs, id_column, text_column)
    total = shards.agg(F.sum("n_filled").alias("n"), F.sum("n_terms").alias("l")).first()
    measure = Measure(total["n"] or 0, max(total["l"] or 0, 1))
    spark = docs.sparkSession
    wanted = items.select(col(item_id).alias("item"), col(item_text).alias("text"))
    kind = wanted.schema["item"].dataType
    schema = T.StructType([
        T.StructField(item_id, kind), T.StructField("rank", T.IntegerType()),
        T.StructField(id_column, T.LongType()), T.StructField("score", T.LongType())])
    found = spark.createDataFrame([], schema)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    for block in _blocks(wanted, block_bytes):
        queries = Queries.of([row["text"] for row in block])
        weights = measure.weights(rows_per_term(shards, queries.terms))
        names = spark.createDataFrame(
            [(q, row["item"]) for q, row in enumerate(block)],
            T.StructType([T.StructField("query", T.LongType()), T.StructField("item", kind)]))
        best = (
            _best_rows(shards, queries, weights, measure, top)
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
            .join(names, "query")
            .select(F.col("item").alias(item_id), "rank", F.col("id").alias(id_column), "score")
        )
        found = found.union(best)
    return found
