"""Exchange of all training words between classes, over rows that pack many counts.

The texts are read once, into lines of word codes and into what stands beside rare words. Codes of
frequent words (the core) and of the end token are places in a list that tasks are sent; a rare
word's code tells its shape only. The rare words of a bucket of hashes are kept in one file: their
neighbours from the core, and the rare words that they stand beside. Every turn a task looks up the
classes of core neighbours, gets those of rare ones as messages from their buckets, moves its words
and tells the next turn their classes. Core words are moved by the tasks that sum their contexts.
Words themselves are never sent again, and no row is kept per pair of words.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tabulyze.llm.batches import LOWER, NOT_SPACE, Slice, mix, slices
from tabulyze.llm.runs import blobs, numbers, starts, whole_runs
from tabulyze.llm.shared_files import read_file, remove_folder, write_file
from tabulyze.session import scratch_path

PACKED = "kind int, at long, h binary, v binary, n binary, m long"
LINE, WORDS, BESIDE, EDGE = range(4)  # what the texts give
LABEL, MESSAGE, CONTEXT, PAIR = range(4, 8)  # what a turn gives
PORTION = 400_000  # tokens of texts whose counts are packed together
CODES = 1 << 15  # of one line
SPAN = 2048  # core words whose contexts travel together
PAIR_PLACES = 16
CHUNK = 20_000  # words moved at once in a task
MOST_PARTITIONS = 1 << 14


def shaped_words(part: Slice, shapes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and shapes of all words, and the bounds of each text in them."""
    lowered = LOWER[part.data]
    spans = part.words(NOT_SPACE)
    tail = np.zeros(len(spans), np.uint64)
    for k in range(1, 4):
        at = spans.ends - k
        tail = tail * np.uint64(256) + np.where(at >= spans.starts, lowered[at], 0).astype(
            np.uint64)
    shape = (mix(tail + np.uint64(1)) % np.uint64(shapes)).astype(np.int32)
    return spans.hashes(lowered), shape, spans.bounds


def places(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of each hash in a sorted list, -1 for the others."""
    if not len(known):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return np.where(known[at] == hashes, at, -1)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds, at, h, v, n, m = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(kinds, pa.int32()), pa.array(at, pa.int64()), pa.array(h, pa.binary()),
         pa.array(v, pa.binary()), pa.array(n, pa.binary()), pa.array(m, pa.int64())],
        names=["kind", "at", "h", "v", "n", "m"])


def _row(kind: int, at: int, h: bytes | np.ndarray = b"", v: bytes | np.ndarray = b"",
         n: bytes | np.ndarray = b"", m: int = 0) -> tuple:
    packed = (x if isinstance(x, bytes) else x.tobytes() for x in (h, v, n))
    return (kind, int(at), *packed, m)


def _summed(h: np.ndarray, v: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Counts of equal (h, v), sorted."""
    if not len(h):
        return h, v, n
    order = np.lexsort((v, h))
    h, v, n = h[order], v[order], n[order]
    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (v[1:] != v[:-1])))
    return h[first], v[first], np.add.reduceat(n, first).astype(n.dtype)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(h.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _by_bucket(kind: int, at: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """Rows of parallel columns, one for each bucket."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    bounds = np.append(starts(at), len(at))
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        yield _row(kind, at[lo], *(c[order[lo:hi]] for c in columns))


def packed_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows, read back from a table split by kind, and its path."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").partitionBy("kind").parquet(path)
    return df.sparkSession.read.schema(PACKED).parquet(path).select(*df.columns), path


def portions(texts: DataFrame, known: np.ndarray, shapes: int, buckets: int) -> DataFrame:
    """Lines of codes, and the words, core neighbours and rare neighbours of rare words.

    The code of a core word is its place in `known`, that of the end token the next one, that of a
    rare word that of the end, plus one, plus its shape. A line starts at the last code before it.
    """
    spark = texts.sparkSession
    shared, end = spark.sparkContext.broadcast(known), len(known)

    def rare_rows(codes: np.ndarray, words: np.ndarray) -> Iterator[tuple]:
        here = np.flatnonzero(codes > end)  # a portion begins and ends with an end token
        h, one = words[here], np.ones(len(here), np.int32)
        if not len(h):
            return
        w, shape, n = _summed(h, codes[here] - end - 1, one)
        yield from _by_bucket(WORDS, bucket_of(w, buckets), w, shape, n)
        before, after = codes[here - 1], codes[here + 1]
        w, v, n = _summed(
            np.concatenate([h[before <= end], h[after <= end]]),
            np.concatenate([before[before <= end], after[after <= end] + end + 1]),
            np.concatenate([one[before <= end], one[after <= end]]))
        yield from _by_bucket(BESIDE, bucket_of(w, buckets), w, v, n)
        second = here[before > end]
        if len(second):
            a, b, n = _summed(words[second - 1], words[second], np.ones(len(second), np.int32))
            # The sender's class stands on side 0 (before) or 1 (after) of the other word.
            sender, told = np.concatenate([a, b]), np.concatenate([b, a])
            side = np.repeat([0, 1], len(a)).astype(np.int32)
            yield from _by_bucket(EDGE, bucket_of(sender, buckets), sender, told,
                                  np.tile(n, 2) * 2 + side)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = (np.array([end], np.int32), np.zeros(1, np.int64))
        held, size = [start], 0

        def flush() -> Iterator[pa.RecordBatch]:
            codes, words = (np.concatenate(x) for x in zip(*held))
            yield _batch([_row(LINE, 0, v=codes[lo:lo + CODES + 1])
                          for lo in range(0, len(codes) - 1, CODES)])
            rows = list(rare_rows(codes, words))
            if rows:
                yield _batch(rows)

        for batch in batches:
            for part in slices(batch.column(0)):
                found, shape, bounds = shaped_words(part, shapes)
                codes = np.full(len(found) + len(part), end, np.int32)
                words = np.zeros(len(codes), np.int64)
                at = np.arange(len(found)) + np.repeat(np.arange(len(part)), np.diff(bounds))
                place = places(shared.value, found)
                codes[at] = np.where(place >= 0, place, end + 1 + shape)
                words[at] = found.view(np.int64)
                held.append((codes, words))
                size += len(codes)
                if size > PORTION:
                    yield from flush()
                    held, size = [start], 0
        if size:
            yield from flush()

    return packed_table(texts.mapInArrow(pack, PACKED), "links")[0]


@dataclass
class Turn:
    """What tasks need to move words: transitions, class sizes, and the classes of the core."""

    classes: int
    half: int
    core: np.ndarray  # with the end token
    follow: np.ndarray
    sizes: np.ndarray

    def best(self, contexts: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Likeliest class by the counts (words x side x class); the own one if none is better."""
        gain = contexts[:, 0] @ self.follow + contexts[:, 1] @ self.follow.T
        gain -= contexts[:, 0].sum(axis=1, keepdims=True) * np.log(self.sizes + 1.0)
        gain[:, self.classes] = -np.inf
        best = np.argmax(gain, axis=1)
        rows = np.arange(len(own))
        return np.where(gain[rows, best] > gain[rows, own] + 1e-9, best, own)

    def moves(self, words: np.ndarray) -> np.ndarray:
        return (mix(words.astype(np.int64).view(np.uint64)) & np.uint64(1)).astype(int) == self.half


class CoreContexts:
    """Counts of the classes beside the core words that move, and of class pairs, in a task."""

    def __init__(self, turn: Turn) -> None:
        self.turn, self.n = turn, turn.classes + 1
        # Words that stay share a last row, and a class n of no word is counted apart, so that
        # nothing need be picked out before it is counted. Code len(core) stands for rare words.
        self.wide, moving = self.n + 1, np.flatnonzero(turn.moves(np.arange(len(turn.core) - 1)))
        self.row = np.full(len(turn.core) + 1, len(moving))
        self.row[moving], self.moving = np.arange(len(moving)), moving
        self.row *= 2 * self.wide
        self.cells = np.zeros((len(moving) + 1) * 2 * self.wide, np.int32)
        self.pairs = np.zeros(self.n * self.n, np.int64)

    def add(self, words: np.ndarray, side: np.ndarray | int, k: np.ndarray,
            n: np.ndarray) -> None:
        cell = self.row[words]
        cell += side * self.wide + k
        np.add.at(self.cells, cell, n)

    def add_pairs(self, before: np.ndarray, after: np.ndarray, n: np.ndarray | None) -> None:
        cell = before * self.n + after
        self.pairs += np.bincount(cell, n, len(self.pairs)).astype(np.int64)

    def batches(self) -> Iterator[pa.RecordBatch]:
        wide, span_of = 2 * self.n, self.moving // SPAN
        rows, bounds = [], np.append(starts(span_of), len(span_of))
        counted = self.cells.reshape(-1, 2, self.wide)
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            cells = counted[lo:hi, :, :self.n].reshape(-1)
            cell = np.flatnonzero(cells)
            if len(cell):
                local = (self.moving[lo + cell // wide] % SPAN) * wide + cell % wide
                rows.append(_row(CONTEXT, span_of[lo], v=local.astype(np.int32), n=cells[cell]))
        cell = np.flatnonzero(self.pairs)
        if len(cell):
            place = TaskContext.get().partitionId() % PAIR_PLACES
            rows.append(_row(PAIR, -1 - place, v=cell.astype(np.int32), n=self.pairs[cell]))
        if rows:
            yield _batch(rows)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each value of `at`, from rows sorted by it."""
    for table in whole_runs(batches, 1):
        at = numbers(table, "at")
        bounds = np.append(starts(at), len(at))
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            yield int(at[lo]), table.slice(lo, hi - lo)


def _of_kind(rows: pa.Table, kind: int, wide: str = "<i4") -> tuple[np.ndarray, ...]:
    some = rows.filter(pa.array(numbers(rows, "kind") == kind))
    if not some.num_rows:
        return np.zeros(0, "<i8"), np.zeros(0, wide), np.zeros(0, "<i4")
    return tuple(blobs(some, c, t)[0] for c, t in (("h", "<i8"), ("v", wide), ("n", "<i4")))


def _messages(static: dict, labels: np.ndarray, n: int) -> Iterator[tuple]:
    """What rare words tell those they stand beside, a row for each bucket told."""
    side, uses = static["edge_n"] & 1, static["edge_n"] >> 1
    cell = (side * n + labels[static["edge_of"]]).astype(np.int32)
    bounds = np.append(starts(static["edge_at"]), len(static["edge_at"]))
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        yield _row(MESSAGE, static["edge_at"][lo], static["edge_to"][lo:hi], cell[lo:hi],
                   uses[lo:hi])


def rare_files(linked: DataFrame, of_shape: np.ndarray, classes: int, buckets: int) -> DataFrame:
    """Files of rare words by bucket, and their first labels and messages."""
    spark = linked.sparkSession
    folder, n = scratch_path(spark, "rare-words"), classes + 1

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, rows in _buckets(batches):
            h, shape, uses = _summed(*_of_kind(rows, WORDS))
            w, first = np.unique(h, return_index=True)
            shapes = shape[first]
            beside = _summed(*_of_kind(rows, BESIDE))
            sender, told, edge = _of_kind(rows, EDGE, "<i8")
            to = bucket_of(told, buckets)
            order = np.lexsort((told, to))
            static = {
                "w": w, "shape": shapes, "c": np.add.reduceat(uses, first),
                "of": np.searchsorted(w, beside[0]).astype(np.int32), "code": beside[1],
                "n": beside[2],
                "edge_of": np.searchsorted(w, sender[order]).astype(np.int32),
                "edge_to": told[order], "edge_at": to[order], "edge_n": edge[order]}
            out = io.BytesIO()
            np.savez(out, **static)
            packed = pa.compress(out.getvalue(), "zstd", asbytes=True)
            path = write_file(folder, f"bucket-{at}", [len(out.getvalue()).to_bytes(8), packed])
            labels = of_shape[shapes].astype(np.int16)
            yield _batch([_row(LABEL, at, path.encode(), labels), *_messages(static, labels, n)])

    rows = linked.filter(F.col("kind").isin(WORDS, BESIDE, EDGE)).select(*linked.columns)
    return packed_table(_in_buckets(rows, buckets).mapInArrow(build, PACKED), "turn")


def _in_buckets(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.repartition(min(buckets, MOST_PARTITIONS), "at").sortWithinPartitions("at")


def _static(path: str) -> dict:
    packed = read_file(path)
    size = int.from_bytes(packed[:8])
    with np.load(io.BytesIO(pa.decompress(packed[8:], size, "zstd", asbytes=True))) as held:
        return {k: held[k] for k in held.files}


def _labelled(rows: pa.Table) -> tuple[str, np.ndarray]:
    row = rows.filter(pa.array(numbers(rows, "kind") == LABEL)).select(["h", "v"]).to_pylist()[0]
    return row["h"].decode(), np.frombuffer(row["v"], np.int16).astype(np.int64)


def _lines(shared):
    """mapInArrow over lines of codes: the contexts that core words are to each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = CoreContexts(shared.value), shared.value.classes + 1
        rare = len(shared.value.core)
        core, ones = np.append(shared.value.core, n), np.ones(CODES, np.int32)
        pairs = np.zeros((n + 1) * (n + 1), np.int64)
        for batch in batches:
            for line in batch.column(0):
                codes = np.minimum(np.frombuffer(line.as_buffer(), np.int32), rare).astype(np.intp)
                k = core[codes]
                before, after, one = k[:-1], k[1:], ones[:len(k) - 1]
                held.add(codes[:-1], 1, after, one)
                held.add(codes[1:], 0, before, one)
                pairs += np.bincount(before * (n + 1) + after, minlength=len(pairs))
        held.pairs += pairs.reshape(n + 1, n + 1)[:n, :n].reshape(-1)
        yield from held.batches()

    return run


def _rare_words(shared):
    """mapInArrow over labels and messages, sorted by bucket: labels and messages after the turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = shared.value
        held, n, size = CoreContexts(turn), turn.classes + 1, len(turn.core)
        for at, rows in _buckets(batches):
            path, own = _labelled(rows)
            static = _static(path)
            w, of, uses = static["w"], static["of"], static["n"]
            side, beside = np.divmod(static["code"], size)
            k = turn.core[beside]
            held.add(beside, 1 - side, own[of], uses)
            mine = own[of]
            held.add_pairs(np.where(side == 0, k, mine), np.where(side == 0, mine, k), uses)
            told, cell, times = _of_kind(rows, MESSAGE)
            to = np.searchsorted(w, told)
            first = cell < n
            held.add_pairs(cell[first], own[to[first]], times[first])
            order = np.argsort(to, kind="stable")
            to, cell, times = to[order], cell[order], times[order]
            new, moves = own.copy(), turn.moves(w)
            for lo in range(0, len(w) if turn.half >= 0 else 0, CHUNK):
                hi = min(lo + CHUNK, len(w))
                a, b = np.searchsorted(of, [lo, hi])
                c, d = np.searchsorted(to, [lo, hi])
                cells = np.concatenate([((of[a:b] - lo) * 2 + side[a:b]) * n + k[a:b],
                                        (to[c:d] - lo) * 2 * n + cell[c:d]])
                contexts = np.bincount(cells, np.concatenate([uses[a:b], times[c:d]]),
                                       (hi - lo) * 2 * n).reshape(hi - lo, 2, n)
                moving = np.flatnonzero(moves[lo:hi])
                new[lo + moving] = turn.best(contexts[moving], own[lo + moving])
            yield _batch([
                _row(LABEL, at, path.encode(), new.astype(np.int16), m=int((new != own).sum())),
                *_messages(static, new, n)])
        yield from held.batches()

    return run


def _core_words(shared):
    """mapInArrow over contexts and pairs, sorted by place: new classes, and sums of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, n = shared.value, shared.value.classes + 1
        held, cells = None, np.zeros(0)

        def done() -> pa.RecordBatch:
            if held < 0:
                at = np.flatnonzero(cells)
                new = np.full(len(at), -1)
                w, uses = at, cells[at].astype(np.int64)
            else:
                w = np.arange(held * SPAN, min((held + 1) * SPAN, len(turn.core) - 1))
                w = w[turn.moves(w)]
                contexts = cells.reshape(SPAN, 2, n)[w - held * SPAN]
                new, uses = turn.best(contexts, turn.core[w]), np.zeros(len(w), np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(w), pa.array(new.astype(np.int32)), pa.array(uses)],
                names=["w", "k", "n"])

        for batch in batches:  # a place's rows are summed as they come, never held together
            for at, v, uses in zip(*(batch.column(i) for i in range(3))):
                if at.as_py() != held:
                    if held is not None:
                        yield done()
                    held = at.as_py()
                    cells = np.zeros(n * n if held < 0 else SPAN * 2 * n)
                cells[np.frombuffer(v.as_buffer(), np.int32)] += np.frombuffer(
                    uses.as_buffer(), np.int64 if held < 0 else np.int32)
        if held is not None:
            yield done()

    return run


def exchange_words(linked: DataFrame, turn_rows: tuple[DataFrame, str], core: np.ndarray,
                   pairs: np.ndarray, words: int, classes: int, buckets: int, few_moves: float,
                   least_rise: float) -> tuple[np.ndarray, DataFrame, np.ndarray]:
    """Classes of core words and the end, (h, c, k, shape) of rare words, and the class bigrams.

    Starts from those given; `words` is the number of all training words. Each turn's table goes
    once the next one is written.
    """
    spark = linked.sparkSession
    n = classes + 1
    lines = linked.filter(F.col("kind") == LINE).select("v")
    rows, path = turn_rows
    before_sweep, moved, half = likelihood(pairs), 0, 0
    while True:  # half 0 and half 1 make a sweep; half -1 only counts
        follow = np.log((pairs + 0.5) / (pairs.sum(axis=1, keepdims=True) + 0.5 * n))
        shared = spark.sparkContext.broadcast(
            Turn(classes, half, core, follow, pairs.sum(axis=0)))
        kept = rows.filter(F.col("kind").isin(LABEL, MESSAGE))
        out, new_path = packed_table(
            _in_buckets(kept, buckets).mapInArrow(_rare_words(shared), PACKED)
            .union(lines.mapInArrow(_lines(shared), PACKED)), "turn")
        found = (
            out.filter(F.col("kind").isin(CONTEXT, PAIR)).select("at", "v", "n")
            .repartition("at").sortWithinPartitions("at")
            .mapInArrow(_core_words(shared), "w long, k int, n long").toArrow())
        w, k, uses = (found[c].to_numpy() for c in ("w", "k", "n"))
        flat = np.zeros(n * n)
        np.add.at(flat, w[k < 0], uses[k < 0])
        pairs = flat.reshape(n, n)
        remove_folder(path)
        rows, path = out, new_path
        if half < 0:
            return core, labelled_words(rows), pairs
        new = core.copy()
        new[w[k >= 0]] = k[k >= 0]
        moved += int((new != core).sum()) + (
            rows.filter(F.col("kind") == LABEL).agg(F.sum("m")).first()[0] or 0)
        core = new
        shared.unpersist()
        if half == 0:
            half = 1
            continue
        now = likelihood(pairs)
        settled = moved <= few_moves * words \
            or now - before_sweep <= least_rise * abs(before_sweep)
        before_sweep, moved, half = now, 0, -1 if settled else 0


def labelled_words(rows: DataFrame) -> DataFrame:
    """(h, c, k, shape) of all rare words: hash, count, class and shape."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, labels in zip(batch.column(0), batch.column(1)):
                static = _static(path.as_py().decode())
                k = np.frombuffer(labels.as_buffer(), np.int16).astype(np.int32)
                whole = pa.RecordBatch.from_arrays(
                    [pa.array(static["w"]), pa.array(static["c"].astype(np.int64)), pa.array(k),
                     pa.array(static["shape"].astype(np.int32))], names=["h", "c", "k", "shape"])
                for lo in range(0, len(k), 1 << 16):
                    yield whole.slice(lo, 1 << 16)

    return rows.filter(F.col("kind") == LABEL).select("h", "v").mapInArrow(
        read, "h long, c long, k int, shape int")


def likelihood(pairs: np.ndarray) -> float:
    """Log likelihood of the classes, up to what does not depend on them."""
    cells = (pairs, pairs.sum(axis=0), pairs.sum(axis=1))
    inner, left, right = (float((x * np.log(np.maximum(x, 1))).sum()) for x in cells)
    return inner - left - right
