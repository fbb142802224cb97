"""Scoring by a class-based n-gram model whose classes come from exchange clustering.

P(word | word before) = P(class | class before) * P(word | class).

Every training word has a class of its own choice. A start is found on units: the `units` most
frequent words, and the shapes (a hash of the last three bytes) of all others. From there all words
are exchanged: each turn counts the classes before and after every word, and moves every second
word to the class under which they are likeliest, until a sweep of two turns moves few words or
no longer raises the likelihood. Transitions of a turn are those counted by the turn before. Words
unseen in training take the class that most training words of their shape have.

Word counts and classes are kept for all words: those of the most frequent ones (at most
`core_words`) are sent to the tasks, all others are tables joined with the rare words of the texts.
Neither list is ever cut: the bounds only choose the way.

Emission is (c + 1) / (N_class + V_class + 1); transitions are smoothed towards the frequency of
the class. Words are compared by 64-bit hashes.

Defined results: null and empty texts hold the end token only; a null id takes part in training;
without training texts all counts are zero; repeated rows count each time; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabulyze.functions.columns import col
from tabulyze.llm.batches import Slice, slices
from tabulyze.llm.stamping import stamped, written
from tabulyze.llm.word_exchange import (
    CODES, LINE, exchange_words, places, portions, rare_files, shaped_words,
)

FOLDS, HELD_OUT = 7, 2
END_HASH = np.uint64(0x8000000000000001)
PENDING = 600_000


@dataclass(frozen=True)
class ClassOptions:
    classes: int = 48
    units: int = 2048
    shapes: int = 1024
    core_words: int = 1 << 17
    rounds: int = 5  # of the start; the exchange of all words ends by the next two
    few_moves: float = 0.01
    least_rise: float = 1e-3
    backoff: float = 5.0
    bucket: int = 200_000  # uses of rare words kept in one file

    @property
    def n_units(self) -> int:
        """Frequent words, shapes, and the end token."""
        return self.units + self.shapes + 1


class Tally:
    """Counts of keys from many portions, in sorted arrays."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        self.held += len(keys)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in self.parts])
        counts = np.concatenate([c for _, c in self.parts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return keys[first], np.add.reduceat(counts, first)


def word_counts(texts: DataFrame, options: ClassOptions) -> DataFrame:
    """(h, shape, c) for all tokens of a table (text); the end token has shape -1."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, shape_of, ends = Tally(), [], 0

        def flush() -> pa.RecordBatch:
            keys, counts = tally.merged()
            k, s = (np.concatenate(x) for x in zip(*shape_of))
            _, first = np.unique(k, return_index=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys.view(np.int64)), pa.array(s[first]), pa.array(counts)],
                names=["h", "shape", "c"])

        for batch in batches:
            for part in slices(batch.column(0)):
                hashes, shape, _ = shaped_words(part, options.shapes)
                keys, first, n = np.unique(hashes, return_index=True, return_counts=True)
                ends += len(part)
                if len(keys):
                    tally.add(keys, n.astype(np.int64))
                    shape_of.append((keys, shape[first]))
                if tally.held > PENDING:
                    yield flush()
                    tally, shape_of = Tally(), []
        if tally.held:
            yield flush()
        if ends:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array([END_HASH]).view(np.int64)), pa.array([-1], pa.int32()),
                 pa.array([ends], pa.int64())], names=["h", "shape", "c"])

    return (
        texts.mapInArrow(count, "h long, shape int, c long")
        .groupBy("h").agg(F.first("shape").alias("shape"), F.sum("c").alias("c"))
    )


@dataclass
class Core:
    """The frequent words, by hash: their counts, shapes and units (-1: that of their shape)."""

    hashes: np.ndarray
    counts: np.ndarray
    units: np.ndarray
    shapes: np.ndarray


def frequent(counts: DataFrame, options: ClassOptions) -> tuple[Core, int]:
    """Words whose count reaches the least level at which `core_words` hold them all."""
    level = F.floor(F.log(F.col("c").cast("double")) * 64).cast("int")
    words = counts.filter(F.col("shape") >= 0)
    levels = sorted(((r["l"], r["n"]) for r in words.groupBy(level.alias("l")).agg(
        F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    total, least = 0, None
    for at, n in levels:
        if total + n > options.core_words:
            break
        total, least = total + n, at
    if least is None:
        empty = np.zeros(0, np.int64)
        return Core(empty.view(np.uint64), empty, empty, empty), 1 << 30
    rows = words.filter(level >= least).select("h", "c", "shape").toArrow()
    hashes = rows["h"].to_numpy().view(np.uint64)
    counted, shapes = rows["c"].to_numpy(), rows["shape"].to_numpy()
    order = np.lexsort((hashes, -counted))
    units = np.full(len(hashes), -1)
    units[order[:options.units]] = np.arange(min(options.units, len(order)))
    by_hash = np.argsort(hashes)
    return Core(hashes[by_hash], counted[by_hash], units[by_hash], shapes[by_hash]), least


def is_rare(least: int) -> Column:
    """Whether a row of the word counts is a word outside the core."""
    level = F.floor(F.log(F.col("c").cast("double")) * 64)
    return (F.col("shape") >= 0) & (level < least)


def unit_bigrams(lines: DataFrame, core: Core, options: ClassOptions) -> DataFrame:
    """(a, b, n): how often unit b follows unit a in lines of codes; texts begin after an end."""
    n_units = options.n_units
    unit_of = np.concatenate([  # of core words, the end, and the shapes of others
        np.where(core.units >= 0, core.units, options.units + core.shapes),
        [n_units - 1], options.units + np.arange(options.shapes)]).astype(np.int64)
    shared = lines.sparkSession.sparkContext.broadcast(unit_of)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, ones = np.zeros(n_units * n_units, np.int32), np.ones(CODES, np.int32)
        for batch in batches:
            for line in batch.column(0):
                units = shared.value[np.frombuffer(line.as_buffer(), np.int32)]
                np.add.at(cells, units[:-1] * n_units + units[1:], ones[:len(units) - 1])
        found = np.flatnonzero(cells)
        step = 1 << 17
        for lo in range(0, len(found), step):
            some = found[lo:lo + step]
            yield pa.RecordBatch.from_arrays([
                pa.array((some // n_units).astype(np.int32)),
                pa.array((some % n_units).astype(np.int32)),
                pa.array(cells[some].astype(np.int64))], names=["a", "b", "n"])

    return (lines.mapInArrow(count, "a int, b int, n long")
            .groupBy("a", "b").agg(F.sum("n").alias("n")))


def _contexts(bigrams: DataFrame, classes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the class before and the class after each unit (units x classes)."""
    spark = bigrams.sparkSession
    named = F.broadcast(spark.createDataFrame(  # a row per unit, fixed by the options
        [(int(u), int(c)) for u, c in enumerate(classes)], "u int, k int"))
    before = bigrams.join(named, F.col("a") == F.col("u")).groupBy(
        F.lit(0).alias("side"), F.col("b").alias("v"), "k")
    after = bigrams.join(named, F.col("b") == F.col("u")).groupBy(
        F.lit(1).alias("side"), F.col("a").alias("v"), "k")
    rows = before.agg(F.sum("n").alias("n")).union(after.agg(F.sum("n").alias("n"))).toArrow()
    out = np.zeros((2, len(classes), n), np.float64)
    out[rows["side"].to_numpy(), rows["v"].to_numpy(), rows["k"].to_numpy()] = rows["n"].to_numpy()
    return out[0], out[1]


def exchange(bigrams: DataFrame, options: ClassOptions) -> tuple[np.ndarray, np.ndarray]:
    """Class of each unit, and the class bigrams. The end token is a class of its own."""
    n, end = options.classes + 1, options.n_units - 1
    classes = np.arange(options.n_units) % options.classes
    classes[end] = options.classes
    for turn in range(options.rounds + 1):
        left, right = _contexts(bigrams, classes, n)
        pairs = np.zeros((n, n))
        np.add.at(pairs.T, classes, left)  # pairs[c, k]: class c before a unit of class k
        if turn == options.rounds:
            return classes, pairs
        sizes = pairs.sum(axis=0)
        follow = np.log((pairs + 0.5) / (pairs.sum(axis=1, keepdims=True) + 0.5 * n))
        own = left.sum(axis=1, keepdims=True)
        gain = left @ follow + right @ follow.T - own * np.log(sizes + 1.0)
        gain[:, options.classes] = -np.inf
        best = np.argmax(gain, axis=1)
        moves = (np.arange(len(classes)) % 2 == turn % 2) & (own[:, 0] > 0)
        moves[end] = False
        classes = np.where(moves, best, classes)
    raise AssertionError


@dataclass
class Model:
    core: Core
    class_of: np.ndarray  # of core words and the end
    of_shape: np.ndarray
    follow: np.ndarray
    emit_total: np.ndarray
    tokens: int
    words: int
    end_count: int


def fit(training: DataFrame, options: ClassOptions) -> tuple[Model, DataFrame]:
    """The model of a table (text), and counts and classes (h, c, k) of all rare words."""
    counts = written(word_counts(training, options), "word-counts")
    core, least = frequent(counts, options)
    rare_words = F.sum(F.when(is_rare(least), F.col("c")))
    totals = {r["end"]: r for r in counts.groupBy((F.col("shape") < 0).alias("end")).agg(
        F.count(F.lit(1)).alias("v"), F.sum("c").alias("n"),
        rare_words.alias("rare")).collect()}
    totals = {end: (r["v"], r["n"], r["rare"] or 0) for end, r in totals.items()}
    buckets = max(1, -(-totals.get(False, (0, 0, 0))[2] // options.bucket))
    end_count = totals.get(True, (0, 0, 0))[1]
    linked = portions(training, core.hashes, options.shapes, buckets)
    bigrams = written(
        unit_bigrams(linked.filter(F.col("kind") == LINE).select("v"), core, options),
        "unit-bigrams")
    units, pairs = exchange(bigrams, options)
    start = np.append(units[np.where(core.units >= 0, core.units, options.units + core.shapes)],
                      options.classes).astype(np.int64)
    class_of, labelled, pairs = exchange_words(
        linked, rare_files(linked, units[options.units:-1], options.classes, buckets), start,
        pairs, totals.get(False, (0, 0, 0))[0], options.classes, buckets, options.few_moves,
        options.least_rise)
    rare = written(labelled, "rare-words")
    v, n = np.zeros(options.classes + 1), np.zeros(options.classes + 1)
    kinds = np.zeros((options.shapes, options.classes + 1), np.int64)
    np.add.at(v, class_of[:-1], 1)
    np.add.at(n, class_of[:-1], core.counts)
    np.add.at(kinds, (core.shapes, class_of[:-1]), 1)
    v[-1], n[-1] = totals.get(True, (0, 0, 0))[:2]
    for r in rare.groupBy("shape", "k").agg(
            F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).collect():
        v[r["k"]], n[r["k"]] = v[r["k"]] + r["v"], n[r["k"]] + r["n"]
        kinds[r["shape"], r["k"]] += r["v"]
    kinds[kinds.sum(axis=1) == 0] = kinds.sum(axis=0)
    share = (pairs.sum(axis=0) + 1) / (pairs.sum() + len(pairs))
    follow = np.log10((pairs + options.backoff * share)
                      / (pairs.sum(axis=1, keepdims=True) + options.backoff))
    model = Model(core, class_of, np.argmax(kinds, axis=1), follow, np.log10(n + v + 1),
                  sum(t[1] for t in totals.values()), sum(t[0] for t in totals.values()),
                  end_count)
    return model, rare.select("h", "c", "k")


KNOWN = pa.schema([
    ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("log_counts", pa.float64()),
    ("line", pa.binary()), ("rare", pa.list_(pa.int64())),
])
KNOWN_DDL = "n_tokens long, n_known long, log_counts double, line binary, rare array<long>"
UNSURE = 128


def _known(part: Slice, model: Model, options: ClassOptions) -> list[pa.Array]:
    """Per text: what core words and the end give, the classes of all words, and the other words.

    Classes are a byte each; those of other words are the ones of their shapes, plus UNSURE.
    """
    hashes, shape, bounds = shaped_words(part, options.shapes)
    at = places(model.core.hashes, hashes)
    text = np.repeat(np.arange(len(part)), np.diff(bounds))
    known = at >= 0
    logs = np.log10(model.core.counts + 1.0) if len(model.core.counts) else np.zeros(1)
    ends_known = int(model.end_count > 0)
    log_counts = np.bincount(text, np.where(known, logs[at], 0.0), len(part)).astype(np.float64)
    log_counts += np.log10(model.end_count + 1.0)
    line = np.where(known, model.class_of[at], model.of_shape[shape] + UNSURE).astype(np.uint8)
    rare = np.flatnonzero(~known)
    return [
        pa.array(np.diff(bounds) + 1),
        pa.array(np.bincount(text, known, len(part)).astype(np.int64) + ends_known),
        pa.array(log_counts),
        pa.array([line[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary()),
        pa.ListArray.from_arrays(
            pa.array(np.searchsorted(rare, bounds).astype(np.int32)),
            pa.array(hashes[rare].view(np.int64))),
    ]


def _structure(line: bytes, found: np.ndarray, model: Model, end: int) -> float:
    """The class terms of a text; `found` holds place * 256 + class of other words seen."""
    classes = np.frombuffer(line, np.uint8).astype(np.int64)
    rare = np.flatnonzero(classes >= UNSURE)
    classes[rare] -= UNSURE
    classes[rare[found >> 8]] = found & 255
    after = np.append(classes, end)
    return float((model.follow[np.append(end, classes), after] - model.emit_total[after]).sum())


def scored(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
           options: ClassOptions = ClassOptions()) -> DataFrame:
    """One row per text: whether it was held out, token counts, and both log10 scores."""
    spark = docs.sparkSession
    fold = F.pmod(F.crc32(F.coalesce(col(id_column).cast("string"), F.lit(""))
                          .cast("binary")), F.lit(FOLDS))
    held = fold == HELD_OUT
    model, others = fit(docs.filter(~held).select(col(text_column)), options)
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf(KNOWN_DDL)
    def judge(texts: pa.Array) -> pa.Array:
        parts = [_known(p, shared.value, options) for p in slices(texts)]
        if not parts:
            return pa.array([], pa.struct(KNOWN))
        return pa.StructArray.from_arrays(
            [pa.concat_arrays(list(c)) for c in zip(*parts)], fields=list(KNOWN))

    @F.arrow_udf("double")
    def structure(lines: pa.Array, found: pa.Array) -> pa.Array:
        none = np.zeros(0, np.int64)
        return pa.array([
            _structure(a.as_py(), b.values.to_numpy() if b.is_valid else none, shared.value,
                       options.classes)
            for a, b in zip(lines, found)], pa.float64())

    rows = stamped(docs.select(
        col(id_column).alias("id"), held.alias("held_out"),
        judge(col(text_column)).alias("s")).select("id", "held_out", "s.*"), "scores")
    pairs = rows.select("row_uid", F.posexplode("rare").alias("at", "h"))
    more = (
        pairs.join(others, "h").groupBy("row_uid")
        .agg(F.count(F.lit(1)).alias("known"), F.sum(F.log10(F.col("c") + 1.0)).alias("logs"),
             F.collect_list(F.col("at").cast("long") * 256 + F.col("k")).alias("found"))
    )
    found = rows.drop("rare").join(more, "row_uid", "left")
    logs = F.col("log_counts") + F.coalesce("logs", F.lit(0.0))
    return found.select(
        F.col("id").alias(id_column), "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0).cast("long"))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * float(np.log10(model.tokens + model.words + 1)))
        .alias("base_score"),
        (logs + structure("line", "found")).alias("score"))
