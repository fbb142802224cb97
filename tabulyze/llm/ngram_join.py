"""Self-join of texts by the Jaccard similarity of their word n-grams, by prefix filtering.

Equal sets are one class, known by a 64-bit digest. The n-grams of a class are ordered by rarity:
first those no other class has, then by the number of classes that have them, last the frequent
ones. Of two linked sets each must hold one of the other's n-grams in a prefix whose length
follows from the threshold, so a class whose prefix is filled by n-grams of its own links with
nothing. What two classes share are n-grams that both have, so a class is recorded by those of its
n-grams that another class has, and by the size of its set.

Classes are joined on prefix n-grams. Every class is sent with its record to the `homes` most
common n-grams of its prefix, where the classes that meet are compared: lengths first, then a
bound of the overlap from the counts of n-grams by part of the hash range, then the overlap itself,
and only while the two are not yet connected. Pairs that meet elsewhere only, which no home
covers, must pass the length, positional and suffix filters; they are verified once, by a join with
the records. Large homes are dealt into chunks, each pair of which is a task's work.

N-grams in more than `frequent` of the documents (counted where they occur twice in a portion of
documents) stay out of the shuffle by n-gram; there are at most mean set size / `frequent` of them.

Defined results: null texts and texts without words have no shingles and are linked with nothing;
texts with fewer words than `size` have one shingle, the whole sequence; a component whose ids are
all null has a null id; repeated rows and ids are kept; extra columns are ignored. N-grams are told
apart by 56-bit hashes, sets by 64-bit ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabulyze.functions.columns import col
from tabulyze.llm.batches import LOWER, NOT_SPACE, mix, slices, window_hashes
from tabulyze.llm.components import components
from tabulyze.llm.runs import blobs, lists, numbers, ragged, starts, whole_runs
from tabulyze.llm.simhash import Forest
from tabulyze.llm.stamping import written

SIZE = 4
PERCENT = 85
FREQUENT = 0.001
HOMES = 3
CHUNK_ROWS = 4096
CHUNK_GRAMS = 1 << 21
PORTION_BYTES = 4 << 20
PORTION_ROWS = 8192
#: Bits of an n-gram's hash; a byte less than a number holds keeps the shuffle smaller.
GRAM_BITS = 56
#: Parts of the hash range by which the suffix filter counts n-grams.
PARTS = 32


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """What a set of n must share with any partner."""
    return -(-percent * n // 100)


def longest_partner(n: np.ndarray, percent: int) -> np.ndarray:
    return 100 * n // percent


def pair_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap at which sets of a and b are linked."""
    return -(-percent * (a + b) // (100 + percent))


@dataclass
class Portion:
    """Sets of some texts: members of set i are grams[first[i]:first[i + 1]], ascending."""

    ids: pa.Array
    sizes: np.ndarray
    digests: np.ndarray
    grams: np.ndarray
    first: np.ndarray

    def once(self) -> np.ndarray:
        """One text of each set that is not empty."""
        filled = np.flatnonzero(self.sizes)
        return filled[np.unique(self.digests[filled], return_index=True)[1]]


def _grams(texts: pa.Array, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For slices of the texts: number of the text and hash of each of its n-grams, distinct."""
    for part in slices(texts):
        spans = part.words(NOT_SPACE)
        words, counts, begin = spans.hashes(LOWER[part.data]), spans.counts(), spans.bounds[:-1]
        found = []
        for n in range(1, size + 1):
            own = np.flatnonzero(counts >= size if n == size else counts == n)
            many = counts[own] - n + 1
            at = ragged(begin[own], many)
            hashes = mix(window_hashes(words, n) ^ mix(np.array([n], np.uint64)))[at]
            found.append((np.repeat(own, many), hashes >> np.uint64(64 - GRAM_BITS)))
        text, gram = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((gram, text))
        text, gram = text[order], gram[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (gram[1:] != gram[:-1])
        yield part.first + text[new], gram[new]


def _portions(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[Portion]:
    """Rows (id, text) in portions bounded by rows and bytes of text."""
    for batch in batches:
        lo = held = 0
        texts = batch.column(1).cast(pa.large_string())
        lengths = np.diff(np.frombuffer(
            texts.buffers()[1], "<i8", len(texts) + 1, 8 * texts.offset)) if len(texts) else []
        for i, n in enumerate([*lengths, 0]):
            if i == len(lengths) or (i > lo and (
                    held + n > PORTION_BYTES or i - lo >= PORTION_ROWS)):
                if i > lo:
                    yield _portion(batch.column(0).slice(lo, i - lo),
                                   texts.slice(lo, i - lo), size)
                lo, held = i, 0
            held += n


def _portion(ids: pa.Array, texts: pa.Array, size: int) -> Portion:
    found = list(_grams(texts, size))
    text, gram = (np.concatenate(x) for x in zip(*found))
    sizes = np.bincount(text, minlength=len(ids))
    first = np.concatenate(([0], np.cumsum(sizes)))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(gram))))
    return Portion(ids, sizes, mix(sums[first[1:]] - sums[first[:-1]] + sizes.astype(np.uint64))
                   .view(np.int64), gram.view(np.int64), first)


def _batch(schema: str, *columns) -> pa.RecordBatch:
    names = [part.split()[0] for part in schema.split(",")]
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)


SEEN = "id long, n long, digest long, gram long, uses long"


def _seen(size: int, frequent: float):
    """Rows of texts, with null gram, and of n-grams met twice or more in a portion."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _portions(batches, size):
            none = pa.nulls(len(part.ids), pa.int64())
            digests = pa.array(part.digests, mask=part.sizes == 0)
            yield _batch(SEEN, part.ids, part.sizes, digests, none, none)
            own = part.once()
            gram, uses = np.unique(
                part.grams[ragged(part.first[own], part.sizes[own])], return_counts=True)
            often = (uses > 1) & (uses >= frequent * len(part.ids))
            gram, uses = gram[often], uses[often]
            none = pa.nulls(len(gram), pa.int64())
            yield _batch(SEEN, none, none, none, gram, uses)

    return run


FLOW = "key long, digest long, n long, often binary"


def _flow(size: int, frequent: np.ndarray, rank: np.ndarray):
    """A row for each n-gram of a class, and one with all its frequent n-grams in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _portions(batches, size):
            own = part.once()
            many = part.sizes[own]
            grams = part.grams[ragged(part.first[own], many)]
            digest, n = np.repeat(part.digests[own], many), np.repeat(many, many)
            if len(frequent):
                at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
                often = frequent[at] == grams
                of = np.repeat(np.arange(len(own)), many)[often]
                order = np.lexsort((rank[at[often]], of))
                of, held = of[order], grams[often][order]
                cut = starts(of)
                ends = np.append(cut[1:], len(of))
                lists = [held[a:b].tobytes() for a, b in zip(cut, ends)]
                key = part.digests[own[of[cut]]]
                yield _batch(FLOW, key, key, many[of[cut]], pa.array(lists, pa.binary()))
                grams, digest, n = grams[~often], digest[~often], n[~often]
            yield _batch(FLOW, grams, digest, n, pa.nulls(len(grams), pa.binary()))

    return run


SHARED = "digest long, n long, gram long, classes long, often binary"


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (key, digest): n-grams of two or more classes, and the frequent ones."""
    for table in whole_runs(batches):
        key, digest = numbers(table, "key"), numbers(table, "digest")
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])
        listed = table.column("often").is_valid().to_numpy()
        kept = table.filter(pa.array(new & ~listed))
        key = numbers(kept, "key")
        cut = starts(key)
        classes = np.repeat(np.diff(np.append(cut, len(key))), np.diff(np.append(cut, len(key))))
        many = classes > 1
        none = pa.nulls(int(many.sum()), pa.binary())
        yield _batch(SHARED, numbers(kept, "digest")[many], numbers(kept, "n")[many], key[many],
                     classes[many], none)
        kept = table.filter(pa.array(new & listed))
        yield _batch(SHARED, numbers(kept, "digest"), numbers(kept, "n"),
                     pa.nulls(len(kept), pa.int64()), np.zeros(len(kept), np.int64),
                     kept.column("often").combine_chunks())


RECORDS = "digest long, n long, prefix long, grams binary"


def _records(percent: int):
    """From rows sorted by (digest, classes, gram): the classes whose prefix another may share.

    `grams` are the shared n-grams in order; the first `prefix` of them belong to the prefix.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches):
            digest, n = numbers(table, "digest"), numbers(table, "n")
            gram = table.column("gram").fill_null(0).to_numpy()
            often, first = blobs(table, "often")
            listed = table.column("often").is_valid().to_numpy()
            cut = starts(digest)
            ends = np.append(cut[1:], len(digest))
            plain = np.add.reduceat((~listed).astype(np.int64), cut)
            last = np.add.reduceat(np.diff(first), cut)
            n = n[cut]
            prefix = n - least_overlap(n, percent) + 1 - (n - plain - last)
            rows = []
            for i in np.flatnonzero((prefix > 0) & (plain + last > 0)).tolist():
                a, b = cut[i], ends[i]
                held = np.concatenate((gram[a:b][~listed[a:b]], often[first[a]:first[b]]))
                rows.append((int(digest[a]), int(n[i]), int(min(prefix[i], len(held))),
                             held.tobytes()))
            for lo in range(0, len(rows), 1000):
                yield _batch(RECORDS, *(pa.array(x) for x in zip(*rows[lo:lo + 1000])))

    return run


PREFIX = "gram long, digest long, n long, rest long"


def _part_counts(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many of each row's n-grams lie in each part of the hash range."""
    n = len(first) - 1
    part = (grams.view(np.uint64) >> np.uint64(GRAM_BITS - PARTS.bit_length() + 1)).astype(np.int64)
    of = np.repeat(np.arange(n), np.diff(first))
    return np.bincount(of * PARTS + part, minlength=n * PARTS).reshape(n, PARTS)


def part_counts(grams: Column) -> Column:
    @F.arrow_udf("binary")
    def count(column: pa.Array) -> pa.Array:
        rows = _part_counts(*blobs(pa.table([column], ["grams"]), "grams")).astype("<u4")
        return pa.array([row.tobytes() for row in rows], pa.binary())

    return count(grams)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each prefix n-gram of a record, with how many shared ones follow it."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        grams, first = blobs(table, "grams")
        prefix, size = numbers(table, "prefix"), np.diff(first)
        of = np.repeat(np.arange(len(prefix)), prefix)
        at = ragged(first[:-1], prefix)
        yield _batch(PREFIX, grams[at], numbers(table, "digest")[of], numbers(table, "n")[of],
                     size[of] - (at - first[of]) - 1)


def _dealt(rows: DataFrame, load: DataFrame) -> DataFrame:
    """Rows with the task that compares them; `load` has the chunks of crowded keys.

    A key in c chunks becomes c * (c + 1) / 2 tasks, of one chunk or of two that are crossed.
    """
    split = rows.join(load, "gram", "left").withColumn(
        "chunk", F.when(F.col("chunks").isNull(), F.lit(0))
        .otherwise(F.pmod(F.xxhash64("digest"), F.col("chunks")).cast("int")))
    partner = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(
        F.sequence(F.lit(0), F.col("chunks") - 1))
    return split.withColumn("partner", F.explode(partner)).withColumns({
        "task": F.xxhash64("gram", F.least("chunk", "partner"), F.greatest("chunk", "partner")),
        "cross": F.col("chunk") != F.col("partner"),
    }).drop("chunks", "partner")


def _tasks(table: pa.Table) -> tuple[pa.Table, Iterator[slice]]:
    """The rows by task and kind of comparison, shortest sets first, and where each has its rows."""
    task, cross = numbers(table, "task"), table.column("cross").to_numpy()
    order = np.lexsort((numbers(table, "digest"), numbers(table, "n"), cross, task))
    task, cross = task[order], cross[order]
    new = np.ones(len(task), bool)
    new[1:] = (task[1:] != task[:-1]) | (cross[1:] != cross[:-1])
    cut = np.flatnonzero(new)
    return table.take(pa.array(order)), (
        slice(a, b) for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(task)]) if b - a > 1)


def _homes(table: pa.Table) -> np.ndarray:
    """The homes of each row, ascending; rows with fewer repeat the last one."""
    values, first = lists(table, "homes")
    many = np.diff(first)
    at = np.minimum(np.arange(many.max())[None, :], many[:, None] - 1)
    return values[first[:-1, None] + at]


def _first_common(homes: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of `homes` the first that is also in `own`, and whether there is one."""
    hit = (homes[:, :, None] == own[None, None, :]).any(axis=2)
    return homes[np.arange(len(homes)), hit.argmax(axis=1)], hit.any(axis=1)


def _reach(n: np.ndarray, percent: int) -> list[int]:
    """For each row the end of the rows that are not too long for it; sizes ascend."""
    return np.searchsorted(n, longest_partner(n, percent), side="right").tolist()


def _at_home(percent: int):
    """Compares the records that meet in a task: edges of a spanning forest of the links."""

    def compare(n, chunk, crossing, here, homes, grams, first) -> np.ndarray:
        size, parts = np.diff(first), _part_counts(grams, first)
        code = np.unique(grams, return_inverse=True)[1]
        mark, forest = np.zeros(len(grams), bool), Forest(len(n))
        for i, end in enumerate(_reach(n, percent)):
            other = i + 1 + np.flatnonzero(forest.label[i + 1:end] != forest.label[i])
            if crossing:
                other = other[chunk[other] != chunk[i]]
            if not len(other):
                continue
            home, common = _first_common(homes[other], homes[i])
            other = other[common & (home == here)]
            need = pair_overlap(n[i], n[other], percent)
            fits = np.minimum(parts[i], parts[other]).sum(axis=1) >= need
            other, need = other[fits], need[fits]
            if not len(other):
                continue
            own = code[first[i]:first[i + 1]]
            mark[own] = True
            ends = np.cumsum(size[other])
            hits = np.concatenate(([0], np.cumsum(mark[code[ragged(first[other], size[other])]])))
            mark[own] = False
            other = other[hits[ends] - hits[ends - size[other]] >= need]
            forest.link(np.full(len(other), i), other)
        return forest.label

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches):
            table, tasks = _tasks(table)
            n, digest, chunk, gram = (
                numbers(table, c) for c in ("n", "digest", "chunk", "gram"))
            cross, homes = table.column("cross").to_numpy(), _homes(table)
            grams, first = blobs(table, "grams")
            for at in tasks:
                edge = first[at.start:at.stop + 1]
                label = compare(n[at], chunk[at], cross[at.start], gram[at.start], homes[at],
                                grams[edge[0]:edge[-1]], edge - edge[0])
                linked = np.flatnonzero(label != np.arange(len(label)))
                own = digest[at]
                yield _batch("a, b", own[linked], own[label[linked]])

    return run


def _elsewhere(percent: int):
    """Pairs that meet in a prefix n-gram and have no home in common, after the filters."""

    def pairs(n, digest, chunk, crossing, rest, homes, parts):
        for i, end in enumerate(_reach(n, percent)):
            other = np.arange(i + 1, end)
            if crossing:
                other = other[chunk[other] != chunk[i]]
            need = pair_overlap(n[i], n[other], percent)
            other = other[1 + np.minimum(rest[i], rest[other]) >= need]
            if len(other):
                other = other[~_first_common(homes[other], homes[i])[1]]
            need = pair_overlap(n[i], n[other], percent)
            other = other[np.minimum(parts[i], parts[other]).sum(axis=1) >= need]
            if len(other):
                yield digest[np.full(len(other), i)], digest[other]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches):
            table, tasks = _tasks(table)
            n, digest, chunk, rest = (
                numbers(table, c) for c in ("n", "digest", "chunk", "rest"))
            cross, homes = table.column("cross").to_numpy(), _homes(table)
            parts = blobs(table, "parts", "<u4")[0].reshape(-1, PARTS)
            for at in tasks:
                found = list(pairs(n[at], digest[at], chunk[at], cross[at.start], rest[at],
                                   homes[at], parts[at]))
                if found:
                    a, b = (np.concatenate(x) for x in zip(*found))
                    yield _batch("a, b", np.minimum(a, b), np.maximum(a, b))

    return run


def _linked(percent: int):
    @F.arrow_udf("boolean")
    def linked(n_a: pa.Array, a: pa.Array, n_b: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([
            (100 + percent) * len(np.intersect1d(
                np.frombuffer(x, "<i8"), np.frombuffer(y, "<i8"), assume_unique=True))
            >= percent * (m + n)
            for m, x, n, y in zip(n_a.to_pylist(), a.to_pylist(), n_b.to_pylist(), b.to_pylist())
        ], pa.bool_())

    return linked


def records(texts: DataFrame, seen: DataFrame, size: int, percent: int,
            frequent: float) -> DataFrame:
    """The classes that another may link with: their size and n-grams shared with others."""
    n_docs = seen.filter(F.col("gram").isNull()).count()
    often = (
        seen.filter(F.col("gram").isNotNull()).groupBy("gram").agg(F.sum("uses").alias("uses"))
        .filter(F.col("uses") >= frequent * n_docs).toArrow()
    )
    order = np.argsort(often["gram"].to_numpy())
    grams, uses = often["gram"].to_numpy()[order], often["uses"].to_numpy()[order]
    rank = np.empty(len(grams), np.int64)
    rank[np.lexsort((grams, uses))] = np.arange(len(grams))
    shared = (
        texts.mapInArrow(_flow(size, grams, rank), FLOW)
        .repartition("key").sortWithinPartitions("key", "digest").mapInArrow(_shared, SHARED)
    )
    return written(
        shared.repartition("digest").sortWithinPartitions("digest", "classes", "gram")
        .mapInArrow(_records(percent), RECORDS), "ngram-records")


def links(found: DataFrame, percent: int, homes: int, chunk_rows: int) -> DataFrame:
    """Edges (a, b) that connect all linked classes of the records."""
    prefixes = written(found.mapInArrow(_prefixes, PREFIX), "ngram-prefixes")
    common = prefixes.groupBy("gram").agg(F.count(F.lit(1)).alias("members")).filter(
        F.col("members") > 1)
    meeting = written(prefixes.join(common, "gram"), "ngram-meeting")
    order = F.struct((-F.col("members")).alias("m"), "gram")
    chosen = written(
        meeting.groupBy("digest").agg(F.array_sort(F.collect_list(order)).alias("all"))
        .select("digest", F.array_sort(F.transform(F.slice("all", 1, homes), lambda x: x["gram"]))
                .alias("homes")), "ngram-homes")
    columns = ["task", "cross", "chunk", "gram", "digest", "n", "homes"]

    at_home = found.join(chosen, "digest").select(
        "digest", "n", "homes", "grams", F.explode("homes").alias("gram"))
    load = (
        at_home.groupBy("gram").agg(F.ceil(F.greatest(
            F.count(F.lit(1)) / chunk_rows, F.sum(F.length("grams") / 8) / CHUNK_GRAMS,
        )).cast("int").alias("chunks")).filter(F.col("chunks") > 1)
    )
    edges = (
        _dealt(at_home, load).select(*columns, "grams")
        .repartition("task").sortWithinPartitions("task")
        .mapInArrow(_at_home(percent), "a long, b long")
    )

    # Where all that meet have a home in common, that home compares them.
    settled = (
        meeting.join(chosen, "digest")
        .select("gram", "members", F.explode("homes").alias("home"))
        .groupBy("gram", "members", "home").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") == F.col("members")).select("gram").distinct()
    )
    parts = found.select("digest", part_counts(F.col("grams")).alias("parts"))
    load = common.filter(F.col("members") > chunk_rows).select(
        "gram", F.ceil(F.col("members") / chunk_rows).cast("int").alias("chunks"))
    open_rows = meeting.join(settled, "gram", "left_anti").join(chosen, "digest").join(
        parts, "digest")
    pairs = written(
        _dealt(open_rows, load).select(*columns, "rest", "parts")
        .repartition("task").sortWithinPartitions("task")
        .mapInArrow(_elsewhere(percent), "a long, b long").distinct(), "ngram-pairs")
    side = [found.select(F.col("digest").alias(k), F.col("n").alias(f"n_{k}"),
                         F.col("grams").alias(f"grams_{k}")) for k in "ab"]
    verified = (
        pairs.join(side[0], "a").join(side[1], "b")
        .filter(_linked(percent)(F.col("n_a"), F.col("grams_a"), F.col("n_b"), F.col("grams_b")))
        .select("a", "b")
    )
    return edges.union(verified)


def ngram_components(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", *,
                     size: int = SIZE, percent: int = PERCENT, frequent: float = FREQUENT,
                     homes: int = HOMES, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(id, n_shingles, component_id): the smallest id among all texts reachable by links."""
    texts = docs.select(col(id_column).cast("long").alias("id"), col(text_column).alias("text"))
    seen = written(texts.mapInArrow(_seen(size, frequent), SEEN), "ngram-sets")
    rows = seen.filter(F.col("gram").isNull()).select("id", "n", "digest")
    found = records(texts, seen, size, percent, frequent)
    roots = components(links(found, percent, homes, chunk_rows))
    classes = written(
        rows.filter(F.col("digest").isNotNull()).groupBy("digest").agg(F.min("id").alias("least"))
        .join(roots.withColumnRenamed("node", "digest"), "digest", "left")
        .select("digest", "least", F.coalesce("root", "digest").alias("root")), "ngram-classes")
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(classes.join(least, "root").select("digest", "component_id"), "ngram-named")
    return rows.join(named, "digest", "left").select(
        F.col("id").alias(id_column), F.col("n").alias("n_shingles"),
        F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id"))
        .alias("component_id"))
