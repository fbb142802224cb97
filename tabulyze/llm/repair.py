"""Token ids in grammar-compressed binary shards (Re-Pair).

In rounds, the most frequent pairs of neighbouring ids of a shard become nonterminals and are
replaced from left to right; pairs never cross the end of a document. A round takes the pairs used
at least a sixteenth as often as the most frequent one; where two of them overlap, the more frequent
one (by steps of a quarter of a doubling, then by a hash) is replaced and the other waits. Rounds go on until no pair is used `LEAST_USES` times, the
fewest that save more bytes than a rule takes. A shard holds the rules, how many ids each
nonterminal expands to, and for each document where its symbols begin, so any span of ids is
decoded from the few symbols that cover it.

File, little-endian: "RPTK", version, first nonterminal, bit planes above 16 bits (u32 each),
documents, rules, rounds, bytes of rules, symbols (u64 each); document ids (i64), whether they are
null (u8), first symbols (u64), numbers of ids (u64); rules a round (u32); rules, sorted in each
round, as numbers of seven bits a byte: left symbols less the one before, right symbols, expansion
lengths; the symbols' low 16 bits (u16), then their higher bits, a plane of packed bits each.

Documents are in ascending id order, null ids first, equal ids by a hash of their text. Defined
results: null and empty texts hold the end id only; repeated rows are kept; extra columns are
ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tabulyze.functions.columns import col
from tabulyze.llm.batches import slices
from tabulyze.llm.shared_files import read_file, write_file
from tabulyze.llm.stamping import written
from tabulyze.llm.tokens import encoder, with_end
from tabulyze.session import scratch_path

MAGIC, VERSION = b"RPTK", 2
HEADER = struct.Struct("<4sIIIQQQQQ")
SHARD_IDS = 1 << 21
LEAST_USES = 3
# Marks above a symbol: the last of its document; its pair with the next may be frequent.
LAST, LIVE = np.uint32(1 << 31), np.uint32(1 << 30)
MIX = np.uint64(0x9E3779B97F4A7C15)
END_ID = 0


def _gathered(values: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs of n values from each start, one after the other."""
    total = np.concatenate(([0], np.cumsum(n)))
    return values[np.repeat(start - total[:-1], n) + np.arange(total[-1])]


@dataclass
class Grammar:
    """Rules by rounds; those of a round refer to ids and rules of earlier rounds only."""

    base: int
    pairs: np.ndarray
    lengths: np.ndarray
    rounds: np.ndarray

    def expansions(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all symbols in a row, where each symbol's begin, and how many there are."""
        count = np.concatenate((np.ones(self.base, np.int64), self.lengths.astype(np.int64)))
        start = np.cumsum(count) - count
        ids = np.zeros(int(count.sum()), "<u4")
        ids[:self.base] = np.arange(self.base)
        first = 0
        for size in self.rounds.tolist():
            parts = self.pairs[first:first + size].reshape(-1)
            found = _gathered(ids, start[parts], count[parts])
            at = start[self.base + first]
            ids[at:at + len(found)] = found
            first += size
        return ids, start, count


def expand(symbols: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    ids, start, count = table
    return _gathered(ids, start[symbols], count[symbols])


def _frequent(places: np.ndarray, code: np.ndarray, slot: np.ndarray, least: int
              ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The most frequent codes, their uses, and which places may hold a code used `least` times.

    The codes are those used a sixteenth as often as the fullest slot, or, if there is none, all
    that are used `least` times.
    """
    in_slot = np.bincount(slot, minlength=1)
    single = np.ones(len(code), bool)
    twice = np.flatnonzero(code[1:] == code[:-1]) + 1
    twice = twice[places[twice] - places[twice - 1] == 1]
    if len(twice):
        # Overlapping pairs of a run x x x ... count every second time, from the left.
        run = np.flatnonzero(np.diff(twice, prepend=-2) != 1)
        behind = np.arange(len(twice)) - np.repeat(run, np.diff(np.append(run, len(twice))))
        single[twice[behind % 2 == 0]] = False
    for often in (max(least, int(in_slot.max()) // 16), least):
        ordered = np.sort(code[(in_slot >= often)[slot] & single])
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))[:len(ordered)])
        uses = np.diff(np.append(first, len(ordered)))
        found = uses >= often
        if found.any():
            break
    return ordered[first[found]], uses[found], (in_slot >= least)[slot]


def _chosen(places: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Which places to replace: no two touch, and the better rank of neighbours wins.

    Neighbours of equal rank are a run of one id; every second of them is taken, from the left.
    """
    near = np.diff(places) == 1
    best = np.ones(len(places), bool)
    best[1:] &= ~(near & (rank[1:] > rank[:-1]))
    best[:-1] &= ~(near & (rank[:-1] > rank[1:]))
    ties = np.flatnonzero(near & (rank[1:] == rank[:-1])) + 1
    if len(ties):
        ties = ties[best[ties] & best[ties - 1]]
        run = np.flatnonzero(np.diff(ties, prepend=-2) != 1)
        behind = np.arange(len(ties)) - np.repeat(run, np.diff(np.append(run, len(ties))))
        best[ties[behind % 2 == 0]] = False
    return np.flatnonzero(best)


def compress(ids: np.ndarray, bounds: np.ndarray, least: int = LEAST_USES
             ) -> tuple[Grammar, np.ndarray, np.ndarray]:
    """Grammar, symbols, and where each document's symbols begin (n + 1 bounds)."""
    base = int(ids.max()) + 1 if len(ids) else 1
    if base > int(LIVE):
        raise ValueError("Ids must lie below 2^30")
    # Uses of a pair never grow, so a place is looked at until its pair is found to be rare.
    marked = ids.astype(np.uint32) | LIVE
    marked[bounds[1:][np.diff(bounds) > 0] - 1] |= LAST
    pairs, lengths, n = [], np.ones(base, np.int64), base
    while True:
        state = marked[:-1] & (LIVE | LAST)
        inner = np.flatnonzero(state == LIVE)
        code = (marked[inner] ^ LIVE).astype(np.uint64)
        code <<= np.uint64(32)
        code |= marked[inner + 1] & ~(LIVE | LAST)
        shift = np.uint64(64 - max(10, min(20, len(code).bit_length())))
        slot = code * MIX
        slot >>= shift
        slot = slot.view(np.int64)
        codes, uses, crowded = _frequent(inner, code, slot, least)
        if not len(codes):
            break
        marked[inner[~crowded]] ^= LIVE
        # Ties go by a hash: in the order of the ids a long passage would yield a pair a round.
        level = np.floor(4 * np.log2(uses))
        codes = codes[np.lexsort((codes * MIX, -level))]
        # The best rank is filed last and so keeps its slot; pairs that lose theirs wait.
        rank_of = np.full(int(slot.max()) + 1, -1, np.int32)
        filed = ((codes * MIX) >> shift).astype(np.int64)
        rank_of[filed[::-1]] = np.arange(len(codes) - 1, -1, -1, dtype=np.int32)
        rank = rank_of[slot]
        hit = np.flatnonzero(rank >= 0)
        hit = hit[codes[rank[hit]] == code[hit]]
        places, rank = inner[hit], rank[hit]
        picked = _chosen(places, rank)
        places, rank = places[picked], rank[picked]
        paying = np.bincount(rank, minlength=len(codes)) >= least
        kept = paying[rank]
        places, rank = places[kept], rank[kept]
        # Rules of a round are numbered by their pair.
        rules = np.sort(codes[paying])
        number = np.zeros(len(codes), np.uint32)
        number[paying] = n + np.searchsorted(rules, codes[paying])
        marked[places] = number[rank] | LIVE | (marked[places + 1] & LAST)
        keep = np.ones(len(marked), bool)
        keep[places + 1] = False
        marked = marked[keep]
        now = places - np.arange(len(places))
        marked[np.maximum(now - 1, 0)] |= LIVE
        new = np.stack([rules >> np.uint64(32), rules & np.uint64(0xFFFFFFFF)], 1).astype(np.uint32)
        pairs.append(new)
        lengths = np.concatenate((lengths, lengths[new[:, 0]] + lengths[new[:, 1]]))
        n += len(new)
    grammar = Grammar(
        base, np.concatenate([np.zeros((0, 2), np.uint32), *pairs]), lengths[base:],
        np.array([len(x) for x in pairs], np.int64))
    ends = np.zeros(len(bounds), np.int64)
    ends[1:][np.diff(bounds) > 0] = np.flatnonzero(marked & LAST) + 1
    return grammar, marked & ~(LIVE | LAST), np.maximum.accumulate(ends)


def packed_numbers(values: np.ndarray) -> bytes:
    """Numbers below 2^35 in seven bits a byte, the low ones first."""
    values = values.astype(np.uint64)
    n = 1 + sum((values >= np.uint64(1 << 7 * k)).astype(np.int64) for k in range(1, 5))
    at = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.uint8)
    for k in range(5):
        more = n > k
        seven = ((values[more] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8)
        out[at[more] + k] = seven | ((n[more] > k + 1).astype(np.uint8) << 7)
    return out.tobytes()


def unpacked_numbers(data: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(data < 128)
    start = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    n = ends - start + 1
    values = np.zeros(len(ends), np.int64)
    for k in range(5):
        more = n > k
        values[more] |= (data[start[more] + k].astype(np.int64) & 127) << (7 * k)
    return values


def _rule_bytes(grammar: Grammar) -> bytes:
    left, right = grammar.pairs[:, 0].astype(np.int64), grammar.pairs[:, 1]
    step = np.diff(left, prepend=0)
    firsts = (np.cumsum(grammar.rounds) - grammar.rounds)
    step[firsts] = left[firsts]
    return packed_numbers(np.concatenate((step, right.astype(np.int64), grammar.lengths)))


def _rules(data: np.ndarray, rules: int, rounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step, right, lengths = unpacked_numbers(data).reshape(3, rules)
    firsts = np.cumsum(rounds) - rounds
    total = np.cumsum(step)
    left = total - np.repeat(total[firsts] - step[firsts], rounds)
    return np.stack([left, right], 1), lengths


def shard_bytes(doc_ids: list[int | None], ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    grammar, symbols, begins = compress(ids, bounds)
    planes = max(0, (grammar.base + len(grammar.pairs) - 1).bit_length() - 16)
    rules = _rule_bytes(grammar)
    return [
        HEADER.pack(MAGIC, VERSION, grammar.base, planes, len(doc_ids), len(grammar.pairs),
                    len(grammar.rounds), len(rules), len(symbols)),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([d is None for d in doc_ids], "u1").tobytes(),
        begins[:-1].astype("<u8").tobytes(), np.diff(bounds).astype("<u8").tobytes(),
        grammar.rounds.astype("<u4").tobytes(), rules,
        (symbols & np.uint32(0xFFFF)).astype("<u2").tobytes(),
        *(np.packbits((symbols >> np.uint32(16 + k) & np.uint32(1)).astype(np.uint8)).tobytes()
          for k in range(planes)),
    ]


@dataclass
class Shard:
    """A shard file in memory."""

    doc_ids: list[int | None]
    begins: np.ndarray
    counts: np.ndarray
    grammar: Grammar
    symbols: np.ndarray

    @classmethod
    def parse(cls, data: bytes) -> "Shard":
        magic, version, base, planes, docs, rules, rounds, rule_bytes, n = \
            HEADER.unpack_from(data)
        if magic != MAGIC or version != VERSION:
            raise ValueError("Not a shard of token ids")
        at = HEADER.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            values = np.frombuffer(data, kind, n, at)
            at += values.nbytes
            return values

        ids, nulls = take("<i8", docs).tolist(), take("u1", docs).tolist()
        begins, counts = take("<u8", docs).astype(np.int64), take("<u8", docs).astype(np.int64)
        sizes = take("<u4", rounds).astype(np.int64)
        pairs, lengths = _rules(take("u1", rule_bytes), rules, sizes)
        symbols = take("<u2", n).astype(np.uint32)
        for k in range(planes):
            bits = np.unpackbits(take("u1", -(-n // 8)), count=n)
            symbols |= bits.astype(np.uint32) << np.uint32(16 + k)
        return cls([None if z else i for i, z in zip(ids, nulls)], begins, counts,
                   Grammar(base, pairs, lengths, sizes), symbols)

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the bounds of each document in them."""
        bounds = np.concatenate(([0], np.cumsum(self.counts)))
        return expand(self.symbols, self.grammar.expansions()), bounds

    def span(self, doc: int, start: int, stop: int) -> np.ndarray:
        """Ids start .. stop-1 of a document, from the symbols that cover them."""
        stop = min(stop, int(self.counts[doc]))
        ends = np.append(self.begins[1:], len(self.symbols))
        own = self.symbols[self.begins[doc]:ends[doc]]
        table = self.grammar.expansions()
        after = np.cumsum(table[2][own])
        a, b = np.searchsorted(after, start, side="right"), np.searchsorted(after, stop)
        before = int(after[a - 1]) if a else 0
        return expand(own[a:b + 1], table)[start - before:stop - before]


def write_shards(docs: DataFrame, definition: str, id_column: str = "doc_id",
                 text_column: str = "text", end_id: int = END_ID,
                 shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write shards to the shared folder; one row per file (part, number, path, n_docs, n_ids)."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "token-shards")
    shared = spark.sparkContext.broadcast(definition)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part_no = TaskContext.get().partitionId()
        encode = encoder(shared.value)
        held_ids, held, counts, number = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal held_ids, held, counts, number
            ids = np.concatenate(held)
            bounds = np.concatenate(([0], np.cumsum(np.concatenate(counts))))
            path = write_file(folder, f"part-{part_no:06d}-{number:05d}",
                              shard_bytes(held_ids, ids, bounds))
            row = pa.RecordBatch.from_pydict({
                "part": pa.array([part_no], pa.int32()), "number": pa.array([number], pa.int32()),
                "path": [path], "n_docs": pa.array([len(held_ids)], pa.int64()),
                "n_ids": pa.array([len(ids)], pa.int64())})
            held_ids, held, counts, number = [], [], [], number + 1
            return row

        for batch in batches:
            names = batch.column(0).to_pylist()
            for part in slices(batch.column(1)):
                ids, bounds = with_end(*encode.encode(part), end_id)
                held.append(ids)
                counts.append(np.diff(bounds))
                held_ids += names[part.first:part.first + len(part)]
                if sum(map(len, held)) >= shard_ids:
                    yield flush()
        if held:
            yield flush()

    order = [F.col("id").asc_nulls_first(), F.xxhash64("text").asc()]
    return written(
        docs.select(col(id_column).cast("long").alias("id"), col(text_column).alias("text"))
        .repartitionByRange(*order).sortWithinPartitions(*order)
        .mapInArrow(write, "part int, number int, path string, n_docs long, n_ids long"),
        "shard-list")


def with_starts(files: DataFrame) -> DataFrame:
    """Adds to each file how many ids come before it: inside its part, then over parts."""
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(
        Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    over = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = parts.select("part", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("before"))
    return files.withColumn(
        "inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))
    ).join(before, "part").withColumn("start", F.col("before") + F.col("inside"))


def read_shards(files: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Decode the files: a row per document with start, n_tokens and the CRC of its ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard.parse(read_file(row["path"]))
                ids, bounds = shard.ids()
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * a:4 * b])
                       for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(shard.doc_ids, pa.int64()), pa.array(bounds[:-1] + row["start"]),
                    pa.array(shard.counts), pa.array(crc, pa.int64())],
                    names=[id_column, "start", "n_tokens", "ids_crc32"])

    n = max(1, min(files.count(), 10_000))
    return with_starts(files).select("path", "start").repartition(n).mapInArrow(
        read, f"`{id_column}` long, start long, n_tokens long, ids_crc32 long")


def token_shards(docs: DataFrame, definition: str, id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """Write the shards, read them back, and describe each document from what was read."""
    return read_shards(write_shards(docs, definition, id_column, text_column), id_column)
