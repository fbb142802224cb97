"""Benchmark decontamination by a prefix-filtered set join.

Each window of `window` consecutive item words is a set of word shingles. Shingles are ordered by
rarity in the documents; exact containment needs a prefix of one, so a window is looked up by its
rarest shingle only. A document offers those of its shingles that may be such a prefix, with the
words around them. After the join, the place of the shingle in the window gives the only position
the window can have; it must lie inside the document (length and position bounds), and its words
must equal the window's.

Which shingles a document offers is told by a bitmap of fixed size, whatever the benchmark's
size; what the bitmap lets through by chance finds no partner in the join.

Defined results: null and empty texts have no words and no hits; a null item id counts as a hit
but is not listed; repeated items are listed once; repeated documents are judged one by one; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabulyze.functions.columns import col
from tabulyze.llm.batches import LOWER, byte_table, mix, slices, window_hashes
from tabulyze.llm.stamping import ROW, stamped, unused, written

WINDOW = 10
SHINGLE = 5
BITMAP_BITS = 24

#: Word bytes before lower-casing: digits, ASCII letters, and whatever is not ASCII.
WORD = byte_table(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B),
                         *range(0x80, 0x100)]))

ITEM_WINDOWS = "array<struct<words:string,n:int,size:int,keys:array<long>>>"
CANDIDATE = pa.struct([("key", pa.int64()), ("at", pa.int32()), ("first", pa.int32()),
                       ("near", pa.string())])
OFFERS = "struct<n_words:long,offers:array<struct<key:long,at:int,first:int,near:string>>>"
OFFERS_DDL = "n_words long, offers array<struct<key:long,at:int,first:int,near:string>>"


def _shingle_keys(hashes: np.ndarray, size: int) -> np.ndarray:
    return window_hashes(hashes, size) ^ mix(np.array([size], np.uint64))


def item_windows(text: Column, window: int, shingle: int) -> Column:
    """The windows of an item: their words, and the keys of their shingles in order."""

    @F.arrow_udf(ITEM_WINDOWS)
    def cut(texts: pa.Array) -> pa.Array:
        rows: list[list[dict]] = []
        for part in slices(texts):
            lowered = LOWER[part.data]
            spans = part.words(WORD)
            hashes, raw = spans.hashes(lowered), lowered.tobytes()
            for i in range(len(part)):
                lo, hi = spans.bounds[i], spans.bounds[i + 1]
                words = [raw[a:b].decode("utf-8", "replace")
                         for a, b in zip(spans.starts[lo:hi], spans.ends[lo:hi])]
                n = min(window, len(words))
                size = min(shingle, n)
                keys = _shingle_keys(hashes[lo:hi], size).view(np.int64).tolist() if n else []
                rows.append([] if not n else [
                    {"words": " ".join(words[k:k + n]), "n": n, "size": size,
                     "keys": keys[k:k + n - size + 1]}
                    for k in range(len(words) - n + 1)
                ])
        return pa.array(rows, pa.list_(pa.struct([
            ("words", pa.string()), ("n", pa.int32()), ("size", pa.int32()),
            ("keys", pa.list_(pa.int64()))])))

    return cut(text)


def bitmap(keys: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """A bit for each value the low `bits` of a key take: at most 2**(bits - 6) rows are read."""
    slot = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    rows = (
        keys.select(F.shiftright(slot, 6).alias("w"),
                    F.call_function("shiftleft", F.lit(1).cast("long"),
                                    slot.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
        .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    )
    words = np.zeros(1 << (bits - 6), np.int64)
    words[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return words.view(np.uint8)


def _listed(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys & np.uint64(8 * len(bits) - 1)
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _shingles(part, sizes: list[int], bits: np.ndarray):
    """Words of a slice, and for each size the listed shingles: (positions, keys)."""
    lowered = LOWER[part.data]
    spans = part.words(WORD)
    hashes, text = spans.hashes(lowered), spans.text_index()
    found = []
    for size in sizes:
        keys = _shingle_keys(hashes, size)
        at = np.flatnonzero(_listed(bits, keys))
        at = at[text[at] == text[at + size - 1]]
        found.append((at, keys[at]))
    return lowered, spans, text, found


def _frequencies(docs: DataFrame, text_column: str, sizes: list[int],
                 bits: np.ndarray) -> DataFrame:
    """(key, n): how often each listed shingle occurs in the documents."""

    def count(batches):
        for batch in batches:
            for part in slices(batch.column(0)):
                keys = np.concatenate([k for _, k in _shingles(part, sizes, bits)[3]])
                keys, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    return (
        docs.select(col(text_column)).mapInArrow(count, "key long, n long")
        .groupBy("key").agg(F.sum("n").alias("n"))
    )


def offers(text: Column, sizes: list[int], bits: np.ndarray, window: int) -> Column:
    """Word count and candidate shingles of a text, each with the words it could match."""

    @F.arrow_udf(OFFERS_DDL)
    def offer(texts: pa.Array) -> pa.Array:
        n_words, rows = [], []
        for part in slices(texts):
            lowered, spans, text_of, found = _shingles(part, sizes, bits)
            n_words.append(spans.counts())
            own: list[list[dict]] = [[] for _ in range(len(part))]
            raw = None
            for at, keys in found:
                raw = lowered.tobytes() if raw is None and len(at) else raw
                for p, key in zip(at.tolist(), keys.view(np.int64).tolist()):
                    i = int(text_of[p])
                    lo = max(int(spans.bounds[i]), p - window + 1)
                    hi = min(int(spans.bounds[i + 1]), p + window)
                    near = " ".join(
                        raw[a:b].decode("utf-8", "replace")
                        for a, b in zip(spans.starts[lo:hi], spans.ends[lo:hi]))
                    start = int(spans.bounds[i])
                    own[i].append({"key": key, "at": p - start, "first": lo - start,
                                   "near": near})
            rows += own
        counts = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
        return pa.StructArray.from_arrays(
            [pa.array(counts.astype(np.int64)), pa.array(rows, pa.list_(CANDIDATE))],
            names=["n_words", "offers"])

    return offer(text)


def prefixes(docs: DataFrame, items: DataFrame, text_column: str, item_id: str, item_text: str,
             window: int, shingle: int) -> tuple[DataFrame, list[int]]:
    """Distinct windows with their rarest shingle: (key, place, n, words, item_ids)."""
    cut = items.select(
        col(item_id).cast("string").alias("item"),
        F.explode(item_windows(col(item_text), window, shingle)).alias("w"),
    ).select("item", "w.*")
    windows = written(
        cut.groupBy("words", "n", "size").agg(
            F.first("keys").alias("keys"), F.collect_set("item").alias("item_ids")),
        "windows",
    )
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())
    if not sizes:
        return windows.select(
            F.lit(0).cast("long").alias("key"), F.lit(0).alias("place"), "n", "words",
            "item_ids"), sizes
    shingles = windows.select("words", F.posexplode("keys").alias("place", "key"))
    counted = _frequencies(docs, text_column, sizes, bitmap(shingles.select("key")))
    # A shingle that no document has keeps its window from occurring: those windows go.
    rarest = (
        shingles.join(counted, "key", "left").groupBy("words")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key", "place")).alias("r"))
        .filter(F.col("r.n") > 0).select("words", "r.key", "r.place")
    )
    return written(windows.select("words", "n", "item_ids").join(rarest, "words"),
                   "prefixes"), sizes


def contaminated_rows(docs: DataFrame, items: DataFrame, *, text_column: str = "text",
                      item_id: str = "item_id", item_text: str = "text", window: int = WINDOW,
                      shingle: int = SHINGLE, row: str = ROW,
                      keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The kept columns with row numbers and, in the last column, n_words and the candidates; and
    (row, n_hit, item_ids) for the rows that hold a window."""
    keep = docs.columns if keep is None else keep
    offered = unused("offers", docs)
    wanted, sizes = prefixes(docs, items, text_column, item_id, item_text, window, shingle)
    bits = bitmap(wanted.select("key")) if sizes else np.zeros(8, np.uint8)
    marked = stamped(
        docs.select(*(col(c) for c in keep),
                    offers(col(text_column), sizes, bits, window).alias(offered)),
        "offers", row)
    places = marked.select(
        row, F.col(offered)["n_words"].alias("n_words"),
        F.explode(F.col(offered)["offers"]).alias("o")).select(row, "n_words", "o.*")
    start = F.col("at") - F.col("place")
    hits = (
        places.join(wanted, "key")
        .filter((start >= 0) & (start + F.col("n") <= F.col("n_words")))
        .filter(F.array_join(
            F.slice(F.split("near", " "), (start - F.col("first") + 1).cast("int"), F.col("n")),
            " ") == F.col("words"))
        .select(row, F.struct(start.alias("s"), (start + F.col("n")).alias("e")).alias("span"),
                "item_ids")
        .groupBy(row)
        .agg(F.array_sort(F.collect_set("span")).alias("spans"),
             F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids"))))
             .alias("item_ids"))
    )
    union = F.aggregate(
        "spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["end"]))).alias("n"),
            F.greatest(a["end"], x["e"]).alias("end")),
        lambda a: a["n"].cast("long"))
    return marked, hits.select(row, union.alias("n_hit"), "item_ids")


def contamination(docs: DataFrame, items: DataFrame, id_column: str = "doc_id",
                  text_column: str = "text", **options) -> DataFrame:
    """One row per document: words, words inside windows of items, and those items."""
    named = docs.select(col(id_column).alias("id"), col(text_column).alias("body"))
    marked, hits = contaminated_rows(named, items, text_column="body", keep=["id"], **options)
    found = marked.select(ROW, "id", "offers.n_words").join(hits, ROW, "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return found.select(
        F.col("id").alias(id_column), "n_words", hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
