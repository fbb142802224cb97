"""Token ids of texts by a public tokenizer file, with a table of chunks already encoded.

A byte-level tokenizer with the usual splitting expression never merges across some places: where
white space begins, before the last space of a run, and between ASCII letters, digits and
punctuation. A text is cut there, and each distinct chunk is encoded by the library once per
worker; texts in which those places are not certain (added tokens, white space beyond ASCII,
very long chunks) and other kinds of tokenizers go to the library whole.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np

from tabulyze.llm.batches import Slice, byte_table, mix, prefix_sums, span_hashes

LONGEST_CHUNK = 256
TABLE_BITS = 21
MOST_IDS = 6_000_000

OTHER, SPACE, WHITE, LETTER, DIGIT, PUNCT, BREAK = range(7)
CLASSES = np.zeros(256, np.uint8)
CLASSES[0x20] = SPACE
CLASSES[0x09:0x0E] = WHITE
CLASSES[byte_table(bytes([*range(65, 91), *range(97, 123)]))] = LETTER
CLASSES[0x30:0x3A] = DIGIT
CLASSES[byte_table(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = PUNCT  # no apostrophe


class ChunkTable:
    """Hash table of chunk hashes with the ids of each chunk, emptied when it is full."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << TABLE_BITS, np.uint64)
        self.place = np.zeros(1 << TABLE_BITS, np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.count = np.zeros(1 << 14, np.int32)
        self.used = self.n = 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 where there is none."""
        found = np.full(len(hashes), -1, np.int32)
        mask = np.uint64(len(self.keys) - 1)
        left, slot = np.arange(len(hashes)), hashes & mask
        while len(left):
            key = self.keys[slot]
            hit = key == hashes[left]
            found[left[hit]] = self.place[slot[hit]]
            go = ~hit & (key != 0)
            left, slot = left[go], (slot[go] + np.uint64(1)) & mask
        return found

    def add(self, hashes: np.ndarray, encoded: list[list[int]]) -> None:
        """Enter distinct new hashes."""
        counts = np.fromiter(map(len, encoded), np.int32, len(encoded))
        flat = np.fromiter((i for ids in encoded for i in ids), np.uint32, int(counts.sum()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while self.n + len(counts) > len(self.start):
            self.start = np.concatenate((self.start, np.zeros_like(self.start)))
            self.count = np.concatenate((self.count, np.zeros_like(self.count)))
        entries = np.arange(self.n, self.n + len(counts))
        self.ids[self.used:self.used + len(flat)] = flat
        self.start[entries] = self.used + np.cumsum(counts) - counts
        self.count[entries] = counts
        self.used, self.n = self.used + len(flat), self.n + len(counts)
        mask = np.uint64(len(self.keys) - 1)
        left, slot = np.arange(len(hashes)), hashes & mask
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[left[free]]
            won = free & (self.keys[slot] == hashes[left])
            self.place[slot[won]] = entries[left[won]]
            left, slot = left[~won], (slot[~won] + np.uint64(1)) & mask

    def full(self, more: int) -> bool:
        return self.n + more > len(self.keys) // 2 or self.used > MOST_IDS


class Encoder:
    def __init__(self, definition: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        about = json.loads(definition)
        before = about.get("pre_tokenizer") or {}
        self.chunked = (
            before.get("type") == "ByteLevel" and before.get("use_regex", True)
            and not before.get("add_prefix_space", True) and not about.get("normalizer")
            and about.get("model", {}).get("type") == "BPE"
        )
        self.added = [t["content"].encode() for t in about.get("added_tokens", [])]
        self.table = ChunkTable()

    def _library(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(
            [t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]

    def _chunks(self, part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of chunks, and which texts must be encoded whole."""
        data, seps = part.data, part.begin[1:] - 1
        kind = CLASSES[data]
        kind[seps] = BREAK
        white = (kind == SPACE) | (kind == WHITE)
        before, after = kind[:-1], kind[1:]
        start = np.zeros(len(data) + 1, bool)
        start[part.begin[:-1]] = True
        start[seps] = True
        wb, wa = white[:-1], white[1:]
        start[1:-1] |= wa & ~wb
        start[1:-1] |= ~wa & (before == WHITE)
        start[1:-1] |= (before != after) & (before >= LETTER) & (after >= LETTER)
        # The last white byte of a run stands alone or goes with the word after it.
        last = np.zeros(len(data), bool)
        last[:-1] = wb & ~wa & (after != BREAK)
        start[:-1] |= last
        starts = np.flatnonzero(start[:-1])
        ends = np.append(starts[1:], len(data))
        real = kind[starts] != BREAK
        starts, ends = starts[real], ends[real]
        whole = np.zeros(len(part), bool)
        odd = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
        for p in odd[_wide_space(data, odd)]:
            whole[np.searchsorted(part.begin, p, side="right") - 1] = True
        for p in starts[ends - starts > LONGEST_CHUNK]:
            whole[np.searchsorted(part.begin, p, side="right") - 1] = True
        for i, text in enumerate(part.texts):
            if any(token in text for token in self.added):
                whole[i] = True
        return starts, ends, whole

    def encode(self, part: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice in a row, and the number of ids of each text."""
        if not self.chunked:
            return _joined(self._library(part.texts))
        starts, ends, whole = self._chunks(part)
        sums = prefix_sums(part.data.astype(np.uint64) + np.uint64(1))
        hashes = mix(span_hashes(sums, starts, ends))
        hashes[hashes == 0] = 1
        if whole.any():
            of = np.searchsorted(part.begin, starts, side="right") - 1
            starts, ends, hashes = (x[~whole[of]] for x in (starts, ends, hashes))
        found = self.table.find(hashes)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new, first = np.unique(hashes[missing], return_index=True)
            if self.table.full(len(new)):
                self.table.clear()
                new, first = np.unique(hashes, return_index=True)
                missing = np.arange(len(hashes))
            raw, at = part.data.tobytes(), missing[first]
            self.table.add(new, self._library(
                [raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]))
            found[missing] = self.table.find(hashes[missing])
        counts = self.table.count[found].astype(np.int64)
        total = np.concatenate(([0], np.cumsum(counts)))
        gather = np.repeat(self.table.start[found] - total[:-1], counts)
        ids = self.table.ids[gather + np.arange(total[-1])]
        bounds = np.searchsorted(starts, part.begin)
        per_text = total[bounds[1:]] - total[bounds[:-1]]
        if not whole.any():
            return ids, per_text
        pieces = np.split(ids, np.cumsum(per_text)[:-1])
        direct = iter(self._library([t for t, w in zip(part.texts, whole) if w]))
        return _joined([next(direct) if w else p for p, w in zip(pieces, whole)])


def _wide_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether white space beyond ASCII begins at these bytes."""
    padded = np.append(data, np.zeros(2, np.uint8))
    a, b, c = padded[at], padded[at + 1], padded[at + 2]
    return (
        (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
        | (a == 0xE1) & (b == 0x9A) & (c == 0x80)
        | (a == 0xE2) & (b == 0x80)
        & ((c >= 0x80) & (c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        | (a == 0xE2) & (b == 0x81) & (c == 0x9F)
        | (a == 0xE3) & (b == 0x80) & (c == 0x80)
    )


def _joined(lists: list) -> tuple[np.ndarray, np.ndarray]:
    counts = np.array([len(x) for x in lists], np.int64)
    arrays = [np.asarray(x, np.uint32) for x in lists]
    return (np.concatenate(arrays) if arrays else np.zeros(0, np.uint32)), counts


_encoders: dict[str, Encoder] = {}


def encoder(definition: str) -> Encoder:
    """The worker's encoder for a tokenizer file's content, kept between tasks."""
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(definition)
    return _encoders[key]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with `end_id` after each text, and where each text begins (n + 1 bounds)."""
    bounds = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts + 1, out=bounds[1:])
    out = np.full(bounds[-1], end_id, "<u4")
    mask = np.ones(len(out), bool)
    mask[bounds[1:] - 1] = False
    out[mask] = ids
    return out, bounds
