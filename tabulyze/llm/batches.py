"""Numpy views of the texts in an Arrow batch: bytes, words and 64-bit rolling hashes.

Texts are handled in slices of about a megabyte, so a worker's memory follows the longest text
and not the batch. A hash of bytes a..b of a slice is (S[b] - S[a]) * R**a, where S are prefix
sums of byte * B**position modulo 2**64 and R is the inverse of B; words and n-grams of words
use the same sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

SPACES = bytes([0x20, *range(0x09, 0x0E)])

_powers: dict[int, np.ndarray] = {}


def byte_table(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


NOT_SPACE = ~byte_table(SPACES)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        steps = np.full(max(n, 2 * SLICE_BYTES), base, np.uint64)
        steps[0] = 1
        known = _powers[base] = np.cumprod(steps)
        if n > 4 * SLICE_BYTES:  # do not keep what one long text needed
            del _powers[base]
    return known[:n]


def mix(values: np.ndarray) -> np.ndarray:
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    values *= np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    return values


def prefix_sums(values: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(BASE, len(values)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return (sums[ends] - sums[starts]) * powers(INVERSE, len(sums))[starts]


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of words i .. i+size-1, for every i such a window begins at."""
    sums = prefix_sums(words)
    n = max(len(words) - size + 1, 0)
    return mix((sums[size:size + n] - sums[:n]) * powers(INVERSE, n))


@dataclass
class Slice:
    """Some texts of a batch, joined by line ends; `begin[i]` is where text i starts."""

    first: int
    texts: list[bytes]
    data: np.ndarray
    begin: np.ndarray = field(repr=False)

    def __len__(self) -> int:
        return len(self.texts)

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        """Sum of a byte mask over each text."""
        sums = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[self.begin[1:] - 1] - sums[self.begin[:-1]]

    def words(self, member: np.ndarray) -> "Words":
        """Maximal runs of member bytes. A line end must not be a member."""
        inside = member[self.data]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edges = np.concatenate(([0], edges))
        starts, ends = edges[::2], edges[1::2]
        bounds = np.searchsorted(starts, self.begin)
        return Words(self, starts, ends, bounds)


@dataclass
class Words:
    """Word spans of a slice; words of text i are bounds[i] .. bounds[i+1]-1."""

    of: Slice
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text_index(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.of)), self.counts())

    def hashes(self, data: np.ndarray | None = None) -> np.ndarray:
        data = self.of.data if data is None else data
        sums = prefix_sums(data.astype(np.uint64) + np.uint64(1))
        return mix(span_hashes(sums, self.starts, self.ends))


def as_bytes(texts: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [b"" if t is None else t for t in texts.cast(pa.large_binary()).to_pylist()]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    step = 256
    for lo in range(0, len(texts), step):
        yield from _cut(as_bytes(texts.slice(lo, step)), lo, limit)


def _cut(texts: list[bytes], first: int, limit: int) -> Iterator[Slice]:
    at, size, held = 0, 0, []
    for text in texts:
        if held and size + len(text) > limit:
            yield _slice(first + at, held)
            at, size, held = at + len(held), 0, []
        held.append(text)
        size += len(text) + 1
    if held:
        yield _slice(first + at, held)


def _slice(first: int, texts: list[bytes]) -> Slice:
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begin[1:])
    return Slice(first, texts, data, begin)


def code_point_starts(data: np.ndarray) -> np.ndarray:
    return (data & 0xC0) != 0x80
