"""Balanced parentheses with a range min-max tree over blocks of excess."""

from __future__ import annotations

import numpy as np

BLOCK = 64


class Parentheses:
    """A forest as bits, 1 for an opening parenthesis; the whole must be balanced."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits.astype(np.int8)
        n = len(bits)
        blocks = -(-n // BLOCK)
        self.leaves = 1 << max(blocks - 1, 0).bit_length()
        excess = np.cumsum(2 * self.bits.astype(np.int64) - 1)
        self.excess = np.concatenate((excess, np.full(blocks * BLOCK - n, n + 1)))
        self.least = np.full(2 * self.leaves, n + 1)
        self.least[self.leaves:self.leaves + blocks] = \
            self.excess.reshape(-1, BLOCK).min(axis=1) if n else []
        level = self.leaves
        while level > 1:
            level //= 2
            pairs = self.least[2 * level:4 * level].reshape(-1, 2)
            self.least[level:2 * level] = pairs.min(axis=1)
        self._opened = np.concatenate(([0], np.cumsum(self.bits)))
        pair = np.zeros(n, np.int64)
        pair[:-1] = (self.bits[:-1] == 1) & (self.bits[1:] == 0)
        self._pairs = np.concatenate(([0], np.cumsum(pair)))

    def opens(self) -> np.ndarray:
        return np.flatnonzero(self.bits)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Opening parentheses before a place."""
        return self._opened[at]

    def rank_leaf(self, at: np.ndarray) -> np.ndarray:
        """Pairs `()` that begin before a place."""
        return self._pairs[at]

    def find_close(self, opens: np.ndarray) -> np.ndarray:
        """The matching place of each opening parenthesis: the first of lower excess after it."""
        target = self.excess[opens] - 1
        found = self._scan(opens + 1, target, (opens // BLOCK + 1) * BLOCK)
        rest = np.flatnonzero(found < 0)
        if len(rest):
            want = target[rest]
            node = self.leaves + opens[rest] // BLOCK + 1  # the blocks after its own
            node >>= _trailing(node)
            while (high := self.least[node] > want).any():
                after = node[high] + 1  # the widest range that begins where this one ends
                node[high] = after >> _trailing(after)
            while (inner := node < self.leaves).any():
                left = 2 * node[inner]
                node[inner] = np.where(self.least[left] <= want[inner], left, left + 1)
            start = (node - self.leaves) * BLOCK
            found[rest] = self._scan(start, want, start + BLOCK)
        return found

    def _scan(self, place: np.ndarray, target: np.ndarray, end: np.ndarray) -> np.ndarray:
        """First place from `place` on and before `end` whose excess is the target, or -1."""
        found, open_ = np.full(len(place), -1), np.arange(len(place))
        while len(open_ := open_[place[open_] < end[open_]]):
            hit = self.excess[place[open_]] <= target[open_]
            found[open_[hit]] = place[open_[hit]]
            open_ = open_[~hit]
            place[open_] += 1
        return found


def _trailing(x: np.ndarray) -> np.ndarray:
    """Number of zero bits below the lowest set bit."""
    return np.bitwise_count((x & -x) - 1)
