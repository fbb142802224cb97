"""Aggregates and exact quantiles that several operators ask of one table, in few passes.

An operator states what it needs as `Asked`; `answered` puts the needs of all operators into one
job, equal ones once, and hands each its own answers. A job of its own, since plain aggregates are
much faster without them, holds a KLL sketch per column whose quantiles are asked. The sketches
enclose each wanted rank, and a last job counts the rows before that range and ranks the few values
inside it. Very large tables take a pass in between that counts and sketches inside the range. A
range that misses its rank costs a pass, never a wrong result, and no task ever sorts a whole column.

Columns with infinite values take one job more, which counts these: ranks among them are known.
"""

from __future__ import annotations

import math
import struct
from bisect import bisect_left, bisect_right
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Most rows inside a range whose values are ranked by one task.
VALUE_LIMIT = 1_000_000
# Size parameter of the sketches, and even steps at which quantiles are read where ranks are not
# known beforehand.
SKETCH_SIZE = 8192
GRID = 256
EVEN = [i / GRID for i in range(GRID + 1)]


@dataclass
class Asked:
    """Aggregates by name, and by name the values and shares of quantiles."""

    aggregates: Mapping[str, Column] = field(default_factory=dict)
    quantiles: Mapping[str, tuple[Column, Sequence[float]]] = field(default_factory=dict)


Answer = dict[str, Any]


class _Merged:
    """Columns, equal ones once."""

    def __init__(self) -> None:
        self.columns: list[Column] = []
        self._by_text: dict[str, list[int]] = {}

    def add(self, c: Column) -> int:
        alike = self._by_text.setdefault(str(c), [])
        for i in alike:
            known = self.columns[i]
            if known is c or (hasattr(c, "_jc") and known._jc.equals(c._jc)):
                return i
        alike.append(len(self.columns))
        self.columns.append(c)
        return alike[-1]


def middle(low: float, high: float) -> float:
    """A double halfway between two others in the order of doubles."""

    def place(x: float) -> int:
        bits = struct.unpack("<q", struct.pack("<d", x))[0]
        return bits if bits >= 0 else -(bits & 0x7FFF_FFFF_FFFF_FFFF)

    at = (place(low) + place(high)) // 2
    size = struct.unpack("<d", struct.pack("<q", abs(at)))[0]
    return math.copysign(size, at)


@dataclass
class _Ranks:
    """The finite values at ranks k0 and k1, which is k0 or the next.

    They lie from `low` to `high`, both included: `below` values come before, `inside` are in it.
    `lo` and `hi` guess a narrower range, about `expected` values wide.
    """

    of: int
    k0: int
    k1: int
    inside: int
    low: float
    high: float
    below: int = 0
    lo: float = 0.0
    hi: float = 0.0
    expected: float = 0.0
    stuck: int = 0
    found: dict[int, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.guess_all()

    def guess_all(self) -> None:
        self.lo, self.hi, self.expected = self.low, self.high, self.inside

    @property
    def open(self) -> set[int]:
        return {self.k0, self.k1} - self.found.keys()

    def take(self, before: int, within: int, last: float | None, first: float | None) -> bool:
        """Values from `low` to below `lo`, and in the guess; the greatest below, the least above.

        Whether the open ranks lie in the guess.
        """
        start, was = self.below + before, self.inside
        end, whole = start + within, (self.lo, self.hi) == (self.low, self.high)
        for k in self.open:
            if k == start - 1 and last is not None:
                self.found[k] = last
            elif k == end and first is not None:
                self.found[k] = first
            elif start <= k < end and self.lo == self.hi:
                self.found[k] = self.lo
        if not self.open:
            return False
        k = min(self.open)
        if k < start:
            self.high, self.inside = last, before
        elif k >= end:
            self.low, self.below, self.inside = first, end, was - before - within
        else:
            self.low, self.high, self.below, self.inside = self.lo, self.hi, start, within
        self.guess_all()
        if not whole and self.inside > was / 2:
            self.probe()
        return start <= k < end

    def probe(self) -> None:
        """Guess one value: halve the range, or take an end of it, where equal values may be."""
        points = (middle(self.low, self.high), self.low, self.high)
        self.lo = self.hi = points[self.stuck % 3]
        self.expected, self.stuck = math.inf, self.stuck + 1

    def enclose(self, grid: Sequence[float], margin: float, shares: Sequence[float] = EVEN) -> None:
        """Guess from quantiles of the values inside at ascending shares, from 0 to 1."""
        steps, span = len(shares) - 1, max(self.inside - 1, 1)
        at = [(k - self.below) / span for k in self.open]
        first = max(bisect_right(shares, min(at) - margin) - 1, 0)
        last = min(bisect_left(shares, max(at) + margin), steps)
        lo, hi = max(grid[first], self.low), min(grid[last], self.high)
        if first == 0:
            lo = self.low
        if last == steps:
            hi = self.high
        if lo <= hi and self.lo < self.hi:
            self.lo, self.hi = lo, hi
            self.expected = self.inside * (shares[last] - shares[first] + margin)


def _quantiles_at(value: Column, size: int, shares: Sequence[float]) -> Column:
    steps = F.expr(f"array({', '.join(f'{x!r}D' for x in shares)})")
    sketch = F.kll_sketch_agg_double(value, size)
    return F.when(F.count(value) > 0, F.kll_sketch_get_quantile_double(sketch, steps))


def _even_quantiles(value: Column, size: int) -> Column:
    return _quantiles_at(value, size, EVEN)


def _around(shares: Sequence[float], margin: float) -> list[float]:
    """Where quantiles are read to enclose the ranks at these shares."""
    # Ranks are whole numbers, beside their share by a row: in few rows that outweighs the margin.
    wide = [sign * margin * x for sign in (-1, 1) for x in (1.01, 2, 8)]
    return sorted({0.0, 1.0, *(min(max(p + d, 0.0), 1.0) for p in shares for d in wide)})


def _margin(size: int) -> float:
    """Twice the rank error that 99 of 100 sketches of this size stay within."""
    return 2 * 2.296 / size ** 0.9021


def _sides(r: _Ranks, v: Column) -> list[Column]:
    """Count below the guess and in it, the greatest value below and the least above."""
    under, over = (v >= r.low) & (v < r.lo), (v > r.hi) & (v <= r.high)
    return [F.count_if(under), F.count_if(v.between(r.lo, r.hi)), F.max(F.when(under, v)),
            F.min(F.when(over, v))]


def _narrow(df: DataFrame, ranks: Sequence[_Ranks], values: Sequence[Column], size: int) -> None:
    """One job: counts around the guesses, and sketches of what lies in them."""
    asks = []
    for r in ranks:
        v = values[r.of]
        asks += [*_sides(r, v), _even_quantiles(F.when(v.between(r.lo, r.hi), v), size)]
    row = df.agg(*[c.alias(f"a{i}") for i, c in enumerate(asks)]).first()
    for i, r in enumerate(ranks):
        *sides, grid = row[5 * i:5 * i + 5]
        whole, was = (r.lo, r.hi) == (r.low, r.high), r.inside
        if r.take(*sides) and grid:
            r.enclose(grid, _margin(size))
        if r.open and whole and r.inside == was and (r.lo, r.hi) == (r.low, r.high):
            r.probe()  # the sketch of the whole range did not narrow it


def _ranges(ranks: Sequence[_Ranks]) -> list[list[_Ranks]]:
    """Ranks of a column whose guesses overlap belong together."""
    groups: list[list[_Ranks]] = []
    for r in sorted(ranks, key=lambda r: (r.of, r.lo)):
        last = groups[-1] if groups else []
        if last and last[0].of == r.of and r.lo <= max(x.hi for x in last):
            last.append(r)
        else:
            groups.append([r])
    return groups


def _finish(df: DataFrame, ranks: Sequence[_Ranks], values: Sequence[Column]) -> None:
    """One job: counts below the guesses, and the ranked values inside them."""
    groups = _ranges(ranks)
    ends = [(g[0].lo, max(r.hi for r in g)) for g in groups]
    before = df.agg(*[
        F.count_if(values[g[0].of] < lo).alias(f"s{t}")
        for t, (g, (lo, _)) in enumerate(zip(groups, ends))
    ]).select(F.posexplode(F.array(*[F.col(f"s{t}") for t in range(len(groups))])).alias("t", "n"))
    # Values go one below the other before the ranges are tested: one expression of all columns
    # and ranges outgrows what is compiled.
    used = sorted({g[0].of for g in groups})
    pos, v = F.col("pos"), F.col("col")
    held = [(pos == used.index(g[0].of)) & v.between(*e) for g, e in zip(groups, ends)]
    tag = reduce(lambda a, x: a.when(x[1], x[0]), enumerate(held), F)
    inside = (
        df.select(F.posexplode(F.array(*[values[i] for i in used])))
        .filter(reduce(or_, held)).groupBy(tag.alias("t"), v.alias("v"))
        .agg(F.count("*").alias("n"))
    )
    running = W.partitionBy("t").orderBy(F.asc_nulls_first("v")).rowsBetween(
        W.unboundedPreceding, W.currentRow)
    wanted = [sorted({k for r in g for k in r.open}) for g in groups]
    width = max(map(len, wanted))

    def pick(j: int) -> Column:
        ks = F.lit([g[j] if j < len(g) else -1 for g in wanted]).cast("array<bigint>")
        k = F.get(ks, F.col("t"))
        return F.max(F.when((F.col("upto") - F.col("n") <= k) & (k < F.col("upto")), F.col("v")))

    rows = (  # the count below comes first, as a row without a value
        before.select("t", F.lit(None).cast("double").alias("v"), "n").union(inside)
        .withColumn("upto", F.sum("n").over(running)).groupBy("t")
        .agg(*[pick(j).alias(f"v{j}") for j in range(width)])
        .collect()  # one row per range
    )
    for row in rows:
        t = row["t"]
        found = {k: row[f"v{j}"] for j, k in enumerate(wanted[t]) if row[f"v{j}"] is not None}
        for r in groups[t]:
            r.found |= {k: found[k] for k in r.open if k in found}
            r.expected = math.inf  # if a rank lies elsewhere, its range is counted and cut


def _settle(df: DataFrame, ranks: Sequence[_Ranks], values: Sequence[Column], limit: int,
            size: int) -> None:
    while waiting := [r for r in ranks if r.open]:
        large = [r for r in waiting if r.expected > limit]
        if large:
            _narrow(df, large, values, size)
        else:
            _finish(df, waiting, values)


def _between(a: float, b: float, position: float) -> float:
    part = position - math.floor(position)
    if a == b or part == 0:
        return a
    if math.isfinite(a) and math.isfinite(b):
        return a + (b - a) * part
    return a * (1 - part) + b * part


def answered(df: DataFrame, *asked: Asked, limit: int = VALUE_LIMIT,
             sketch_size: int = SKETCH_SIZE) -> list[Answer]:
    """The answers to each of `asked`, over all rows of `df`, as values on the driver.

    Null and NaN count as missing in quantiles, which are lists as long as the shares asked, of
    nulls where there is no value. One row per aggregate and quantile reaches the driver.
    """
    merged, sketched = _Merged(), _Merged()
    places = [{n: merged.add(c) for n, c in a.aggregates.items()} for a in asked]
    wanted = []
    for a in asked:
        wanted.append({n: sketched.add(c.cast("double")) for n, (c, _) in a.quantiles.items()})
    values = [F.when(~F.isnan(c), c) for c in sketched.columns]
    sized = [[merged.add(f(v)) for f in (F.count, F.min, F.max)] for v in values]
    if not merged.columns:
        return [{} for _ in asked]
    row = df.agg(*[c.alias(f"a{i}") for i, c in enumerate(merged.columns)]).first()
    margin = _margin(sketch_size)
    shares_of: list[list[float]] = [[] for _ in values]
    for a, at in zip(asked, wanted):
        for name, (_, shares) in a.quantiles.items():
            shares_of[at[name]] += shares
    steps = [_around(shares, margin) for shares in shares_of]
    slim = df.select(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    sketches = slim.agg(*[
        _quantiles_at(F.col(f"v{i}"), sketch_size, at).alias(f"a{i}") for i, at in enumerate(steps)
    ]).first() if values else ()
    # Of each column: finite values, those below and above, the ends of the finite, their sketch.
    known = [(row[n], 0, 0, row[low], row[high], sketches[i])
             for i, (n, low, high) in enumerate(sized)]
    endless = [i for i, k in enumerate(known) if k[0] and not (
        math.isfinite(k[3]) and math.isfinite(k[4]))]
    for i in endless:
        values[i] = F.when(F.abs(values[i]) < math.inf, values[i])
    if endless:
        asks = []
        for i in endless:
            c, v = sketched.columns[i], values[i]
            asks += [F.count(v), F.count_if(c == -math.inf), F.count_if(c == math.inf), F.min(v),
                     F.max(v), _even_quantiles(v, sketch_size)]
        again = df.agg(*[c.alias(f"a{j}") for j, c in enumerate(asks)]).first()
        for j, i in enumerate(endless):
            known[i], steps[i] = again[6 * j:6 * j + 6], EVEN
    ranks: dict[tuple[int, int, int], _Ranks] = {}

    def rank(i: int, k: int, other: int) -> float | tuple:
        n, low, high = known[i][:3]
        if k < low:
            return -math.inf
        if k >= low + n:
            return math.inf
        pair = sorted({min(max(x - low, 0), n - 1) for x in (k, other)})
        key = (i, pair[0], pair[-1])
        if key not in ranks:
            r = ranks[key] = _Ranks(i, pair[0], pair[-1], n, known[i][3], known[i][4])
            if n > 1 and known[i][5] and r.low < r.high:
                r.enclose(known[i][5], margin, steps[i])
            elif r.low == r.high:
                r.found = dict.fromkeys(pair, r.low)
        return (key, k - low)

    plan = []
    for a, at in zip(asked, wanted):
        for name, (_, shares) in a.quantiles.items():
            i = at[name]
            n = sum(known[i][:3])
            for p in shares:
                position = p * (n - 1)
                k0, k1 = math.floor(position), math.ceil(position)
                plan.append((position, rank(i, k0, k1), rank(i, k1, k0)) if n else None)
    slim = df.select(*[v.alias(f"v{i}") for i, v in enumerate(values)]) if ranks else df
    _settle(slim, list(ranks.values()), [F.col(f"v{i}") for i in range(len(values))], limit,
            sketch_size)

    def value(found: float | tuple) -> float:
        return ranks[found[0]].found[found[1]] if isinstance(found, tuple) else found

    results, at = [], iter(plan)
    for a, place in zip(asked, places):
        answer: Answer = {n: row[i] for n, i in place.items()}
        for name, (_, shares) in a.quantiles.items():
            got = [next(at) for _ in shares]
            answer[name] = [
                None if g is None else _between(value(g[1]), value(g[2]), g[0]) for g in got]
        results.append(answer)
    return results
