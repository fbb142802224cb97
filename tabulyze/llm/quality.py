"""Quality rules by repetition coverage.

Per text, rolling hashes of n-grams of 5 to 10 words tell which n-grams occur twice or more; a
rule looks at the share of word characters inside such n-grams, first occurrences included, and
at the share inside lines that repeat an earlier line. Windows with equal hashes are compared
word by word before they count.

Defined results: a null or empty text has no words and fails the base rule; extra columns are
ignored; null, repeated or clashing ids are carried through, one row out for each row in.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabulyze.functions.columns import col
from tabulyze.llm.batches import (
    NOT_SPACE, Slice, byte_table, code_point_starts, mix, slices, window_hashes,
)

SYMBOLS = byte_table(b"#*$%&|<>")
BASE_WINDOW = 8


@dataclass(frozen=True)
class RepetitionRules:
    """A text goes if a share is above its limit. n_gram_limits: words in the n-gram -> share.

    The limits lie above what ordinary long texts reach (about a third of their characters).
    """

    n_gram_limits: tuple[tuple[int, float], ...] = (
        (5, 0.50), (6, 0.46), (7, 0.43), (8, 0.41), (9, 0.39), (10, 0.37),
    )
    line_limit: float = 0.30
    min_words: int = 20
    max_repeat_percent: int = 30


MEASURES = pa.struct([
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
    ("dup_line_chars", pa.int64()), ("covered_chars", pa.list_(pa.int64())),
])
MEASURES_DDL = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "dup_line_chars long, covered_chars array<long>"
)


def repeated_windows(words: np.ndarray, text: np.ndarray, size: int,
                     at: np.ndarray) -> np.ndarray:
    """Those of the window positions `at` whose words occur elsewhere in the same text."""
    if len(at) < 2:
        return at[:0]
    keys = window_hashes(words, size)[at] ^ mix(text[at].astype(np.uint64))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    same = keys[1:] == keys[:-1]
    first = np.flatnonzero(same)
    a, b = at[order[first]], at[order[first + 1]]
    equal = text[a] == text[b]
    for k in range(size):
        equal &= words[a + k] == words[b + k]
    found = np.zeros(len(at), bool)
    found[order[first[equal]]] = True
    found[order[first[equal] + 1]] = True
    return at[found]


def covered(n_words: int, at: np.ndarray, size: int) -> np.ndarray:
    """Mask of the words inside windows of `size` words that begin at `at`."""
    steps = np.zeros(n_words + 1, np.int32)
    steps[at] += 1
    np.subtract.at(steps, np.minimum(at + size, n_words), 1)
    return np.cumsum(steps[:-1]) > 0


def _repeated_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and the word characters in them."""
    lines = text.split(b"\n")
    if len(lines) == len(seen := set(lines)):
        return 0, 0
    seen.clear()
    n = chars = 0
    for line in lines:
        if line in seen:
            if words := line.split():
                n += 1
                chars += len(b"".join(words).decode("utf-8", "replace"))
        else:
            seen.add(line)
    return n, chars


def _measure(part: Slice, sizes: tuple[int, ...]) -> dict[str, np.ndarray | list]:
    words = part.words(NOT_SPACE)
    text, bounds = words.text_index(), words.bounds
    hashes = words.hashes()
    points = np.concatenate(([0], np.cumsum(code_point_starts(part.data))))
    chars = points[words.ends] - points[words.starts]
    char_sums = np.concatenate(([0], np.cumsum(chars)))

    def by_text(mask: np.ndarray, weight: np.ndarray | int) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(mask * weight)))
        return sums[bounds[1:]] - sums[bounds[:-1]]

    # A repeated window of n words holds two repeated ones of n - 1: shorter ones come first.
    at, last, found, repeat_words = None, None, {}, None
    for size in sorted({*sizes, BASE_WINDOW}):
        if at is None:
            n = max(len(words) - size + 1, 0)
            at = np.flatnonzero(text[:n] == text[size - 1:size - 1 + n])
        else:
            for _ in range(size - last):
                at = at[:-1][np.diff(at) == 1] if len(at) else at
            at = at[text[at] == text[at + size - 1]]
        at, last = repeated_windows(hashes, text, size, at), size
        mask = covered(len(words), at, size)
        if size in sizes:
            found[size] = by_text(mask, chars)
        if size == BASE_WINDOW:
            repeat_words = by_text(mask, 1)
    lines = np.array([_repeated_lines(t) for t in part.texts], np.int64).reshape(-1, 2)
    return {
        "n_words": words.counts(), "word_chars": char_sums[bounds[1:]] - char_sums[bounds[:-1]],
        "n_symbols": part.per_text(SYMBOLS[part.data]), "n_dup_lines": lines[:, 0],
        "n_repeat_words": repeat_words, "dup_line_chars": lines[:, 1],
        "covered_chars": np.stack([found[s] for s in sizes], axis=1),
    }


def measures(text: Column, rules: RepetitionRules = RepetitionRules()) -> Column:
    """A struct of counts for each text, in Arrow batches."""
    sizes = tuple(size for size, _ in rules.n_gram_limits)

    @F.arrow_udf(MEASURES_DDL)
    def measure(texts: pa.Array) -> pa.Array:
        parts = [_measure(part, sizes) for part in slices(texts)]
        if not parts:
            return pa.array([], MEASURES)
        columns = []
        for one in MEASURES:
            values = np.concatenate([p[one.name] for p in parts]).astype(np.int64)
            if one.name == "covered_chars":
                ends = np.arange(len(values) + 1, dtype=np.int32) * len(sizes)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel())))
            else:
                columns.append(pa.array(values))
        return pa.StructArray.from_arrays(columns, fields=list(MEASURES))

    return measure(text)


def base_failed(m: Column, rules: RepetitionRules) -> Column:
    return (m["n_words"] < rules.min_words) | (
        100 * m["n_repeat_words"] > rules.max_repeat_percent * m["n_words"]
    )


def over_limit(m: Column, rules: RepetitionRules) -> Column:
    """Whether a share of repeated characters is above its limit."""
    over = m["dup_line_chars"] > rules.line_limit * m["word_chars"]
    for i, (_, limit) in enumerate(rules.n_gram_limits):
        over = over | (m["covered_chars"][i] > limit * m["word_chars"])
    return over


def quality(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
            rules: RepetitionRules = RepetitionRules()) -> DataFrame:
    """One row per text: id, counts, base_failed, covered shares and the verdict `kept`."""
    m = F.col("m")
    stamped = docs.select(col(id_column).alias("id"), measures(col(text_column), rules).alias("m"))
    return stamped.select(
        F.col("id").alias(id_column),
        *(m[name].alias(name) for name in
          ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
           "dup_line_chars", "covered_chars")),
        base_failed(m, rules).alias("base_failed"),
        (~base_failed(m, rules) & ~over_limit(m, rules)).alias("kept"),
    )
