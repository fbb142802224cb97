"""Arrow batches of sorted rows, cut so that equal keys stay together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_runs(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[pa.Table]:
    """Tables that end where the key changes; a key's rows are never in two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut or (held and held[-1].column(key)[-1].as_py() != keys[0]):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def blobs(table: pa.Table, name: str, kind: str = "<i8") -> tuple[np.ndarray, np.ndarray]:
    """Numbers in a binary column, joined, and where each row's begin and the last ends."""
    column = table.column(name).combine_chunks().cast(pa.large_binary())
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], "<i8", len(column) + 1, 8 * column.offset)
    data = column.buffers()[2]
    size = int(offsets[-1] - offsets[0])
    wide = np.dtype(kind).itemsize
    values = np.frombuffer(data, kind, size // wide, int(offsets[0])) if size else np.zeros(0, kind)
    return values, (offsets - offsets[0]) // wide


def lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in a list column without nulls, joined, and where each row's begin."""
    column = table.column(name).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(), offsets - offsets[0]


def starts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))[:len(keys)])


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] numbers, then the same for the next."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(start - (ends - size), size)
