"""Files that tasks write to the shared folder.

A task writes under a name of its own and hands the name on as a row; only names in the rows that
Spark commits count, so what a lost or repeated attempt leaves behind is never read.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def write_file(folder: str, stem: str, parts: list[bytes]) -> str:
    """Write a new file and return its full name."""
    path = f"{folder}/{stem}-{uuid.uuid4().hex}"
    system, name = _located(path)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    with system.open_output_stream(name) as out:
        for part in parts:
            out.write(part)
    return path


def read_file(path: str, start: int = 0, size: int | None = None) -> bytes:
    """Bytes of a file from `start`; a negative start counts from the end."""
    system, name = _located(path)
    with system.open_input_file(name) as file:
        length = file.size()
        at = start if start >= 0 else max(length + start, 0)
        return file.read_at(length - at if size is None else size, at)


def remove_folder(path: str) -> None:
    """Remove a folder written along the way, once nothing reads it any more."""
    system, name = _located(path)
    system.delete_dir(name)
