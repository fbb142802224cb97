"""WARC bundles in seekable Zstandard.

Records are grouped into independent frames; a skippable frame at the end lists compressed and
full size of each (the public seekable format). The index gives for each record identifier its
bundle, frame, and offset and length inside the unpacked frame, so one record costs one frame.

Of equal payloads of `least_bytes` or more, the record with the smallest id is a response, and the
others revisit it. Defined results: a null payload is empty; rows that repeat the smallest id are
all responses; a null id never is the smallest, and a group of null ids only has no revisits; a
null URL leaves its header out; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tabulyze.functions.columns import col
from tabulyze.llm.shared_files import read_file, write_file
from tabulyze.llm.stamping import written
from tabulyze.session import scratch_path

LEAST_BYTES = 100
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 28
LEVEL = 3

#: Fixed values of the seekable format and of WARC 1.1.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

FOOTER = struct.Struct("<IBI")
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str,
           refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit with the HTTP header only."""
    http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            b"Content-Length: %d\r\n\r\n" % len(payload))
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        safe = _UNSAFE.sub(lambda m: f"%{ord(m.group()):02X}", url)
        head.append(f"WARC-Target-URI: {safe}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to, digest)}",
                 f"X-Refers-To-Page-ID: {refers_to}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}",
             "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class BundleWriter:
    """Frames of one bundle and the places of the records in them."""

    def __init__(self) -> None:
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.held_bytes = self.total = 0

    def add(self, data: bytes) -> tuple[int, int, int]:
        """Frame, offset in the frame, and length of the record."""
        place = (len(self.frames), self.held_bytes, len(data))
        self.held.append(data)
        self.held_bytes += len(data)
        self.total += len(data)
        if self.held_bytes >= FRAME_BYTES:
            self.close_frame()
        return place

    def close_frame(self) -> None:
        if self.held:
            frame = self.packer.compress(b"".join(self.held))
            self.frames.append(frame)
            self.sizes.append((len(frame), self.held_bytes))
            self.held, self.held_bytes = [], 0

    def parts(self) -> list[bytes]:
        self.close_frame()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        footer = FOOTER.pack(len(self.sizes), 0, SEEKABLE_MAGIC)
        table = entries + footer
        return [*self.frames, struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table]


def seek_table(path: str) -> list[tuple[int, int]]:
    """Start and compressed size of each frame, from the end of the file."""
    n, flags, magic = FOOTER.unpack(read_file(path, -FOOTER.size))
    if magic != SEEKABLE_MAGIC:
        raise ValueError(f"No seek table in {path}")
    each = 12 if flags & 0x80 else 8
    raw = read_file(path, -(FOOTER.size + each * n), each * n)
    frames, at = [], 0
    for i in range(n):
        size, _ = struct.unpack_from("<II", raw, each * i)
        frames.append((at, size))
        at += size
    return frames


def read_frame(path: str, place: tuple[int, int]) -> bytes:
    return zstandard.ZstdDecompressor().decompress(read_file(path, *place))


def read_record(path: str, frame: int, offset: int, length: int) -> "Record":
    """One record by its place in the index."""
    data = read_frame(path, seek_table(path)[frame])
    return next(parse(data[offset:offset + length]))


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def parse(data: bytes) -> Iterator[Record]:
    """The records of an unpacked frame."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        headers = _fields(data[at:end])
        start, size = end + 4, int(headers["content-length"])
        block = data[start:start + size]
        if len(block) != size or data[start + size:start + size + 4] != b"\r\n\r\n":
            raise ValueError("Broken WARC record")
        split = block.index(b"\r\n\r\n")
        yield Record(headers, _fields(block[:split]), block[split + 4:])
        at = start + size + 4


def write_bundles(pages: DataFrame, id_column: str = "page_id", url_column: str = "url",
                  payload_column: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write the bundles; the index of records: record_id, path, frame, offset, length."""
    folder = scratch_path(pages.sparkSession, "warc")
    payload = F.coalesce(col(payload_column).cast("binary"), F.lit(b""))
    rows = pages.select(
        col(id_column).cast("long").alias("id"), col(url_column).alias("url"),
        payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    first = (
        rows.filter(F.octet_length("payload") >= least_bytes).groupBy("digest")
        .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select("digest", "first")
    )
    refers = F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")),
                    F.col("first"))
    judged = rows.join(first, "digest", "left").select(
        "id", "url", "payload", "digest", refers.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        bundle, index = BundleWriter(), []

        def flush() -> pa.RecordBatch:
            path = write_file(folder, f"part-{part:06d}-{number:05d}.warc.zst", bundle.parts())
            return pa.RecordBatch.from_pydict({
                "record_id": [x[0] for x in index], "path": [path] * len(index),
                "frame": pa.array([x[1] for x in index], pa.int32()),
                "offset": pa.array([x[2] for x in index], pa.int64()),
                "length": pa.array([x[3] for x in index], pa.int64())})

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                page, url, payload, digest, refers_to = row
                index.append((record_id(page, digest), *bundle.add(
                    record(page, url, payload, digest, refers_to))))
                if bundle.total >= BUNDLE_BYTES:
                    yield flush()
                    bundle, index, number = BundleWriter(), [], number + 1
        if index:
            yield flush()

    return written(judged.mapInArrow(
        write, "record_id string, path string, frame int, offset long, length long"),
        "warc-index")


def read_bundles(index: DataFrame, id_column: str = "page_id") -> DataFrame:
    """Unpack the bundles of an index: a row per record, digests taken from the payloads."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                for place in seek_table(path):
                    rows = [_row(r) for r in parse(read_frame(path, place))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in zip(zip(*rows), (
                            pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))],
                        names=[id_column, "payload_bytes", "payload_digest", "record_type",
                               "refers_to"])

    paths = index.select("path").distinct()
    n = max(1, min(paths.count(), 10_000))
    return paths.repartition(n).mapInArrow(
        read, f"`{id_column}` long, payload_bytes long, payload_digest string, "
              "record_type string, refers_to long")


def _row(r: Record) -> tuple:
    kind = r.headers["warc-type"]
    page, refers = r.headers.get("x-page-id"), r.headers.get("x-refers-to-page-id")
    digest = r.headers["warc-payload-digest"].removeprefix("sha256:")
    if kind == "response" and hashlib.sha256(r.payload).hexdigest() != digest:
        raise ValueError(f"Payload of {r.headers['warc-record-id']} does not fit its digest")
    return (int(page) if page is not None else None, int(r.http["content-length"]), digest, kind,
            int(refers) if refers is not None else None)


def archived(pages: DataFrame, **options) -> DataFrame:
    """Write the pages as bundles, read them back, and describe each record."""
    return read_bundles(write_bundles(pages, **options),
                        options.get("id_column", "page_id"))
