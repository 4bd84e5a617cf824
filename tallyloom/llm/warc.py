"""WARC records in seekable Zstandard bundles.

A bundle is a run of independent Zstandard frames, each with some whole
records, and a last, skippable frame with the sizes of all frames (the
Zstandard seekable format), so any Zstandard reader can read a bundle from end
to end.  The index maps a record's identifier to bundle, frame and its offset in
the decompressed frame: one record costs the footer and one frame.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the formats: magic numbers, and the profile of revisits.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Warc:
    """frame and bundle: bytes after which they are closed, decompressed and compressed.  least: bytes of a payload that revisits may refer to."""

    frame: int = 1 << 20
    bundle: int = 256 << 20
    level: int = 3
    least: int = 100
    date: str = "1970-01-01T00:00:00Z"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, p: Warc) -> bytes:
    """One record.  The block is an HTTP response; a revisit's has no body, but still says how long it was."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {p.date}",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~') if url else record_id(page_id)[1:-1]}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    else:
        block += payload
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], memoryview, int]:
    """Headers, block and end of the record that begins at a place."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no record at {at}")
    headers = dict(line.split(": ", 1) for line in lines)
    stop = end + 4 + int(headers["Content-Length"])
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} isn't whole")
    return headers, memoryview(data)[end + 4 : stop], stop + 4


class BundleWriter:
    def __init__(self, file, p: Warc):
        self.file, self.p, self.zstd = file, p, zstandard.ZstdCompressor(level=p.level)
        self.sizes: list[tuple[int, int]] = []
        self.held, self.size, self.written = [], 0, 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame number and offset in the frame."""
        if self.size >= self.p.frame:
            self.flush()
        place = len(self.sizes), self.size
        self.held.append(data)
        self.size += len(data)
        return place

    def flush(self) -> None:
        if self.held:
            frame = self.zstd.compress(b"".join(self.held))
            self.file.write(frame)
            self.sizes.append((len(frame), self.size))
            self.written += len(frame)
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        self.file.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.file.close()


class BundleReader:
    def __init__(self, file):
        self.file, size = file, file.size()
        file.seek(size - 9)
        n, _, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        file.seek(size - 9 - 8 * n)
        entries = struct.unpack(f"<{2 * n}I", file.read(8 * n))
        self.frames, at = [], 0
        for k in range(n):
            self.frames.append((at, entries[2 * k], entries[2 * k + 1]))
            at += entries[2 * k]

    def frame(self, k: int) -> bytes:
        at, packed, size = self.frames[k]
        self.file.seek(at)
        return zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=size)

    def records(self) -> Iterator[tuple[dict[str, str], memoryview]]:
        for k in range(len(self.frames)):
            data, at = self.frame(k), 0
            while at < len(data):
                headers, block, at = parse_record(data, at)
                yield headers, block


def _write(folder: str, p: Warc, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every attempt at a task writes files of its own; the index names those of the attempt that counted."""
    system, root = open_folder(folder)
    system.create_dir(root, recursive=True)
    writer, name = None, ""
    for batch in batches:
        columns = [batch.column(c) for c in ("page_id", "url", "payload", "payload_digest", "refers_to", "revisit")]
        rows = []
        for k in range(batch.num_rows):
            page_id, url, payload, digest, refers_to, revisit = (c[k].as_py() for c in columns)
            if writer is None:
                name = f"{uuid.uuid4().hex}.warc.zst"
                writer = BundleWriter(system.open_output_stream(f"{root}/{name}", compression=None), p)
            rows.append((record_id(page_id), name, *writer.add(record(page_id, url, payload.encode(), digest, refers_to, revisit, p))))
            if writer.written >= p.bundle:
                writer.close()
                writer = None
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=["record_id", "bundle", "frame", "offset"]) if rows else _no_index()
    if writer is not None:
        writer.close()


def _no_index() -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.string(), pa.string(), pa.int64(), pa.int64())], names=["record_id", "bundle", "frame", "offset"])


def _page(record_id: str | None) -> int | None:
    name = (record_id or "").rpartition(":")[2].rstrip(">")
    return None if name in ("", "none") else int(name)


def _row(headers: dict[str, str], block: memoryview) -> tuple:
    head, _, payload = bytes(block).partition(b"\r\n\r\n")
    size = next(int(line.split(b":")[1]) for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = headers["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {headers['WARC-Record-ID']} isn't whole")
    return _page(headers["WARC-Record-ID"]), size, digest, headers["WARC-Type"], _page(headers.get("WARC-Refers-To")), None if revisit else payload


def _read(folder: str, payloads: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    system, root = open_folder(folder)
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 6 if payloads else 5]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: len(types)]
    for batch in batches:
        for name in batch.column("bundle").to_pylist():
            with system.open_input_file(f"{root}/{name}") as file:
                rows = []
                for headers, block in BundleReader(file).records():
                    rows.append(_row(headers, block)[: len(types)])
                    if len(rows) == 512:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _fetch(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    system, root = open_folder(folder)
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            with system.open_input_file(f"{root}/{r['bundle']}") as file:
                headers, block, _ = parse_record(BundleReader(file).frame(r["frame"]), r["offset"])
            rows.append((headers["WARC-Record-ID"], *_row(headers, block)[3:]))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.binary()))], names=["record_id", "record_type", "refers_to", "payload"])


def write_archives(pages: DataFrame, folder: str, params: Warc = Warc()) -> DataFrame:
    """Writes a record for every row of pages(page_id, url, html, ...) into bundles in a shared folder; a lazy index (record_id, bundle, frame, offset).

    The files are written when the index is: save it once and read that.  The
    payload is html in UTF-8, a null is empty.  Of the records with equal
    payloads of at least `least` bytes the one with the smallest page_id is a
    response and the others revisit it; smaller payloads are all responses.
    Rows that repeat the smallest page_id are responses too; a null page_id is
    larger than any other.  Further columns are ignored.  folder: local or any
    file system that pyarrow reads.
    """
    payload = F.coalesce("html", F.lit(""))
    size, digest = F.octet_length(payload), F.sha2(payload, 256)
    large = pages.select("page_id", digest.alias("payload_digest"), size.alias("n")).where(F.col("n") >= params.least).drop("n")
    firsts = large.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null").drop("n")
    revisits = large.join(firsts, "payload_digest").where("not (page_id <=> refers_to)").distinct()
    revisits = revisits.select(F.col("page_id").alias("own"), F.col("payload_digest").alias("same"), "refers_to")
    rows = pages.select("page_id", "url", payload.alias("payload"), digest.alias("payload_digest"))
    rows = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("own")) & (F.col("payload_digest") == F.col("same")), "left")
    rows = rows.select("page_id", "url", "payload", "payload_digest", "refers_to", F.col("refers_to").isNotNull().alias("revisit"))
    return rows.mapInArrow(partial(_write, folder, params), "record_id string, bundle string, frame long, offset long")


def read_archives(index: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (and payload) of every record of the index's bundles, with lengths and digests checked."""
    bundles = index.select("bundle").distinct()
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return bundles.mapInArrow(partial(_read, folder, payloads), schema)


def fetch_records(index: DataFrame, wanted: DataFrame, folder: str) -> DataFrame:
    """record_id, record_type, refers_to, payload of the record_ids in `wanted`, each from its one frame."""
    places = index.join(wanted.select("record_id").distinct(), "record_id").select("record_id", "bundle", "frame", "offset")
    return places.mapInArrow(partial(_fetch, folder), "record_id string, record_type string, refers_to long, payload binary")
