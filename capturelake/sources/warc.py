"""WARC archives: a Python data source that reads records, and a writer of one archive per partition."""

from __future__ import annotations

import gzip
import io
import os
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import IO
from urllib.parse import urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..batches import BYTES, ROWS, short_batches
from ..config import GENERATOR
from ..storage import exists, join, names, opened

RECORD_SCHEMA = "record_type string, target_uri string, record_id string, date string, content_type string, http_headers string, body binary"
_ARROW = pa.schema([(name, pa.binary() if kind == "binary" else pa.string()) for name, kind in (c.split() for c in RECORD_SCHEMA.split(", "))])
_HOP = "transfer-encoding content-encoding content-length".split()


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), *fields, ("Content-Length", str(len(block)))])
    return gzip.compress(f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n", mtime=0)


def without_user(url: str) -> str:
    """A URL without name and password."""
    u = urlsplit(url)
    return urlunsplit((u.scheme, u.netloc.rpartition("@")[2], u.path, u.query, u.fragment))


def info_record(at: str) -> bytes:
    return _record("warcinfo", [("WARC-Date", at), ("Content-Type", "application/warc-fields")], f"software: {GENERATOR}\r\nformat: WARC File Format 1.1\r\n".encode())


def capture_records(url: str, at: str, status: int, headers: dict[str, str], body: bytes) -> bytes:
    """A request and its response, each a gzip member."""
    target = without_user(url)
    u = urlsplit(target)
    ask = f"GET {u.path or '/'}{'?' + u.query if u.query else ''} HTTP/1.1\r\nHost: {u.netloc}\r\n\r\n".encode()
    kept = [(k, v) for k, v in sorted(headers.items()) if k.lower() not in _HOP] + [("content-length", str(len(body)))]
    answer = (f"HTTP/1.1 {status}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in kept) + "\r\n").encode() + body
    both = [("WARC-Target-URI", target), ("WARC-Date", at)]
    return _record("request", [*both, ("Content-Type", "application/http; msgtype=request")], ask) + _record("response", [*both, ("Content-Type", "application/http; msgtype=response")], answer)


def append(path: str, captures: list[tuple[str, str, int, dict[str, str], bytes]]) -> None:
    """Adds captures (url, time, status, headers, body) to an archive; a new one begins with its description."""
    fresh = not os.path.exists(path) or not os.path.getsize(path)
    with open(path, "ab") as f:
        if fresh and captures:
            f.write(info_record(captures[0][1]))
        for c in captures:
            f.write(capture_records(*c))


def archives(captures: DataFrame) -> DataFrame:
    """(part, archive): one archive per partition of captures (url, fetched_at, status_code, response_headers, raw_bytes).

    Archives can be written anywhere and joined end to end; a retried task makes its own anew.
    """
    from pyspark import TaskContext

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, piece, where = bytearray(), 0, TaskContext.get().partitionId()

        def whole() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": [f"part-{where:05d}-{piece:05d}.warc.gz"], "archive": pa.array([held], pa.binary())})

        for part in parts:
            for r in part.to_pylist():
                if not held:
                    held += info_record(r["fetched_at"] or "")
                held += capture_records(r["url"], r["fetched_at"] or "", int(r["status_code"]), dict(r["response_headers"] or {}), r["raw_bytes"])
                if len(held) > 64 << 20:
                    yield whole()
                    held, piece = bytearray(), piece + 1
        if held:
            yield whole()

    rows = captures.where(F.coalesce("status_code", F.lit(0)) > 0).select("url", "fetched_at", "status_code", "response_headers", F.col("raw_bytes").cast("binary").alias("raw_bytes"))
    return short_batches(rows).mapInArrow(run, "part string, archive binary")


def _members(stream: IO[bytes]) -> Iterator[bytes]:
    """Contents of the gzip members of a stream, which is read in short pieces: what follows a member is copied for each."""
    member, parts = zlib.decompressobj(31), []
    held = stream.read(1 << 16)
    while held:
        parts.append(member.decompress(held))
        if member.eof:
            yield b"".join(parts)
            held, member, parts = member.unused_data, zlib.decompressobj(31), []
        else:
            held = b""
        held = held or stream.read(1 << 16)
    if parts:
        yield b"".join([*parts, member.flush()])


def records(archive: bytes | IO[bytes]) -> Iterator[tuple[str, str, str, str, str, str, bytes]]:
    """Rows of RECORD_SCHEMA from the bytes of an archive, or a stream of them, one gzip member a record."""
    for raw in _members(io.BytesIO(archive) if isinstance(archive, bytes) else archive):
        head, _, rest = raw.partition(b"\r\n\r\n")
        named = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
        block = rest[: int(named.get("content-length", 0))]
        http, body = "", block
        if named.get("content-type", "").startswith("application/http"):
            top, _, body = block.partition(b"\r\n\r\n")
            http = top.decode("utf-8", "replace")
        yield (named.get("warc-type", ""), named.get("warc-target-uri", ""), named.get("warc-record-id", ""), named.get("warc-date", ""), named.get("content-type", ""), http, body)


def _batches(found: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Records as Arrow batches of bounded size."""
    held, size = [], 0
    for r in found:
        held.append(r)
        size += len(r[-1])
        if len(held) >= ROWS or size >= BYTES:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*held), _ARROW.types)), schema=_ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays(list(map(pa.array, zip(*held), _ARROW.types)), schema=_ARROW)


def stored_records(archives: DataFrame) -> DataFrame:
    """Rows of RECORD_SCHEMA of archives (archive)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for data in part.column("archive"):
                yield from _batches(records(pa.BufferReader(data.as_buffer())))

    return short_batches(archives.select("archive")).mapInArrow(run, RECORD_SCHEMA)


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        if exists(self.path):
            return [_File(self.path)]
        return [_File(join(self.path, n)) for n in names(self.path) if n.endswith((".warc.gz", ".warc"))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        with opened(partition.path) as f:
            yield from _batches(records(f))


class WarcSource(DataSource):
    """``spark.dataSource.register(WarcSource)``, then ``spark.read.format("warc").load(folder)``: a task per archive."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return RECORD_SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options["path"])
