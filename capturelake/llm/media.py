"""Media columns: signature sniffing, validation and carving, and 8-bit sound as a lossless store of texts.

An Aho-Corasick automaton over all magic byte strings reads a value once.  Each place it reports is handed to the
validator of that format, which walks the format's structure and gives the length it really has, or nothing.  The valid
format at the start of a value corrects its declared type; valid formats further inside are carved.

``store_texts`` keeps a text as the samples of a WAV file (8-bit mono PCM): UTF-8, zero bytes up to a positive multiple of
``UNIT``.  Everything reported of it is computed from the samples carved out of the stored bytes.

Defined results: null text is the empty text (one unit of zero bytes); null content has type null and no parts; rows that
repeat are stored once each, equal texts to equal bytes; extra columns are ignored by the stores and kept by ``sniff``, whose
own columns replace those of the same names.  A text is held whole, with its stored form and the samples read back; rows
are handed on whenever some megabytes of stored forms are held.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import short_batches
from .text import string_buffers

UNIT = 64
RATE = 8000
PDF_END = re.compile(rb"startxref\s+\d+\s+%%EOF")


class Value:
    """Bytes that are looked into, and what validators have already found out about them.

    Places of end records are collected once; chains of blocks (``chain``) remember for every place where its chain ends.
    So a value full of magic bytes costs each place once, not once for each magic byte string in front of it.
    """

    def __init__(self, content: bytes) -> None:
        self.raw, self.view = content, memoryview(content)
        self.known: dict[str, array] = {}

    def chain(self, name: str, at: int, step: Callable[[int], tuple[bool, int]]) -> int:
        """Where the chain of blocks that starts at ``at`` ends, or -1; ``step`` gives (done, end) or (not done, next place)."""
        size = len(self.raw)
        if name not in self.known:
            self.known[name] = array("q", [-2]) * (size + 1)
        ends, path, end = self.known[name], [], -1
        while at <= size:
            if ends[at] != -2:
                end = ends[at]
                break
            path.append(at)
            done, at = step(at)
            if done:
                end = at
                break
        for p in path:
            ends[p] = end
        return end

    def places(self, needle: bytes, at: int = 0) -> Iterator[int]:
        at = self.raw.find(needle, at)
        while at >= 0:
            yield at
            at = self.raw.find(needle, at + 1)

    @cached_property
    def archives(self) -> dict[int, int]:
        """Start of each archive, as its end record tells it, and the archive's end."""
        found: dict[int, int] = {}
        for at in self.places(b"PK\x05\x06"):
            if at + 22 <= len(self.raw):
                size, directory, note = struct.unpack_from("<IIH", self.raw, at + 12)
                start = at - size - directory
                if start >= 0 and at + 22 + note <= len(self.raw) and self.raw[start + directory : start + directory + 4] in (b"PK\x01\x02", b"PK\x05\x06"):
                    found.setdefault(start, at + 22 + note)
        return found

    @cached_property
    def pdf_marks(self) -> tuple[list[int], list[int], list[int], list[int], list[int]]:
        """Places of headers, of all ends, of cross-reference marks; starts and ends of complete trailers."""
        trailers = [m.span() for m in PDF_END.finditer(self.raw)]
        return [*self.places(b"%PDF-")], [*self.places(b"%%EOF")], [*self.places(b"startxref")], [a for a, _ in trailers], [b for _, b in trailers]


def _wav(v: Value, start: int) -> int | None:
    b = v.view[start:]
    if len(b) < 12 or bytes(b[8:12]) != b"WAVE":
        return None
    end = 8 + struct.unpack_from("<I", b, 4)[0]
    if end > len(b):
        return None
    at, seen = 12, set()
    while at + 8 <= end:
        name, size = bytes(b[at : at + 4]), struct.unpack_from("<I", b, at + 4)[0]
        if at + 8 + size > end:
            return None
        seen.add(name)
        at += 8 + size + (size & 1)
    return end if {b"fmt ", b"data"} <= seen and at in (end, end + 1) else None


def _png(v: Value, start: int) -> int | None:
    b, n = v.raw, len(v.raw)
    if b[start + 8 : start + 16] != b"\0\0\0\x0dIHDR":
        return None

    def layout(at: int) -> tuple[bool, int]:
        if at + 12 > n or not b[at + 4 : at + 8].isalpha():
            return True, -1
        end = at + 12 + struct.unpack_from(">I", b, at)[0]
        return (b[at + 4 : at + 8] == b"IEND", end) if end <= n else (True, -1)

    def chunk(at: int) -> tuple[bool, int]:
        size = struct.unpack_from(">I", b, at)[0]
        if struct.unpack_from(">I", b, at + 8 + size)[0] != zlib.crc32(v.view[at + 4 : at + 8 + size]):
            return True, -1
        return b[at + 4 : at + 8] == b"IEND", at + 12 + size

    # sums are computed only where the chunks lead to an end
    end = v.chain("png layout", start + 8, layout)
    end = v.chain("png", start + 8, chunk) if end >= 0 else -1
    return end - start if end >= 0 else None


def _gif(v: Value, start: int) -> int | None:
    b, n = v.raw, len(v.raw)
    if start + 13 > n:
        return None
    colours = lambda flags: 3 << ((flags & 7) + 1) if flags & 0x80 else 0

    def block(at: int) -> tuple[bool, int]:
        if at >= n:
            return True, -1
        return (False, at + 1 + b[at]) if b[at] else (True, at + 1)

    def part(at: int) -> tuple[bool, int]:
        if at < n and b[at] == 0x3B:
            return True, at + 1
        if at < n and b[at] == 0x21:
            end = v.chain("gif blocks", at + 2, block)
        elif at + 10 < n and b[at] == 0x2C:
            end = v.chain("gif blocks", at + 11 + colours(b[at + 9]), block)
        else:
            return True, -1
        return end < 0, end

    end = v.chain("gif", start + 13 + colours(b[start + 10]), part)
    return end - start if end >= 0 else None


def _jpeg(v: Value, start: int) -> int | None:
    b, n = v.raw, len(v.raw)

    def part(at: int) -> tuple[bool, int]:
        if at + 4 > n or b[at] != 0xFF or b[at + 1] in (0xD8, 0xD9):
            return True, -1
        size = struct.unpack_from(">H", b, at + 2)[0]
        if size < 2:
            return True, -1
        if b[at + 1] != 0xDA:
            return False, at + 2 + size
        k = b.find(b"\xff", at + 2 + size)
        while 0 <= k < n - 1 and (not b[k + 1] or 0xD0 <= b[k + 1] <= 0xD7):
            k = b.find(b"\xff", k + 2)
        if not 0 <= k < n - 1:
            return True, -1
        return (True, k + 2) if b[k + 1] == 0xD9 else (False, k)

    end = v.chain("jpeg", start + 2, part)
    return end - start if end >= 0 else None


def _gzip(v: Value, start: int) -> int | None:
    b = v.view[start:]
    if len(b) < 18 or b[2] != 8 or b[3] & 0xE0:
        return None
    made, fed = zlib.decompressobj(31), 0
    try:
        while fed < len(b) and not made.eof:
            rest: bytes | memoryview = b[fed : fed + (1 << 16)]
            fed += len(rest)
            while len(rest) and not made.eof:
                made.decompress(rest, 1 << 20)
                rest = made.unconsumed_tail
        return fed - len(made.unused_data) if made.eof else None
    except zlib.error:
        return None


def _zip(v: Value, start: int) -> int | None:
    end = v.archives.get(start)
    return end - start if end is not None else None


def _pdf(v: Value, start: int) -> int | None:
    headers, ends, marks, trailers, trailer_ends = v.pdf_marks
    k = bisect_left(ends, start + 5)
    if not v.raw[start + 5 : start + 6].isdigit() or k == len(ends):
        return None
    end, mark = ends[k], bisect_left(marks, start)
    if mark == len(marks) or marks[mark] + 9 > end:
        return None
    # linearized and incrementally saved files have several ends; the last before another file's header counts
    after = bisect_left(headers, end)
    limit = headers[after] if after < len(headers) else len(v.raw)
    last = bisect_right(trailer_ends, limit) - 1
    return (trailer_ends[last] if last >= 0 and trailers[last] >= end + 5 else end + 5) - start


def _flac_frames(v: Value, start: int) -> int | None:
    """Where the first frame starts."""
    b, n = v.raw, len(v.raw)
    at = start + 4
    if at + 4 > n or b[at] & 0x7F or int.from_bytes(b[at + 1 : at + 4], "big") != 34:
        return None

    def part(at: int) -> tuple[bool, int]:
        if at + 4 > n:
            return True, -1
        after = at + 4 + int.from_bytes(b[at + 1 : at + 4], "big")
        if after > n:
            return True, -1
        if not b[at] & 0x80:
            return False, after
        return True, after if after + 2 <= n and b[after] == 0xFF and b[after + 1] & 0xFC == 0xF8 else -1

    end = v.chain("flac", at, part)
    return end if end >= 0 else None


def _flac(v: Value, start: int) -> int | None:
    """The rest of the value: frames do not tell their length."""
    return len(v.raw) - start if _flac_frames(v, start) else None


def _ogg(v: Value, start: int) -> int | None:
    b, n = v.raw, len(v.raw)

    def page(at: int) -> tuple[bool, int]:
        if at + 27 > n or b[at : at + 5] != b"OggS\0":
            return True, -1
        segments = b[at + 26]
        end = at + 27 + segments + sum(b[at + 27 : at + 27 + segments])
        if end > n:
            return True, -1
        return bool(b[at + 5] & 4), end

    end = v.chain("ogg", start, page)
    return end - start if end >= 0 else None


#: Magic bytes, type, and what gives a valid value's length.
FORMATS: list[tuple[bytes, str, Callable[[Value, int], int | None]]] = [
    (b"RIFF", "audio/wav", _wav),
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
    (b"PK\x03\x04", "application/zip", _zip),
    (b"%PDF-", "application/pdf", _pdf),
    (b"fLaC", "audio/flac", _flac),
    (b"OggS", "audio/ogg", _ogg),
]


def _magics() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for k, (magic, _, _) in enumerate(FORMATS):
        made.add_word(magic.decode("latin-1"), (k, len(magic)))
    made.make_automaton()
    return made


_automaton = _magics()


def parts(content: bytes) -> list[tuple[int, int, str]]:
    """(start, length, type) of valid media in ``content``; inside another one's bytes only if that one starts it."""
    out: list[tuple[int, int, str]] = []
    value, inside = Value(content), 0
    for end, (k, size) in _automaton.iter(content.decode("latin-1")):
        start = end + 1 - size
        if start < inside:
            continue
        length = FORMATS[k][2](value, start)
        if length:
            out.append((start, length, FORMATS[k][1]))
            # a container at the very start is the value itself: look into it; a FLAC's end is open, others may follow it
            taken = _flac_frames(value, start) + 2 - start if FORMATS[k][2] is _flac else length
            inside = start + taken if start else 0
    return out


_SNIFFED = "type string, valid boolean, length long, embedded array<struct<start: long, length: long, type: string>>"


def sniff(df: DataFrame, content: str = "content", declared: str = "declared_type") -> DataFrame:
    """``df`` with sniffed_type, valid, length, embedded (instead of columns of these names, if it has any).

    The type is the declared one where the start of a value tells nothing.
    """

    @F.pandas_udf(_SNIFFED)
    def look(values, types):  # noqa: ANN001, ANN202
        import pandas as pd

        rows = []
        for value, kind in zip(values, types):
            found = parts(bytes(value)) if value is not None else []
            head = next((p for p in found if p[0] == 0), None)
            inner = [{"start": s, "length": n, "type": t} for s, n, t in found if s]
            rows.append((head[2] if head else kind, head is not None, head[1] if head else (len(value) if value is not None else None), inner))
        return pd.DataFrame(rows, columns=["type", "valid", "length", "embedded"])

    names = {"type": "sniffed_type", "valid": "valid", "length": "length", "embedded": "embedded"}
    kind = F.col(declared).cast("string") if declared in df.columns else F.lit(None).cast("string")
    return df.withColumn("_s", look(F.col(content).cast("binary"), kind)).select(*(c for c in df.columns if c not in names.values()), *(F.col(f"_s.{k}").alias(v) for k, v in names.items()))


def to_wav(payload: bytes) -> bytes:
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload))
    return head + payload


def samples(media: bytes) -> bytes:
    """The samples of a stored text, found by sniffing and validating the bytes."""
    start, length, kind = next(p for p in parts(media) if p[0] == 0)
    if kind != "audio/wav" or length != len(media):
        raise ValueError("not a stored text")
    at = 12
    while media[at : at + 4] != b"data":
        size = struct.unpack_from("<I", media, at + 4)[0]
        at += 8 + size + (size & 1)
    return media[at + 8 : at + 8 + struct.unpack_from("<I", media, at + 4)[0]]


def feature(payload: bytes) -> str:
    """Mean, spread, turns through the middle and entropy in bits of 8-bit samples."""
    x = np.frombuffer(payload, dtype=np.uint8)
    count = np.bincount(x, minlength=256).astype(np.float64)
    level = np.arange(256)
    mean = float(count @ level) / len(x)
    spread = (max(0.0, float(count @ (level - mean) ** 2) / len(x))) ** 0.5
    turns = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    used = count[count > 0] / len(x)
    return f"wav/u8/{RATE};mean={mean:.4f};spread={spread:.4f};turns={turns};bits={float(-(used * np.log2(used)).sum()):.4f}"


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[tuple[int, bytes, bytes]]]]:
    """doc_ids of some rows, and each one's (bytes, stored form, samples read back); a few megabytes at a time."""
    for batch in batches:
        buf, off = string_buffers(batch.column("text"))
        raw, cut, lo, rows, held = memoryview(buf), off.tolist(), 0, [], 0
        for d, (a, b) in enumerate(zip(cut, cut[1:])):
            media = to_wav(bytes(raw[a:b]) + bytes(-(b - a) % UNIT or (UNIT if a == b else 0)))
            rows.append((b - a, media, samples(media)))
            held += len(media)
            if held > 8 << 20:
                yield batch.column("doc_id").slice(lo, len(rows)), rows
                lo, rows, held = d + 1, [], 0
        if rows:
            yield batch.column("doc_id").slice(lo, len(rows)), rows


def _plain(docs: DataFrame) -> DataFrame:
    short_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media, media_type, feature of every row of ``docs`` (doc_id, text; others are ignored)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in _stored(batches):
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([n for n, _, _ in rows], pa.int64()), pa.array([m for _, m, _ in rows], pa.binary()), pa.array([parts(m)[0][2] for _, m, _ in rows]), pa.array([feature(s) for _, _, s in rows])],
                names=["doc_id", "n_bytes", "media", "media_type", "feature"],
            )

    return _plain(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary, media_type string, feature string")


def digests(docs: DataFrame) -> DataFrame:
    """Sizes and digests of ``store_texts`` without moving the stored bytes to the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in _stored(batches):
            sha = lambda b: hashlib.sha256(b).hexdigest()
            columns = {
                "n_bytes": pa.array([n for n, _, _ in rows], pa.int64()),
                "payload_bytes": pa.array([len(s) for _, _, s in rows], pa.int64()),
                "payload_sha256": pa.array([sha(s) for _, _, s in rows]),
                "tail_crc32": pa.array([zlib.crc32(s[-UNIT:]) for _, _, s in rows], pa.int64()),
                "media_bytes": pa.array([len(m) for _, m, _ in rows], pa.int64()),
                "media_sha256": pa.array([sha(m) for _, m, _ in rows]),
                "feature": pa.array([feature(s) for _, _, s in rows]),
            }
            yield pa.RecordBatch.from_arrays([ids, *columns.values()], names=["doc_id", *columns])

    return _plain(docs).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
