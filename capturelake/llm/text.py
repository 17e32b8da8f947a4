"""Vectorised word machinery shared by the corpus operators.

Everything works on one Arrow string column at a time: its UTF-8 data buffer is the concatenation of all texts of the
batch, so words of thousands of documents are found with a handful of numpy passes instead of a Python loop.  Buffers
are handled in chunks of about ``CHUNK`` bytes (one longer document makes a chunk of its own), which bounds memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 2 << 20

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)

#: Words are runs of bytes other than blank and 0x09-0x0D.
SPACE_WORD = np.ones(256, dtype=bool)
SPACE_WORD[[0x20, *range(0x09, 0x0E)]] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Words:
    """Words of some documents: byte spans in ``buf``, and ``first[d]:first[d + 1]`` the words of document d."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.first) - 1

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.first))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, off


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of slices of about ``size`` bytes; a slice has a row at least."""
    buf, off = string_buffers(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, side="right")) - 1)
        yield lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def find_words(buf: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = SPACE_WORD) -> Words:
    """Maximal runs of word bytes that do not cross a document's border."""
    w = is_word[buf]
    starts, ends = w.copy(), w.copy()
    starts[1:] &= ~w[:-1]
    ends[:-1] &= ~w[1:]
    edge = offsets[(offsets > 0) & (offsets < len(buf))]
    starts[edge] = w[edge]
    ends[edge - 1] = w[edge - 1]
    start = np.flatnonzero(starts)
    return Words(buf, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets), offsets)


def find_runs(buf: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> Words:
    """Maximal runs of bytes of one class other than 0 that do not cross a document's border."""
    kind = classes[buf]
    turn = np.ones(len(buf) + 1, dtype=bool)
    turn[1:-1] = kind[1:] != kind[:-1]
    turn[offsets] = True
    place = np.flatnonzero(turn[:-1])
    end = np.append(place[1:], len(buf))
    full = kind[place] > 0
    start = place[full]
    return Words(buf, start, end[full], np.searchsorted(start, offsets), offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h *= _M2
    h ^= h >> np.uint64(29)
    h *= _M3
    h ^= h >> np.uint64(32)
    return h


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes a step."""
    padded = np.zeros(len(buf) + 8, dtype=np.uint8)
    padded[: len(buf)] = buf
    octets = np.ndarray(shape=(len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    left = end - start
    h = left.astype(np.uint64) * _M1
    h ^= octets[start] & _MASK[np.minimum(left, 8)]
    h = mix(h)
    live, at = np.flatnonzero(left > 8), 8
    while len(live):
        rest = left[live] - at
        g = h[live] * _M1 ^ (octets[start[live] + at] & _MASK[np.minimum(rest, 8)])
        h[live] = mix(g)
        live, at = live[rest > 8], at + 8
    return h


def ngram_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on; places whose n words leave ``h`` have none."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, n, dtype=np.uint64)
    for k in range(n):
        out *= _M1
        out += h[k : k + m]
        out ^= out >> np.uint64(31)
    return mix(out)
