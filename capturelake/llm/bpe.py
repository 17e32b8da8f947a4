"""Byte-level BPE as a finite automaton.

``Automaton`` compiles a merge list in rank order.  It has one state per token (the token read last) and an arc labelled
t where t may follow.  At first all bytes may follow each other.  Each merge u v -> w is one gadget:

* the state after w is a copy of the state after v as it is now,
* the state after u loses its arc v, and by that all arcs of tokens yet to be made that begin with this v,
* w may follow wherever u may follow.

Tokens are numbered in the order of a depth-first walk over "begins with" (later merges first), so the arcs that a
gadget takes away are one interval of numbers; a state is the list of intervals that may not follow.  The automaton
accepts exactly one labelling of every byte string, the BPE one.

A table over bytes drives the encoding: each byte of a word is read once and leads to the longest string that ends there and
begins a label; of the labels that end there, exactly one has an arc from the label before it, and it becomes the last label
of what was read so far.  Decoding writes the labels out.

The pre-tokenizer (words with a leading blank, numbers, symbols, white space, English contractions) is evaluated on whole
chunks of text by array operations; each distinct word of a chunk is encoded once and remembered within a bound.

Defined results: null and empty texts have no ids and decode to the empty text; a long text is encoded whole, in a chunk of
its own; rows that repeat a doc_id, or have none, are encoded each; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import short_batches
from .text import chunks, span_hash

#: Words of one generation of an encoder's memory; it holds two, and what the older one gives moves to the newer.
MEMORY = 300_000

#: Bytes of text that are encoded at a time: more than elsewhere, since each chunk looks its distinct words up.
CHUNK = 4 << 20

OTHER, LETTER, NUMBER, SPACE, BLANK = range(5)
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def byte_letters() -> dict[str, int]:
    """The printable characters that stand for bytes in a vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def character_classes() -> np.ndarray:
    kinds = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        first = unicodedata.category(chr(c))[0]
        if first == "L":
            kinds[c] = LETTER
        elif first == "N":
            kinds[c] = NUMBER
    kinds[_WHITE] = SPACE
    kinds[0x20] = BLANK
    return kinds


class Automaton:
    """States, arcs and labels of one vocabulary; ``special`` are strings that are one token wherever they stand."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in spec.get("added_tokens", [])}
        self.labels: dict[int, bytes] = {i: bytes(letters[c] for c in s) for s, i in vocab.items() if all(c in letters for c in s)}
        self.labels |= {i: s for s, i in self.special.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        self._number([vocab[c] for c in letters], made)
        self._build(made)
        self._tables()

    def _number(self, roots: list[int], made: list[tuple[int, int, int]]) -> None:
        """Depth-first numbers; ``self.after[w]`` is the end of the subtree of w, ``self.kids[u]`` its (rank, token)."""
        self.kids: dict[int, list[tuple[int, int]]] = {}
        for rank, (u, _, w) in enumerate(made):
            self.kids.setdefault(u, []).append((rank, w))
        size = max(self.labels) + 1
        self.pre, self.after, n = [-1] * size, [-1] * size, 0
        stack = [(r, False) for r in reversed(roots)]
        while stack:
            t, left = stack.pop()
            if left:
                self.after[t] = n
                continue
            self.pre[t], n = n, n + 1
            stack.append((t, True))
            stack.extend((w, False) for _, w in self.kids.get(t, ()))  # the last, of the latest merge, is walked first
        self.roots = roots

    def _build(self, made: list[tuple[int, int, int]]) -> None:
        rows: dict[int, list[tuple[int, int]]] = {r: [] for r in self.roots}
        self.live = set(self.roots)
        for rank, (u, v, w) in enumerate(made):
            p = self.pre[v]
            fires = u in self.live and v in self.live and not any(lo <= p < hi for lo, hi in rows[u])
            rows[w] = rows[v][:] if v in rows else []
            if fires:
                self.live.add(w)
                older = [c for r, c in self.kids.get(v, ()) if r < rank]
                rows[u].append((p, self.pre[older[-1]] if older else self.after[v]))
        self.lows: list[list[int]] = [[] for _ in range(max(self.labels) + 1)]
        self.highs: list[list[int]] = [[] for _ in range(max(self.labels) + 1)]
        for t, row in rows.items():
            lows, highs = self.lows[t], self.highs[t]
            for lo, hi in sorted(row):
                if highs and lo <= highs[-1]:
                    highs[-1] = max(highs[-1], hi)
                else:
                    lows.append(lo)
                    highs.append(hi)

    def _tables(self) -> None:
        """The byte table, and the labels that end at each of its states.

        A state is a string of bytes that some label begins with; reading a byte leads to the longest such string that ends
        there.  ``step`` has an entry for each state and byte that leads to another state than the byte alone does.
        """
        goto, text, self.whole = [{}], [b""], {self.labels[t]: t for t in self.live}
        for t in sorted(self.live, key=lambda t: self.labels[t]):
            node = 0
            for k, b in enumerate(self.labels[t]):
                if b not in goto[node]:
                    goto[node][b] = len(goto)
                    goto.append({})
                    text.append(self.labels[t][: k + 1])
                node = goto[node][b]
        self.root = [goto[0].get(b, 0) for b in range(256)]
        # by length: the shorter state that a state falls back to is complete before it
        fail, table = [0] * len(goto), [None] * len(goto)
        table[0] = goto[0]
        ends: list[tuple] = [()] * len(goto)
        queue = list(goto[0].values())
        for node in queue:
            below = fail[node]
            own = self.whole.get(text[node])
            ends[node] = ((own, len(text[node])), *ends[below]) if own is not None else ends[below]
            for b, to in goto[node].items():
                fail[to] = table[below].get(b, self.root[b] if below else 0) if node else 0
                queue.append(to)
            table[node] = table[below] | goto[node] if below else goto[node]
        self.step, self.ends = table, ends

    def follows(self, state: int, token: int) -> bool:
        p, lows = self.pre[token], self.lows[state]
        k = bisect_right(lows, p) - 1
        return k < 0 or p >= self.highs[state][k]

    def encode_word(self, word: bytes) -> list[int]:
        """Labels of the one accepting path of ``word``: each byte is read once, and gives the last label of what was read."""
        if (t := self.whole.get(word)) is not None:
            return [t]
        if (t := self.special.get(word)) is not None:
            return [t]
        step, ends, root, pre, all_lows, all_highs = self.step, self.ends, self.root, self.pre, self.lows, self.highs
        last, state = [(-1, 0)], 0
        for place, b in enumerate(word, 1):
            state = step[state].get(b)
            if state is None:
                state = root[b]
            for label in ends[state]:
                token, size = label
                before = last[place - size][0]
                if before < 0:
                    if place == size:
                        break
                    continue
                p, lows = pre[token], all_lows[before]
                k = bisect_right(lows, p) - 1
                if k < 0 or p >= all_highs[before][k]:
                    break
            last.append(label)
        out, place = [], len(word)
        while place:
            token, size = last[place]
            out.append(token)
            place -= size
        return out[::-1]


class Encoder:
    """Token ids of whole text columns; ``encode`` turns distinct words into id lists."""

    def __init__(self, special: dict[bytes, int], encode: Callable[[list[bytes]], list[list[int]]]) -> None:
        self.special, self.encode = special, encode
        self.kinds = character_classes()
        self._forget()
        self.older: tuple[dict[int, int], np.ndarray, np.ndarray, np.ndarray] = ({}, self.start, self.size, self.ids)

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.start = np.zeros(1 << 16, dtype=np.int64)
        self.size = np.zeros(1 << 16, dtype=np.int32)
        self.ids = np.zeros(1 << 18, dtype=np.uint32)
        self.used = 0

    def _split(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) in bytes of the pre-tokenizer's words."""
        char = np.flatnonzero((buf & 0xC0) != 0x80)
        code = buf[char].astype(np.int32)
        wide = np.flatnonzero(code >= 0xC0)
        if len(wide):
            p = char[wide]
            tail = [buf[np.minimum(p + k, len(buf) - 1)].astype(np.int32) & 0x3F for k in (1, 2, 3)]
            lead = code[wide]
            code[wide] = np.select(
                [lead < 0xE0, lead < 0xF0],
                [(lead & 0x1F) << 6 | tail[0], (lead & 0x0F) << 12 | tail[0] << 6 | tail[1]],
                (lead & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2],
            )
        kind = self.kinds[np.minimum(code, 0x10FFFF)]
        white = kind >= SPACE
        group = np.minimum(kind, SPACE)

        cuts, inner = [offsets[:-1][np.diff(offsets) > 0]], []
        if self.special:
            raw = buf.tobytes()
            for text in self.special:
                at = raw.find(text)
                while at >= 0:
                    d = int(np.searchsorted(offsets, at, side="right"))
                    if at + len(text) <= offsets[d]:
                        cuts.append(np.array([at, at + len(text)]))
                        inner.append((at, at + len(text)))
                        at = raw.find(text, at + len(text))
                    else:
                        at = raw.find(text, at + 1)
        edge = np.concatenate(cuts)
        edge = np.searchsorted(char, edge[edge < len(buf)])

        fresh = np.zeros(len(char), dtype=bool)
        fresh[edge] = True
        begin = fresh.copy()
        begin[1:] |= (group[1:] != group[:-1]) & (kind[:-1] != BLANK)
        begin[:-1] |= white[:-1] & ~white[1:] & ~fresh[1:]
        quote = np.flatnonzero(code == 0x27)
        for q in quote[begin[quote]].tolist():
            if q + 1 < len(char) and not fresh[q + 1]:
                x, y = int(code[q + 1]), int(code[q + 2]) if q + 2 < len(char) and not fresh[q + 2] else 0
                width = 2 if x in (115, 116, 109, 100) else 3 if (x, y) in ((114, 101), (118, 101), (108, 108)) else 0
                if width:
                    begin[q + 1 : q + width] = False
                    if q + width < len(char):
                        begin[q + width] = True
        start = char[begin]
        for lo, hi in inner:
            start = start[(start <= lo) | (start >= hi)]
        return start, np.append(start[1:], len(buf)) if len(start) else start

    def _remember(self, h: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        """Adds words, their numbers of ids, and these ids one after the other."""
        n = len(self.known)
        if n + len(h) > len(self.start):
            self.start, self.size = (np.concatenate([a, np.zeros(max(len(h), len(a)), a.dtype)]) for a in (self.start, self.size))
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(flat), len(self.ids)), np.uint32)])
        self.start[n : n + len(h)], self.size[n : n + len(h)] = self.used + np.cumsum(size) - size, size
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.known.update(zip(h.tolist(), range(n, n + len(h))))

    def __call__(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of all documents, one after the other."""
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        start, end = self._split(buf, offsets)
        h, first, back = np.unique(span_hash(buf, start, end), return_index=True, return_inverse=True)
        if len(self.known) > MEMORY:
            self.older = self.known, self.start, self.size, self.ids
            self._forget()
        keys = h.tolist()
        slots = np.fromiter(map(self.known.get, keys, repeat(-1)), dtype=np.int64, count=len(keys))
        missing = np.flatnonzero(slots < 0)
        if len(missing):
            names, (known, old_start, old_size, old_ids) = h[missing].tolist(), self.older
            old = np.fromiter(map(known.get, names, repeat(-1)), dtype=np.int64, count=len(names))
            had = old >= 0
            self._remember(h[missing[had]], old_size[old[had]].astype(np.int64), old_ids[ragged(old_start[old[had]], old_size[old[had]].astype(np.int64))])
            fresh = missing[~had]
            if len(fresh):
                raw, at = buf.tobytes(), first[fresh]
                lists = self.encode([raw[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())])
                size = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
                self._remember(h[fresh], size, np.fromiter(chain.from_iterable(lists), dtype=np.uint32, count=int(size.sum())))
            slots[missing] = np.fromiter(map(self.known.__getitem__, names), dtype=np.int64, count=len(names))
        slot = slots[back]
        size = self.size[slot].astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[ragged(self.start[slot], size)]
        return ids, upto[np.searchsorted(start, offsets)]


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., size[0] of them, then those of start[1] and so on."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


_made: dict[tuple[str, str], tuple[Automaton, Encoder]] = {}


def automaton(path: str) -> tuple[Automaton, Encoder]:
    """The compiled automaton of a vocabulary file and its encoder, once a Python worker."""
    if (path, "automaton") not in _made:
        made = Automaton(path)
        _made[path, "automaton"] = made, Encoder(made.special, lambda words: [made.encode_word(w) for w in words])
    return _made[path, "automaton"]


class Decoder:
    def __init__(self, labels: dict[int, bytes]) -> None:
        size = max(labels) + 1
        parts = [labels.get(i, b"") for i in range(size)]
        self.size = np.array([len(p) for p in parts], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(parts), dtype=np.uint8)

    def __call__(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The labels of ``ids`` one after the other, and where each id's label starts."""
        size = self.size[ids]
        return self.bytes[ragged(self.start[ids], size)], np.concatenate([[0], np.cumsum(size)])


_OUT = "doc_id long, ids array<int>, decoded string"
_DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _round_trips(column: pa.Array, path: str) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, ids, id offsets, decoded bytes, byte offsets) of slices of a text column."""
    made, encode = automaton(path)
    if (path, "decoder") not in _made:
        _made[path, "decoder"] = Decoder(made.labels)
    for lo, _, buf, off in chunks(column, CHUNK):
        ids, at = encode(buf, off)
        text, places = _made[path, "decoder"](ids)
        yield lo, ids, at, text, places[at]


def _plain(docs: DataFrame) -> DataFrame:
    short_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, decoded of every row of ``docs`` (doc_id, text; others are ignored); null text has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, ids, at, text, places in _round_trips(batch.column("text"), path):
                listed = pa.ListArray.from_arrays(at.astype(np.int32), ids.astype(np.int32))
                decoded = pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(places.astype(np.int64)), pa.py_buffer(text)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(at) - 1), listed, decoded], names=["doc_id", "ids", "decoded"])

    return _plain(docs).mapInArrow(run, _OUT)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the digest of ``encode_decode`` without moving ids to the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, ids, at, text, places in _round_trips(batch.column("text"), path):
                raw, cut, put = memoryview(ids.astype("<u4").tobytes()), (4 * at).tolist(), places.tolist()
                out = memoryview(text.tobytes())
                id_hash = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cut, cut[1:])]
                text_hash = [hashlib.sha256(out[a:b]).hexdigest() for a, b in zip(put, put[1:])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(at) - 1), pa.array(np.diff(at)), pa.array(id_hash), pa.array(text_hash)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _plain(docs).mapInArrow(run, _DIGEST)
