"""Repeated passages: relative Lempel-Ziv parsing of documents against all earlier ones.

The reference of a document is every document with a smaller doc_id.  It is indexed by phrase (``WINDOW`` consecutive
words), in blocks that are the partitions of a shuffle by phrase hash; each phrase points to a place: the first document that
has it and its first word there.  Phrases that follow each other both in a document and in its reference are one run.  A
document is parsed greedily from left to right: at a word that a run covers, the longest run gives the factor, a verbatim
piece of one earlier document; other words are literals.  A factor that ends is checked at its border: where a phrase that
straddles it is indexed, the next factor begins right there with what that phrase's run has left.  So the factors, which become
the duplicate spans, cover exactly the words of all phrases that also start in an earlier document.

Indexing every phrase of every document would move many times the input.  Two steps keep that small without losing any:

* Documents with equal texts are one class; only its first is parsed, the others are one factor (``copies``).
* Each phrase has an anchor, the smallest hash among its ``ANCHOR``-word sequences.  Equal phrases have equal anchors, so
  only phrases with an anchor that two documents share can repeat; a document has about one anchor for five words.

Phrases are compared by 96 bits, two hashes of their words' hashes; anchors, which only choose what is indexed, by 64.  Minima
over documents are aggregated before any join, so a passage that a third of all documents share is one row on the side it is
joined with, and adaptive execution splits the other side.

Defined results: null text has no words; texts under ``WINDOW`` words stay whole; rows that repeat a doc_id are judged each by
their own text, against those of smaller ids; a null doc_id has no earlier documents and is none; a long text is read whole;
other columns are ignored, or carried by ``without_repeats``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .scratch import Scratch, quoted
from .text import Words, chunks, find_words, mix, ngram_hash, span_hash

WINDOW = 13
ANCHOR = 5
_SALT = np.uint64(0x5851F42D4C957F2D)


def sliding_min(g: np.ndarray, width: int) -> np.ndarray:
    """Minima of all runs of ``width`` values; none if there are fewer values."""
    if len(g) < width:
        return g[:0]
    done, low = 1, g
    while done < width:
        step = min(done, width - done)
        low = np.minimum(low[: len(low) - step], low[step:])
        done += step
    return low


def phrases(column: pa.Array, window: int) -> Iterator[tuple[int, Words, np.ndarray]]:
    """(first row, words, hashes of the words) of slices of a text column."""
    for lo, _, buf, off in chunks(column):
        words = find_words(buf, off)
        yield lo, words, span_hash(buf, words.start, words.end)


def anchors_of(h: np.ndarray, window: int) -> np.ndarray:
    """The anchor of the phrase that starts at each word."""
    k = min(ANCHOR, window)
    return sliding_min(ngram_hash(h, k), window - k + 1)


def phrase_hashes(h: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes, of 64 and of 32 bits, of the phrase that starts at each word."""
    return ngram_hash(h, window), (ngram_hash(mix(h ^ _SALT), window) >> np.uint64(32)).astype(np.uint32)


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def anchors(docs: DataFrame, window: int) -> DataFrame:
    """(h, doc_id): the distinct anchors of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for lo, words, h in phrases(batch.column("text"), window):
                low = anchors_of(h, window)
                first, hs, counts = words.first.tolist(), [], []
                for a, b in zip(first, first[1:]):
                    own = np.unique(low[a : max(a, b - window + 1)])
                    hs.append(own)
                    counts.append(len(own))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs).view(np.int64)), pa.array(np.repeat(ids[lo : lo + len(words)], counts).astype(np.int64))], names=["h", "doc_id"])

    return _plain(docs).where("doc_id IS NOT NULL").mapInArrow(run, "h long, doc_id long")


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """(w, v, doc_id, place): phrases of docs (doc_id, text, shared) whose anchor is among ``shared``, each at its first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, shared = batch.column("doc_id").to_pylist(), batch.column("shared")
            for lo, words, h in phrases(batch.column("text"), window):
                low, (grams, others) = anchors_of(h, window), phrase_hashes(h, window)
                first, out, counts = words.first.tolist(), [], []
                for d, (a, b) in enumerate(zip(first, first[1:])):
                    e = max(a, b - window + 1)
                    known = np.sort(shared[lo + d].values.to_numpy(zero_copy_only=False).view(np.uint64))
                    place = np.flatnonzero(contained(low[a:e], known))
                    place = np.sort(place[np.unique(grams[a + place], return_index=True)[1]])
                    out.append((grams[a + place], others[a + place], place))
                    counts.append(len(place))
                w, v, place = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(v.view(np.int32)), pa.array(np.repeat(np.array(ids[lo : lo + len(words)], np.int64), counts)), pa.array(place.astype(np.int32))], names=["w", "v", "doc_id", "place"])

    return docs.mapInArrow(run, "w long, v int, doc_id long, place int")


def contained(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values occur in the sorted array ``known``."""
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def parse(hits: np.ndarray, refs: np.ndarray, places: np.ndarray, n_words: int, window: int) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """Covered words and factors (first word, words, reference, first word there) of one document.

    ``hits`` are the words, ascending, that start an indexed phrase; ``refs`` and ``places`` where each was indexed from.
    """
    edge = np.zeros(n_words + 1, dtype=np.int32)
    np.add.at(edge, hits, 1)
    np.add.at(edge, hits + window, -1)
    covered, factors = np.cumsum(edge[:-1]) > 0, []
    if not len(hits):
        return covered, factors
    fresh = np.r_[True, (np.diff(hits) != 1) | (np.diff(refs) != 0) | (np.diff(places) != 1)]
    at = np.flatnonzero(fresh)
    start, end = hits[at], hits[np.r_[at[1:] - 1, len(hits) - 1]] + window
    word = int(start[0])
    while True:
        # of the runs that have begun, the last reaches furthest
        k = int(np.searchsorted(start, word, side="right")) - 1
        if end[k] > word:
            factors.append((word, int(end[k]) - word, int(refs[at[k]]), int(places[at[k]]) + word - int(start[k])))
            word = int(end[k])
        elif k + 1 < len(start):
            word = int(start[k + 1])
        else:
            break
    return covered, factors


def kept_text(words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the kept words of each document, joined by one blank."""
    idx = np.flatnonzero(keep)
    doc = words.doc_of()[idx]
    inner = np.ones(len(idx), dtype=bool)
    inner[:-1] = doc[:-1] == doc[1:]
    if len(idx):
        inner[-1] = False
    start, end = words.start[idx], words.end[idx]
    buf = np.append(words.buf, np.uint8(0x20))
    buf[end[inner]] = 0x20
    edge = np.zeros(len(buf) + 1, dtype=np.int8)
    edge[start] += 1
    edge[end + inner] -= 1
    size = np.bincount(doc, weights=end - start + inner, minlength=len(words)).astype(np.int64)
    return buf[np.cumsum(edge[:-1], dtype=np.int8) > 0], np.concatenate([[0], np.cumsum(size)])


def string_array(buf: np.ndarray, offsets: np.ndarray) -> pa.Array:
    made = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(buf)))
    return made.cast(pa.string())


_OUT = "doc_id long, n_words long, n_removed long, text string, spans array<struct<start: long, words: long, ref: long, place: long>>"


def _remove(docs: DataFrame, window: int, carried: list[StructField] | None = None) -> DataFrame:
    """Parses docs (doc_id, text, copy_of, found) and takes their duplicate spans out.

    With ``carried`` columns the result is n_removed, text and these; a text without such spans stays as it is then.
    """
    span = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("ref", pa.int64()), ("place", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copy_of, found = batch.column("copy_of").to_pylist(), batch.column("found")
            for lo, words, h in phrases(batch.column("text"), window):
                grams, others = phrase_hashes(h, window)
                keep, first, n_removed, all_spans = np.ones(len(words.start), dtype=bool), words.first.tolist(), [], []
                for d, (a, b) in enumerate(zip(first, first[1:])):
                    covered, spans = None, []
                    if b - a >= window and copy_of[lo + d] is not None:
                        covered, spans = np.ones(b - a, dtype=bool), [(0, b - a, copy_of[lo + d], 0)]
                    elif b - a >= window and found[lo + d].is_valid:
                        rows = found[lo + d].values
                        known, check, refs, places = (rows.field(k).to_numpy(zero_copy_only=False) for k in range(4))
                        order = np.argsort(known.view(np.uint64))
                        known, check, refs, places = known.view(np.uint64)[order], check.view(np.uint32)[order], refs[order], places[order]
                        own = grams[a : b - window + 1]
                        hits = np.flatnonzero(contained(own, known))
                        row = np.searchsorted(known, own[hits])
                        same = check[row] == others[a + hits]
                        hits, row = hits[same], row[same]
                        covered, spans = parse(hits, refs[row], places[row], b - a, window)
                    if covered is not None:
                        keep[a:b] = ~covered
                    n_removed.append(0 if covered is None else int(covered.sum()))
                    all_spans.append([{"start": s, "words": n, "ref": r, "place": p} for s, n, r, p in spans])
                ids = batch.column("doc_id").slice(lo, len(words))
                if carried is not None:
                    made = pc.if_else(pc.greater(pa.array(n_removed, pa.int64()), 0), string_array(*kept_text(words, keep)), batch.column("text").slice(lo, len(words)).cast(pa.string()))
                    yield pa.RecordBatch.from_arrays([pa.array(n_removed, pa.int64()), made, *(batch.column(f.name).slice(lo, len(words)) for f in carried)], names=["n_removed", "text", *(f.name for f in carried)])
                    continue
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(words.first)), pa.array(n_removed, pa.int64()), string_array(*kept_text(words, keep)), pa.array(all_spans, span)], names=["doc_id", "n_words", "n_removed", "text", "spans"])

    if carried is not None:
        return docs.mapInArrow(run, StructType([StructField("n_removed", LongType()), StructField("text", StringType()), *carried]))
    return docs.mapInArrow(run, _OUT)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, text (kept words), spans of every row of ``docs`` (doc_id, text; others are ignored)."""
    known = _known(docs, window)
    return _remove(_plain(docs).join(known, "doc_id", "left").select("doc_id", "text", "copy_of", "found"), window)


def without_repeats(docs: DataFrame, count: str, window: int = WINDOW) -> DataFrame:
    """``docs`` (doc_id, text and whatever else) with the kept words as text, where any word goes, and their number as ``count``."""
    names = [f"x{k}" for k in range(len(docs.columns))]
    rows = docs.select(*(F.col(quoted(c)).alias(x) for c, x in zip(docs.columns, names)))
    of = dict(zip(docs.columns, names))
    rows = rows.select(F.col(of["doc_id"]).cast("long").alias("doc_id"), F.col(of["text"]).cast("string").alias("text"), *names)
    carried = [f for f in rows.schema.fields if f.name in names and f.name != of["text"]]
    joined = rows.join(_known(docs, window), "doc_id", "left").select("doc_id", "text", "copy_of", "found", *(f.name for f in carried))
    made = _remove(joined, window, carried)
    return made.select(*(F.col("text" if c == "text" else of[c]).alias(c) for c in docs.columns), F.col("n_removed").alias(count))


def _known(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, copy_of, found) of documents that share words with an earlier one."""
    scratch, plain = Scratch(docs.sparkSession, "substring"), _plain(docs)
    named = plain.where("doc_id IS NOT NULL")

    # an id that names several texts is no copy as a whole; its texts are parsed
    texts = named.groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("lo"), F.max(F.xxhash64("text")).alias("hi"))
    several = texts.where("lo < hi").select("doc_id")
    digests = named.where("text <> ''").select("doc_id", F.sha2("text", 256).alias("digest"))
    firsts = digests.groupBy("digest").agg(F.min("doc_id").alias("copy_of"), F.max("doc_id").alias("last")).where("copy_of < last").drop("last")
    copies = digests.join(firsts, "digest").where("doc_id > copy_of").select("doc_id", "copy_of").distinct()
    copies = scratch.save(copies.join(several, "doc_id", "left_anti"), "copies")

    occur = anchors(docs, window)
    shared = scratch.save(occur.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h"), "shared")
    candidates = scratch.save(occur.join(shared, "h").groupBy("doc_id").agg(F.collect_list("h").alias("shared")).join(copies, "doc_id", "left_anti"), "candidates")
    scratch.drop("shared")

    windows = scratch.save(_windows(named.join(candidates, "doc_id"), window), "windows")
    scratch.drop("candidates")
    index = windows.groupBy("w", "v").agg(F.min("doc_id").alias("ref"), F.max("doc_id").alias("hi"), F.min_by("place", "doc_id").alias("at")).where("ref < hi").drop("hi")
    again = windows.join(index, ["w", "v"]).where("doc_id > ref")
    found = scratch.save(again.groupBy("doc_id").agg(F.collect_list(F.struct("w", "v", "ref", "at")).alias("found")), "found")
    scratch.drop("windows")

    return found.select("doc_id", F.lit(None).cast("long").alias("copy_of"), "found").unionByName(copies.select("doc_id", "copy_of", F.lit(None).cast(found.schema["found"].dataType).alias("found")))
