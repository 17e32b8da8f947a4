"""Near-duplicate documents: b-bit MinHash for candidates, full shingle sets for the decision.

1. Each document's distinct word shingles become ``ROWS * BANDS`` minima (``signatures``); the low ``PLANES`` bits of
   each minimum are packed bit-sliced into longs, and each band of minima gives one bucket key.
2. Documents with equal shingle sets form a class, represented by its smallest doc_id.  Only representatives go on, so
   thousands of copies cost one row.
3. Representatives that share a bucket are candidates.  Similarity is estimated by bit counts of the packed signatures,
   corrected for chance agreement of ``PLANES`` bits; hopeless pairs go.  The rest is confirmed on the full sets.
4. First each bucket's members are compared with its smallest member only.  Components of those links make most other
   pairs needless; a second pass compares members of different components only, in cells of ``BLOCK`` rows a side.

With 4 rows and 32 bands a pair at similarity 0.8 shares no bucket with probability 5e-8.  Sets are sets of 64-bit
shingle hashes.

Defined results: null text counts as empty; a text without words has no shingles and links with nothing; a null doc_id
takes no part (component_id null, kept true); rows that repeat a doc_id are judged by their own text each, also where
their texts differ; long texts are read whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .scratch import BLOOM, Scratch
from .text import LOWER, chunks, find_words, mix, ngram_hash, span_hash

ROWS, BANDS, PLANES = 4, 32, 4
K = ROWS * BANDS
BLOCK = 512

_rng = np.random.default_rng(20240229)
_MUL = (_rng.integers(0, 1 << 31, size=(K, 1), dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, size=(K, 1), dtype=np.uint32)


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for _, _, buf, off in chunks(column):
        words = find_words(LOWER[buf], off)
        h = span_hash(words.buf, words.start, words.end)
        grams = ngram_hash(h, size)
        first = words.first.tolist()
        for a, b in zip(first, first[1:]):
            if b - a >= size:
                yield np.unique(grams[a : b - size + 1])
            else:
                yield ngram_hash(h[a:b], b - a) if b > a else grams[:0]


def minima(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(K, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(x), 2048):
        t = _MUL * x[i : i + 2048]
        t += _ADD
        np.minimum(low, t.min(axis=1), out=low)
    return low


def pack(low: np.ndarray) -> np.ndarray:
    """The low PLANES bits of each minimum, one plane of K bits after the other, as longs."""
    planes = ((low[None, :] >> np.arange(PLANES, dtype=np.uint32)[:, None]) & 1).astype(np.uint8)
    return np.packbits(planes, axis=1).reshape(-1).view(np.int64)


def band_keys(low: np.ndarray) -> np.ndarray:
    rows = low.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) ^ rows[:, r])
    return h.view(np.int64)


def checksums(sets: list[np.ndarray]) -> np.ndarray:
    """Two longs for each set; equal sets have equal ones."""
    salt = np.uint64(0xA5A5A5A55A5A5A5A)
    sums = [(mix(s).sum(dtype=np.uint64), mix(s ^ salt).sum(dtype=np.uint64)) for s in sets]
    return np.array(sums, dtype=np.uint64).reshape(-1, 2).view(np.int64)


_SIGNATURES = "doc_id long, text_hash long, n_shingles long, s1 long, s2 long, planes array<long>, bands array<long>"


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """One row per document: set size, two checksums of the set, packed signature, bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            planes, bands, found = [], [], list(shingle_sets(batch.column("text"), size))
            n = [len(s) for s in found]
            for s in found:
                if len(s):
                    low = minima(s)
                    planes.append(pack(low))
                    bands.append(band_keys(low))
            some, sums = np.array(n, dtype=np.int64) > 0, checksums(found)

            def lists(parts: list[np.ndarray], width: int) -> pa.Array:
                off = np.concatenate([[0], np.cumsum(some * width)]).astype(np.int32)
                return pa.ListArray.from_arrays(off, np.concatenate(parts) if parts else np.zeros(0, np.int64))

            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(sums[:, 0].copy()), pa.array(sums[:, 1].copy()), lists(planes, PLANES * K // 64), lists(bands, BANDS)],
                names=["doc_id", "text_hash", "n_shingles", "s1", "s2", "planes", "bands"],
            )

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(run, _SIGNATURES)


def agreeing(a: Column, b: Column) -> Column:
    """Number of minima whose kept bits agree."""
    half = K // 64
    total = F.lit(K)
    for h in range(half):
        differ = None
        for p in range(PLANES):
            x = F.get(a, F.lit(p * half + h)).bitwiseXOR(F.get(b, F.lit(p * half + h)))
            differ = x if differ is None else differ.bitwiseOR(x)
        total = total - F.bit_count(differ)
    return total


def similarity(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity: the share of agreeing minima, less what PLANES bits agree by chance."""
    chance = 2.0**-PLANES
    return (agreeing(a, b) / F.lit(float(K)) - chance) / (1 - chance)


def margin(threshold: float, sigmas: float = 6.0) -> float:
    """Estimate below which a pair at ``threshold`` falls with probability under 1e-8."""
    c = 2.0**-PLANES
    p = c + (1 - c) * threshold
    return threshold - sigmas * math.sqrt(p * (1 - p) / K) / (1 - c)


def _promising(threshold_pct: int) -> Column:
    """Sizes allow the similarity, and the estimate is not hopeless."""
    sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * threshold_pct
    return sizes & (similarity(F.col("p_a"), F.col("p_b")) >= margin(threshold_pct / 100))


def _side(reps: DataFrame, side: str) -> DataFrame:
    return reps.select(F.col("node").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("planes").alias(f"p_{side}"))


def confirm(scratch: Scratch, docs: DataFrame, reps: DataFrame, pairs: DataFrame, size: int, threshold_pct: int, name: str) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) of nodes whose full sets have 100 * intersection >= threshold_pct * union."""
    pairs = scratch.save(pairs, f"{name}-pairs")
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = scratch.save(reps.join(nodes, "node", "left_semi").select("doc_id", "s1", "s2", "node"), f"{name}-wanted")
    need = scratch.save_ids(wanted.select("doc_id"), f"{name}-need")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shingle_sets(batch.column("text"), size))
            sums = checksums(found)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sums[:, 0].copy()), pa.array(sums[:, 1].copy()), pa.array([s.tobytes() for s in found], pa.binary())], names=["doc_id", "s1", "s2", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(need, "doc_id", "left_semi")
    own = texts.mapInArrow(sets, "doc_id long, s1 long, s2 long, shingles binary").join(wanted, ["doc_id", "s1", "s2"])
    # rows that repeat a document give its set once; by the columns of the join, so that sets are not moved again
    full = scratch.save(own.dropDuplicates(["node", "doc_id", "s1", "s2"]).select("node", "shingles"), f"{name}-sets", **BLOOM)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = []
            for x, y in zip(batch.column("s_a"), batch.column("s_b")):
                p, q = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                both = int((q[np.minimum(at, len(q) - 1)] == p).sum()) if len(q) else 0
                hit.append(both > 0 and 100 * both >= threshold_pct * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(hit, pa.bool_()))

    joined = pairs.join(full.select(F.col("node").alias("a"), F.col("shingles").alias("s_a")), "a").join(full.select(F.col("node").alias("b"), F.col("shingles").alias("s_b")), "b")
    links = scratch.save(joined.select("a", "b", "s_a", "s_b").mapInArrow(compare, "a long, b long"), f"{name}-links")
    scratch.drop(f"{name}-sets", f"{name}-pairs", f"{name}-need", f"{name}-wanted")
    return links


def mixed_cells(scratch: Scratch, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sides (cell columns, node, component) of what members of different components of a bucket must be compared in.

    ``known`` has (key, node, component).  In a bucket with several components, each one of more than BLOCK members is cut
    into blocks; the members of all smaller ones share the blocks of a pool.  A cell is a block of the pool with one of the
    pool, one of a large component with one of the pool, or blocks of two large components.  So members of a large
    component never meet each other: what is compared grows with those outside it.
    """
    sizes = known.groupBy("key", "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("parts")).where("parts > 1").select("key")
    sizes = scratch.save(sizes.join(mixed, "key").withColumn("large", F.col("n") > BLOCK), "part-sizes")
    group = F.when(F.col("large"), F.col("component")).otherwise(F.lit(0))
    blocks = sizes.groupBy("key", "large", group.alias("part")).agg(F.ceil(F.sum("n") / BLOCK).cast("long").alias("blocks"))
    blocks = scratch.save(blocks, "part-blocks")
    placed = known.join(sizes.select("key", "component", "large"), ["key", "component"]).withColumn("part", group)
    placed = placed.join(blocks, ["key", "large", "part"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))

    each = blocks.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    pool, large = each.where("NOT large"), each.where("large")
    several = blocks.where("large").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    one = lambda d: d.select("key", F.col("large").alias("large_1"), F.col("part").alias("part_1"), F.col("block").alias("block_1"))
    two = lambda d: d.select("key", F.col("large").alias("large_2"), F.col("part").alias("part_2"), F.col("block").alias("block_2"))
    big = large.join(several, "key", "left_semi")
    cells = one(pool).join(two(pool), "key").where("block_1 <= block_2").unionByName(one(large).join(two(pool), "key")).unionByName(one(big).join(two(big), "key").where("part_1 < part_2"))
    cells = scratch.save(cells.select("key", *CELL), "cells")

    def side(k: int) -> DataFrame:
        own = placed.select("key", F.col("large").alias(f"large_{k}"), F.col("part").alias(f"part_{k}"), F.col("block").alias(f"block_{k}"), "node", "component")
        return own.join(cells, ["key", f"large_{k}", f"part_{k}", f"block_{k}"]).select("key", *CELL, "node", "component")

    return side(1), side(2)


CELL = [f"{c}_{k}" for k in (1, 2) for c in ("large", "part", "block")]


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold_pct: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text; other columns are ignored)."""
    return judged(docs, shingle, threshold_pct).select("doc_id", "n_shingles", "component_id", "kept")


def judged(docs: DataFrame, shingle: int = 5, threshold_pct: int = 80) -> DataFrame:
    """``near_duplicates`` with text_hash, xxhash64 of a row's text, which tells texts of one doc_id apart, and part, the
    number of the row's component, which tells components of such texts apart (null without shingles or doc_id)."""
    scratch = Scratch(docs.sparkSession, "minhash")
    sig = scratch.save(signatures(docs, shingle), "signatures")
    usable = sig.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # a node is a class of equal sets, whatever ids its rows have; its first id stands for it
    classes = usable.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    classes = scratch.save(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    of_rep = classes.select("s1", "s2", "n_shingles", F.col("rep").alias("doc_id"), "node")
    reps = usable.join(of_rep, ["s1", "s2", "n_shingles", "doc_id"]).dropDuplicates(["node"])
    reps = scratch.save(reps.select("node", "doc_id", "s1", "s2", "n_shingles", "planes", "bands"), "reps")
    rows = reps.select(F.explode("bands").alias("key"), "node")
    buckets = rows.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("members")).where("members > 1").select("key", "leader")
    members = scratch.save(rows.join(buckets, "key"), "members")

    stars = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    stars = stars.join(_side(reps, "a"), "a").join(_side(reps, "b"), "b").where(_promising(threshold_pct)).select("a", "b")
    links = confirm(scratch, docs, reps, stars, shingle, threshold_pct, "star")
    parts = scratch.save(connected_components(scratch, links, "star-cc"), "star-components")

    # a member without links is a component of its own
    known = members.select("key", "node").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    one, two = mixed_cells(scratch, known)
    one = one.withColumnsRenamed({"node": "a", "component": "c_a"}).join(_side(reps, "a"), "a")
    two = two.withColumnsRenamed({"node": "b", "component": "c_b"}).join(_side(reps, "b"), "b")
    same = (F.col("large_1") == F.col("large_2")) & (F.col("part_1") == F.col("part_2")) & (F.col("block_1") == F.col("block_2"))
    across = (F.col("c_a") != F.col("c_b")) & (~same | (F.col("a") < F.col("b")))
    rest = one.join(two, ["key", *CELL]).where(across & _promising(threshold_pct)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    more = confirm(scratch, docs, reps, rest, shingle, threshold_pct, "rest")
    final = scratch.save(connected_components(scratch, links.union(more), "all-cc"), "components")
    scratch.drop("members", "star-components", "part-sizes", "part-blocks", "cells")

    # the smallest id of a component
    first = final.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    of_node = final.join(first, "component")
    of_class = classes.join(of_node, "node", "left").select("s1", "s2", "n_shingles", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("component", "node").alias("part"))
    out = sig.select("doc_id", "text_hash", "n_shingles", "s1", "s2").join(of_class, ["s1", "s2", "n_shingles"], "left")
    named = F.col("doc_id").isNotNull()
    component = F.when(named, F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_hash", F.when(named, F.col("part")).alias("part"))
