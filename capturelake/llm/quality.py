"""Quality classifier: random-indexing word vectors, pooled per document, scored by a small calibrated network.

1. ``word_vectors``: every word has a fixed sparse ternary index vector; a word's vector is the sum of the index vectors of
   the words up to ``REACH`` places away, over all documents.  Words are hashed to ``ROWS`` rows, so what a task holds and
   what the driver gathers has one size whatever the corpus.
2. ``Pooler``: a document is the means of its words' vectors, of their squares, and of the products of each word's vector with
   the next one's (which words follow each other), all by component, and a constant.  These poolings were chosen on rows that
   may train, fitted on one half of them and judged on the other (README).
3. ``Network``: two layers of numpy weights, trained on at most ``TRAIN_ROWS`` labelled documents (those with the smallest
   hash of doc_id), with a temperature fitted on a fifth of them that the weights have not seen.  Under five labelled rows
   there is no such fifth, and the temperature is fitted on the same rows.

Words are runs of letters and digits (and all non-ASCII bytes) or runs of other visible characters, A-Z lower-cased.
Only the text enters a score.

Defined results: null and empty texts are scored as the empty text; rows that repeat a doc_id are scored each; without
labelled documents, or with one label only, every score is the label's share (0.5 without any); of several labels of a doc_id
the largest counts, of several texts of one that trains any; a long text is read whole; other columns never enter a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .scratch import Scratch, give_back_memory, quoted
from .text import LOWER, chunks, find_runs, span_hash

ROWS, WIDTH, REACH, NONZERO = 1 << 14, 32, 2, 2
TRAIN_ROWS = 20_000
#: Words whose neighbours are multiplied at a time.
SLICE = 1 << 16

#: Byte classes: white space 0, letters, digits and non-ASCII 1, other visible characters 2.
CLASSES = np.full(256, 2, dtype=np.uint8)
CLASSES[[*range(0x21)]] = 0
CLASSES[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1

_rng = np.random.default_rng(7)
_DIM = np.argsort(_rng.random((ROWS, WIDTH)), axis=1)[:, :NONZERO].astype(np.int64)
_SIGN = _rng.choice([-1.0, 1.0], size=(ROWS, NONZERO))


def hashed_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, vector rows of all words, first word of each document) of slices of a text column."""
    for lo, _, buf, off in chunks(column):
        words = find_runs(LOWER[buf], off, CLASSES)
        yield lo, (span_hash(words.buf, words.start, words.end) >> np.uint64(20)).astype(np.int64) & (ROWS - 1), words.first


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The ROWS x WIDTH sums over all of ``docs`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ROWS * WIDTH)
        for batch in batches:
            for _, row, first in hashed_words(batch.column("text")):
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
                for gap in range(1, REACH + 1):
                    same = doc[gap:] == doc[:-gap]
                    left, right = row[:-gap][same], row[gap:][same]
                    for word, near in ((left, right), (right, left)):
                        for k in range(NONZERO):
                            total += np.bincount(word * WIDTH + _DIM[near, k], _SIGN[near, k], minlength=ROWS * WIDTH)
        table = total.reshape(ROWS, WIDTH)
        used = np.flatnonzero(np.abs(table).sum(axis=1))
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(np.ascontiguousarray(table[used, d])) for d in range(WIDTH))], names=["row", *names])

    names = [f"v{d}" for d in range(WIDTH)]
    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "row long, " + ", ".join(f"{n} double" for n in names))
    found = parts.groupBy("row").agg(*(F.sum(n).alias(n) for n in names)).toPandas()
    out = np.zeros((ROWS, WIDTH))
    out[found["row"].to_numpy(dtype=np.int64)] = found[names].to_numpy()
    return out


@dataclass
class Pooler:
    """Means over documents: of word vectors, of their squares, and of the products of neighbours, all by component."""

    vectors: np.ndarray

    @classmethod
    def of(cls, sums: np.ndarray) -> Pooler:
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        unit = np.divide(sums, size, out=np.zeros_like(sums), where=size > 0)
        seen = size[:, 0] > 0
        unit[seen] -= unit[seen].mean(axis=0) if seen.any() else 0
        return cls(np.hstack([unit, unit**2]).astype(np.float32))

    def __call__(self, row: np.ndarray, first: np.ndarray) -> np.ndarray:
        n, width = np.diff(first), self.vectors.shape[1]
        plain = self.vectors[:, : width // 2]
        out = np.zeros((len(n), width + width // 2 + 1), dtype=np.float32)
        for d in np.flatnonzero(n).tolist():
            # a document's words, counted: long documents repeat their words
            words = row[first[d] : first[d + 1]]
            own, times = np.unique(words, return_counts=True)
            out[d, :width] = times.astype(np.float32) @ self.vectors[own] / len(words)
            for k in range(0, len(words) - 1, SLICE):
                near = plain[words[k : k + SLICE + 1]]
                out[d, width:-1] += np.einsum("ab,ab->b", near[1:], near[:-1]) / (len(words) - 1)
        out[:, -1] = n > 0
        return out


@dataclass
class Network:
    """tanh layer and logistic output; ``temperature`` divides the logit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    @classmethod
    def constant(cls, width: int, share: float) -> Network:
        p = min(max(share, 1e-6), 1 - 1e-6)
        return cls(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), float(np.log(p / (1 - p))), 1.0)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, batch: int = 256, rate: float = 3e-3, decay: float = 1e-4, seed: int = 11) -> Network:
        if not len(y) or y.min() == y.max():
            return cls.constant(x.shape[1], float(y.mean()) if len(y) else 0.5)
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(y))
        aside, train = order[: len(y) // 5], order[len(y) // 5 :]
        if not len(aside):
            aside = train
        mean, scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-6
        z = (x - mean) / scale
        p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for epoch in range(epochs):
            step = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            shuffled = rng.permutation(train)
            for k in range(0, len(shuffled), batch):
                at = shuffled[k : k + batch]
                h = np.tanh(z[at] @ p[0] + p[1])
                err = (1 / (1 + np.exp(-(h @ p[2] + p[3][0]))) - y[at]) / len(at)
                back = np.outer(err, p[2]) * (1 - h**2)
                grads = [z[at].T @ back + decay * p[0], back.sum(axis=0), h.T @ err + decay * p[2], np.array([err.sum()])]
                t += 1
                for a, g, mm, vv in zip(p, grads, m, v):
                    mm += 0.1 * (g - mm)
                    vv += 0.001 * (g * g - vv)
                    a -= step * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.999**t)) + 1e-8)
        made = cls(mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
        logit, target = made.logit(x[aside]), y[aside]
        made.temperature = float(min(np.exp(np.linspace(-1.5, 1.5, 121)), key=lambda c: np.logaddexp(0, np.where(target > 0.5, -logit, logit) / c).mean()))
        return made

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x.astype(np.float64)) / self.temperature, -500, 500)))


@dataclass
class QualityModel:
    pooler: Pooler
    network: Network

    def score(self, docs: DataFrame, *keep: str, into: str = "score") -> DataFrame:
        """The columns ``keep`` and the score, in column ``into``, of every row of ``docs`` (text)."""
        pooler, network = self.pooler, self.network

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                parts = [network(pooler(row, first)) for _, row, first in hashed_words(batch.columns[-1])]
                score = pa.array(np.concatenate(parts) if parts else np.zeros(0))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], score], names=[*batch.schema.names[:-1], "score"])

        # plain names on the way through Python
        plain = docs.select(*(F.col(quoted(k)).alias(f"x{j}") for j, k in enumerate(keep)), F.col("text").cast("string").alias("text"))
        made = plain.mapInArrow(run, StructType([*plain.schema.fields[:-1], StructField("score", DoubleType())]))
        return made.select(*(F.col(f"x{j}").alias(k) for j, k in enumerate(keep)), F.col("score").alias(into))


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; such rows never train."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS) -> QualityModel:
    """Vectors from all of ``docs`` (doc_id, text), weights from ``labels`` (doc_id, ``label``) outside the held-out third."""
    Scratch(docs.sparkSession, "quality")
    pooler = Pooler.of(word_vectors(docs))
    marked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marked = marked.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("double")).alias("y"))
    # at most train_rows pairs of 16 bytes are broadcast
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [pooler(row, first) for _, row, first in hashed_words(batch.column("text"))]
            raw = [r.tobytes() for part in parts for r in part]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(raw, pa.binary()), batch.column("y")], names=["doc_id", "x", "y"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    rows = chosen.mapInArrow(run, "doc_id long, x binary, y double").dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    x = np.frombuffer(b"".join(rows["x"]), dtype=np.float32).reshape(len(rows), -1) if len(rows) else np.zeros((0, 3 * WIDTH + 1), np.float32)
    model = QualityModel(pooler, Network.fit(x.astype(np.float64), rows["y"].to_numpy(dtype=np.float64)))
    del rows, x
    give_back_memory()
    return model
