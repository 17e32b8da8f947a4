"""Vector bin packing of token pieces into training sequences.

A piece is a vector: its tokens, one segment, its loss-bearing tokens.  A sequence has a limit in each of the three.
Sequences are filled one at a time; the next piece is the one that fits and has the largest dot product of its vector
with the room left, both in shares of the limits (Panigrahy et al., 2011).  When no whole piece fits and there is room
for tokens, the piece whose head fills most of it within the limits is cut there.

Documents of a partition are packed as they stream by, a chunk of text at a time; a sequence that is not full when its
chunk ends goes on with the next chunk, so a partition pads one sequence at most (and those closed by the segment or
loss limits), and memory is bounded by a chunk.  Sequence ids are the partition's number and a counter.

Defined results: null text is empty and has the final id only; rows that repeat a doc_id are packed once each; a null
doc_id is packed like any other; a long text is encoded whole and cut into pieces; of equal pieces the earlier row's comes
first; other columns than those named are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import CHUNK, Encoder, byte_letters, ragged
from .scratch import short_batches
from .text import chunks

_made: dict[str, Encoder] = {}


def library_encoder(path: str) -> Encoder:
    """Encoder whose distinct words are encoded by the tokenizers library, once a Python worker."""
    if path not in _made:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(path)
        special = {t.content.encode(): i for i, t in lib.get_added_tokens_decoder().items()}
        letters, merge = {b: c for c, b in byte_letters().items()}, lib.model.tokenize
        # words are pre-split: the library's merges alone are applied, to the letters that stand for their bytes
        _made[path] = Encoder(special, lambda words: [[special[w]] if w in special else [t.id for t in merge(w.decode("latin-1").translate(letters))] for w in words])
    return _made[path]


class Packer:
    """Fills sequences with pieces (key, start, tokens, loss); ``placed`` are those that have got a place.

    ``loss`` counts the loss-bearing tokens at the end of a piece; a cut keeps them where they are.
    """

    def __init__(self, tokens: int, segments: int, loss: int) -> None:
        self.limit = np.array([tokens, segments, loss], dtype=np.float64)
        self.sequence = 0
        self.room = self.limit.copy()
        self.placed: list[tuple[object, int, int, int, int]] = []

    def _put(self, key: object, start: int, tokens: int, loss: int) -> None:
        self.placed.append((key, start, tokens, self.sequence, int(self.limit[0] - self.room[0])))
        self.room -= (tokens, 1, loss)
        if self.room[0] < 1 or self.room[1] < 1:
            self.close()

    def close(self) -> None:
        if self.room[0] < self.limit[0]:
            self.sequence += 1
            self.room = self.limit.copy()

    def add(self, pieces: list[tuple[object, int, int, int]]) -> None:
        """Places all pieces; what fits into no sequence is cut first."""
        keys: list[object] = []
        rows: list[tuple[int, int, int]] = []
        whole = int(min(self.limit[0], self.limit[2]))
        for key, start, tokens, loss in pieces:
            while tokens > whole:
                keys.append(key)
                rows.append((start, whole, max(0, loss - (tokens - whole))))
                start, tokens = start + whole, tokens - whole
                loss = min(loss, tokens)
            if tokens:
                keys.append(key)
                rows.append((start, tokens, loss))
        table = np.array(rows, dtype=np.float64).reshape(-1, 3)
        starts, need = table[:, 0], np.column_stack([table[:, 1], np.ones(len(table)), table[:, 2]])
        share, live = need / self.limit, np.arange(len(table))
        while len(live):
            fits = live[(need[live] <= self.room).all(axis=1)]
            if len(fits):
                k = int(fits[np.argmax(share[fits] @ (self.room / self.limit))])
                live = live[live != k]
                self._put(keys[k], int(starts[k]), int(need[k, 0]), int(need[k, 2]))
                continue
            # no piece fits as it is: the head that fills most is cut off, of equals that of the largest piece
            free = need[live, 0] - need[live, 2]
            heads = np.minimum(self.room[0], free + self.room[2])
            best = int(np.lexsort((need[live, 0], heads))[-1])
            k, head = int(live[best]), int(heads[best])
            if head < 1:
                self.close()
                continue
            lost = max(0, head - int(free[best]))
            self._put(keys[k], int(starts[k]), head, lost)
            starts[k] += head
            need[k] -= (head, 0, lost)
            share[k] = need[k] / self.limit


_OUT = "doc_id long, start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long"
_DIGEST = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, path: str, tokens: int = 2048, segments: int = 1024, loss: int | None = None, end_id: int = 1, digest: bool = False, context: int = 0) -> DataFrame:
    """Pieces of the token ids of ``docs`` (doc_id, text and, if it is there, loss_from) with their places.

    loss_from, a whole number, is the first loss-bearing token of a row; where there is none, it is ``context``.  With
    ``digest`` a piece carries the CRC-32 of its ids instead of the ids.
    """
    short_batches(docs.sparkSession)
    limits = (tokens, segments, loss or tokens)
    given = F.col("loss_from").try_cast("long") if "loss_from" in docs.columns else F.lit(None).cast("long")
    start_of_loss = F.greatest(F.coalesce(given, F.lit(context).cast("long")), F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = library_encoder(path), Packer(*limits)
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            names, after = batch.column("doc_id"), batch.column("loss_from").to_numpy()
            for lo, hi, buf, off in chunks(batch.column("text"), CHUNK):
                ids, at = encode(buf, off)
                # every document's ids, each with the final id behind it
                size = np.diff(at) + 1
                first = np.cumsum(size) - size
                full = np.full(int(size.sum()), end_id, dtype="<u4")
                inner = np.ones(len(full), dtype=bool)
                inner[first + size - 1] = False
                full[inner] = ids
                packer.add([(d, 0, int(n), int(max(0, n - max(0, skip)))) for d, (n, skip) in enumerate(zip(size.tolist(), after[lo:hi].tolist()))])
                placed, packer.placed = packer.placed, []
                doc, start, length, seq, offset = (np.array(c, dtype=np.int64) for c in zip(*placed))
                raw, a = memoryview(full.tobytes()), (first[doc] + start) * 4
                if digest:
                    ids_out = pa.array([zlib.crc32(raw[x:y]) for x, y in zip(a.tolist(), (a + 4 * length).tolist())], pa.int64())
                else:
                    cut = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
                    ids_out = pa.ListArray.from_arrays(cut, full[ragged(first[doc] + start, length)].astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(lo + doc)), pa.array(start), pa.array(length), ids_out, pa.array(size[doc]), pa.array(base + seq), pa.array(offset)],
                    names=["doc_id", "start", "length", "ids_crc32" if digest else "ids", "doc_tokens", "sequence_id", "offset"],
                )

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), start_of_loss.alias("loss_from"))
    return plain.mapInArrow(run, _DIGEST if digest else _OUT)
