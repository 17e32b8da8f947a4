import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from capturelake.llm.packing import Packer, pack_documents
from capturelake.llm.queries import TRAINING, vocabulary

PATH = vocabulary("byte_bpe_50k.json")


@given(st.lists(st.tuples(st.integers(1, 300), st.integers(0, 300)), max_size=60), st.integers(8, 100), st.integers(1, 6), st.integers(4, 100))
@settings(max_examples=60, deadline=None)
def test_limits_hold_and_nothing_is_lost(items, tokens, segments, loss):
    pieces = [(k, 0, n, min(n, bear)) for k, (n, bear) in enumerate(items)]
    p = Packer(tokens, segments, loss)
    half = len(pieces) // 2
    p.add(pieces[:half])
    p.add(pieces[half:])
    by_key, by_sequence = defaultdict(list), defaultdict(list)
    for key, start, length, sequence, offset in p.placed:
        by_key[key].append((start, length))
        by_sequence[sequence].append((offset, length, key, start))
    for key, _, n, _ in pieces:
        at = 0
        for start, length in sorted(by_key[key]):
            assert start == at and length > 0
            at += length
        assert at == n
    for held in by_sequence.values():
        at = 0
        for offset, length, _, _ in sorted(held):
            assert offset == at
            at += length
        bearing = sum(max(0, s + n - max(s, items[k][0] - min(items[k]))) for _, n, k, s in held)
        assert at <= tokens and len(held) <= segments and bearing <= loss


@pytest.mark.parametrize("digest", [True, False])
def test_pieces_are_the_documents_ids(documents, corpus, digest):
    library = Tokenizer.from_file(PATH)
    rows, by_doc, by_seq = pack_documents(documents, PATH, tokens=64, digest=digest).collect(), defaultdict(list), defaultdict(int)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id] += r.length
    assert set(by_doc) == {i for i, _ in corpus} and max(by_seq.values()) <= 64
    for i, text in corpus[1:]:
        ids, at = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            own = ids[at : at + r.length]
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(own.tobytes()) if digest else r.ids == own.tolist()
            at += r.length
        assert at == len(ids)
    assert sum(n < 64 for n in by_seq.values()) <= documents.rdd.getNumPartitions()


def test_prompt_tokens_bear_no_loss(spark):
    rows = [(k, "so it goes on and on " * 4, 10) for k in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, loss_from long").coalesce(1)
    got = pack_documents(df, PATH, tokens=64, loss=20).collect()
    bearing = defaultdict(int)
    for r in got:
        bearing[r.sequence_id] += max(0, r.start + r.length - max(r.start, 10))
    assert max(bearing.values()) <= 20


def test_all_limits_bind_and_little_is_padded(spark):
    """Long and short documents under the limits of the query: each limit is met by some sequence."""
    rng = np.random.default_rng(2)
    sizes = [int(x) for x in rng.choice([3, 8, 15, 40, 300, 900, 3000, 9000], 1500, p=[0.2, 0.2, 0.1, 0.1, 0.2, 0.15, 0.04, 0.01])]
    p = Packer(TRAINING["tokens"], TRAINING["segments"], TRAINING["loss"])
    for k in range(0, len(sizes), 500):
        p.add([(j, 0, n, max(0, n - TRAINING["context"])) for j, n in enumerate(sizes[k : k + 500], k)])
    held = defaultdict(list)
    for key, start, length, sequence, _ in p.placed:
        held[sequence].append((length, length - max(0, min(start + length, TRAINING["context"]) - min(start, TRAINING["context"]))))
    full = [(sum(n for n, _ in h), len(h), sum(b for _, b in h)) for h in held.values()]
    assert max(f[0] for f in full) == 2048 and max(f[1] for f in full) == 16 and max(f[2] for f in full) == 2032
    assert 1 - sum(f[0] for f in full) / (2048 * len(full)) < 0.02


def test_no_documents(no_documents):
    assert pack_documents(no_documents, PATH).count() == 0
