import hashlib
import os
import random

import numpy as np
import pyarrow as pa
import pytest

from capturelake.llm.bpe import automaton, digests, encode_decode
from capturelake.llm.packing import library_encoder
from capturelake.llm.queries import vocabulary
from capturelake.llm.text import chunks

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PATH = vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def awkward():
    rng = random.Random(5)
    bits = ["the", " ", "  ", "\n", "\t", "'s", "'", "'re", "'ll", "ll", "ab", "é", "ß", "日本", "한국", "123", "½", "!", "?!", "<|endoftext|>", "<|end", " ", "　", "\x1c", "\x85", "😀", "a", "tion", " of", "&&&", "\r\n", "aaaaaaa", "́", "'S", "'d", "'t", "\x00"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    texts += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(0xA0, 0x2FF), rng.randint(0x370, 0xD7FF), rng.randint(0xE000, 0x1FFFF)])) for _ in range(20)) for _ in range(500)]
    texts += ["".join(rng.choice("aeioutnsrhld") for _ in range(rng.randint(1, 60))) for _ in range(800)]
    return [*texts, "", "'", " ", "\n", "a" * 3000, "ab" * 2000, "the" * 500]


@pytest.mark.parametrize("kind", ["automaton", "library"])
def test_equals_the_library(library, kind):
    encode = automaton(PATH)[1] if kind == "automaton" else library_encoder(PATH)
    texts, got = awkward(), []
    for _, _, buf, off in chunks(pa.array(texts), 3000):
        ids, at = encode(buf, off)
        got += [ids[a:b].tolist() for a, b in zip(at, at[1:])]
    for text, ids in zip(texts, got):
        assert ids == library.encode(text, add_special_tokens=False).ids, text


def test_one_path_for_every_string():
    made, _ = automaton(PATH)
    rng = random.Random(2)
    for _ in range(300):
        word = bytes(rng.choice(b"thean io") for _ in range(rng.randint(1, 12)))
        ids = made.encode_word(word)
        assert b"".join(made.labels[i] for i in ids) == word
        assert all(made.follows(a, b) for a, b in zip(ids, ids[1:]))


def test_round_trip_and_digests(documents, corpus, library):
    back = {r.doc_id: r for r in encode_decode(documents, PATH).collect()}
    short = {r.doc_id: r for r in digests(documents, PATH).collect()}
    assert len(short) == len(corpus)
    for i, text in corpus:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert back[i].ids == ids and back[i].decoded == (text or "")
        assert short[i].n_tokens == len(ids)
        assert short[i].ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert short[i].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_no_documents(no_documents):
    assert digests(no_documents, PATH).count() == 0
