import hashlib
import re

import numpy as np
import pytest

from capturelake.llm.substring import parse, phrase_hashes, remove_repeats, sliding_min


def brute(rows, window):
    words, first = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}, {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


@pytest.mark.parametrize("window", [13, 6, 3])
def test_equals_brute_force(documents, corpus, window):
    got = remove_repeats(documents, window).collect()
    assert len(got) == len(corpus) + 1
    assert {r.doc_id: (r.n_words, r.n_removed, r.text) for r in got} == brute(corpus, window)
    text = dict(corpus)
    for r in got:
        assert sum(s.words for s in r.spans) == r.n_removed
        for s in r.spans:
            own, there = (re.findall(r"[^\x20\x09-\x0D]+", text[i]) for i in (r.doc_id, s.ref))
            # a verbatim piece of the earlier document
            assert s.ref < r.doc_id and own[s.start : s.start + s.words] == there[s.place : s.place + s.words]


def test_digest_of_query_form(spark):
    rows = [(1, " ".join("abcdefghijklmnop")), (2, "x " + " ".join("abcdefghijklmnop") + " y"), (3, None)]
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[2].text, got[2].n_removed, [tuple(s) for s in got[2].spans]) == ("x y", 16, [(1, 16, 1, 0)])
    assert hashlib.sha256(got[3].text.encode()).hexdigest() == hashlib.sha256(b"").hexdigest()


def test_factors_end_where_no_phrase_straddles(spark):
    a, b = ([f"{x}{k}" for k in range(13)] for x in "ab")
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(a + b)), (4, " ".join(["x", *b, *a, "y"])), (5, " ".join(a + b[:5]))]
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(s) for s in got[3].spans] == [(0, 13, 1, 0), (13, 13, 2, 0)] and (got[3].text, got[3].n_removed) == ("", 26)
    assert [tuple(s) for s in got[4].spans] == [(1, 13, 2, 0), (14, 13, 1, 0)] and got[4].text == "x y"
    # phrases that straddle the border stand in document 3: the next factor begins at the border with what is left of them
    assert [tuple(s) for s in got[5].spans] == [(0, 13, 1, 0), (13, 5, 3, 13)]


def test_greedy_factors():
    hits, refs, places = np.arange(2, 12), np.array([1] * 4 + [2] * 3 + [1] * 3), np.array([5, 6, 7, 8, 0, 1, 2, 20, 21, 22])
    covered, factors = parse(hits, refs, places, 20, 4)
    assert np.flatnonzero(covered).tolist() == list(range(2, 15))
    # words 2-8 from document 1; at word 9 the last run has begun and reaches furthest
    assert factors == [(2, 7, 1, 5), (9, 6, 1, 20)]
    assert parse(hits[:0], refs[:0], places[:0], 3, 4)[1] == []


def test_two_hashes_of_a_phrase():
    w, v = phrase_hashes(np.arange(40, dtype=np.uint64), 13)
    assert len(set(w.tolist()) & set(v.tolist())) == 0 and len(set(v.tolist())) == 28


@pytest.mark.parametrize("n", range(16))
def test_minima_of_few_words(n):
    g = np.arange(n, dtype=np.uint64)[::-1]
    assert sliding_min(g, 9).tolist() == [min(g[k : k + 9].tolist()) for k in range(n - 8)]


def test_nothing_to_do(spark, no_documents):
    assert remove_repeats(no_documents).count() == 0
    nulls = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert sorted((r.n_words, r.n_removed) for r in remove_repeats(nulls).collect()) == [(0, 0), (2, 0)]
