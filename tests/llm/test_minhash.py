import re

import numpy as np
import pytest

from capturelake.llm import minhash
from capturelake.llm.graph import connected_components
from capturelake.llm.scratch import Scratch

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}


def components(rows, size, pct):
    sets, root = {i: shingles(t, size) for i, t in rows}, {i: i for i, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= pct * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), top(i)) for i in ids}


@pytest.mark.parametrize("size,pct", [(4, 80), (5, 80), (3, 60)])
def test_equals_brute_force(spark, documents, corpus, size, pct):
    want = components(corpus, size, pct)
    got = minhash.near_duplicates(documents, size, pct).collect()
    assert len(got) == len(corpus) + 1
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_no_documents_and_null_ids(spark, no_documents):
    assert minhash.near_duplicates(no_documents).columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert minhash.near_duplicates(no_documents).count() == 0
    r = minhash.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f")], "doc_id long, text string")).collect()
    assert {(x.doc_id, x.component_id, x.kept) for x in r} == {(None, None, True), (7, 7, True)}


def test_members_of_a_bucket_beyond_a_block(spark, monkeypatch):
    """Chains whose links are not with the bucket's first member, in several blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(40):
        own = list(base)
        own[:k] = [f"x{j}" for j in range(k)]
        rows.append((k, " ".join(own)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()}
    assert got == {i: c for i, (_, c) in components(rows, 4, 80).items()}


def test_one_id_for_several_texts(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(5, a), (5, b), (5, a), (9, b), (7, a + " x"), (1, "c d e f g")]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1, True), (5, 5, True), (5, 5, True), (5, 5, True), (7, 5, False), (9, 5, False)]


def test_members_of_a_component_do_not_meet(spark):
    """50,000 near copies and ten outsiders of one bucket: only pairs with an outsider are compared."""
    rows = spark.range(50_000).selectExpr("5L AS key", "id AS node", "0L AS component").unionByName(spark.range(50_000, 50_010).selectExpr("5L AS key", "id AS node", "id AS component"))
    rows = rows.unionByName(spark.range(2000).selectExpr("6L AS key", "id AS node", "7L AS component"))
    one, two = minhash.mixed_cells(Scratch(spark, "t"), rows)
    assert one.count() <= 50_000 + 10 and two.count() <= 110 * 10
    pairs = one.alias("a").join(two.alias("b"), ["key", *minhash.CELL])
    assert pairs.count() <= 50_010 * 10


def test_recall_near_the_threshold(spark):
    """Pairs at similarities from 0.80 to 0.82 share a bucket and pass the estimate."""
    rng, missed = np.random.default_rng(8), 0
    for n in (10, 50, 100, 400, 1000):
        for _ in range(300):
            both = int(np.ceil(2 * n * rng.uniform(0.8, 0.82) / (1 + 0.8)))
            while both / (2 * n - both) < 0.8:
                both += 1
            a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            b = np.concatenate([a[:both], rng.integers(0, 1 << 63, n - both, dtype=np.uint64)])
            x, y = minhash.minima(a), minhash.minima(b)
            agree = np.mean((x & (2**minhash.PLANES - 1)) == (y & (2**minhash.PLANES - 1)))
            chance = 2.0**-minhash.PLANES
            missed += not (minhash.band_keys(x) == minhash.band_keys(y)).any() or (agree - chance) / (1 - chance) < minhash.margin(0.8)
    assert not missed


def test_estimate_is_corrected_for_chance(spark):
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8, 0.95):
        n = 4000
        both = int(n * share)
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate([a[:both], rng.integers(0, 1 << 63, n - both, dtype=np.uint64)])
        want = both / (2 * n - both)
        df = spark.createDataFrame([(minhash.pack(minhash.minima(a)).tolist(), minhash.pack(minhash.minima(b)).tolist())], "a array<long>, b array<long>")
        assert abs(df.select(minhash.similarity(df.a, df.b)).first()[0] - want) < 0.16
    assert 0.5 < minhash.margin(0.8) < 0.75


def test_components_of_long_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(0, 200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5, 5), (2002, 2001)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in connected_components(Scratch(spark, "test"), df, "x").collect()}
    assert got == {**{k: 0 for k in range(201)}, **{1000 + k: 1000 for k in range(300)}, 2001: 2001, 2002: 2001}
