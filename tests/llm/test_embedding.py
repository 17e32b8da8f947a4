import math

import numpy as np
import pytest

from capturelake.llm import embedding


def brute(rows, cosine):
    good = {}
    for n, (i, v) in enumerate(rows):
        if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v):
            x = np.array(v, dtype=np.float64)
            x = x / np.abs(x).max()
            good[n] = x / np.linalg.norm(x)
    root, links = {n: n for n in good}, dict.fromkeys(good, 0)

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    keys = sorted(good)
    for k, a in enumerate(keys):
        for b in keys[k + 1 :]:
            if len(good[a]) == len(good[b]) and good[a] @ good[b] >= cosine:
                links[a] += 1
                links[b] += 1
                x, y = top(a), top(b)
                root[x] = y
    parts = {}
    for n in keys:
        parts.setdefault(top(n), []).append(rows[n][0])
    return sorted((rows[n][0], links.get(n, 0), min(parts[top(n)]) if n in good else rows[n][0]) for n in range(len(rows)) if rows[n][0] is not None)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    out = []
    for k in range(260):
        v = centres[k % 12] + rng.normal(scale=0.02 + 0.25 * (k % 3 == 0), size=16)
        out.append(np.float32(v * rng.uniform(0.1, 30)).tolist())
    out += [out[0]] * 20 + [[2 * c for c in out[1]]] + [[-c for c in out[2]]]
    out += [None, [], [0.0] * 16, [1.0] * 15 + [None], [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0, 2.0], [1.0, 2.0], [1e-38] * 16, [3e38] * 16]
    ids = rng.permutation(len(out) * 3)[: len(out)].tolist()
    return list(zip(ids, out))


@pytest.mark.parametrize("cell,block", [(4096, 4096), (20, 7), (60, 1000)])
def test_equals_all_pairs(spark, rows, monkeypatch, cell, block):
    monkeypatch.setattr(embedding, "CELL", cell)
    monkeypatch.setattr(embedding, "BLOCK", block)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows] + [(None, [1.0] * 16, 2, "y")], "vec_id long, embedding array<float>, label int, kept string")
    got = embedding.near_vectors(df).collect()
    assert len(got) == len(rows) + 1
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id is not None) == brute(rows, 0.95)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id is None] == [(0, None, True)]


def test_no_vectors(spark):
    assert embedding.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
