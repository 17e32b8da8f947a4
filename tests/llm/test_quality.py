import random
import zlib

import numpy as np
import pytest

from capturelake.llm import quality


@pytest.fixture(scope="module")
def world(spark):
    """Documents whose label shows in their words' company, with awkward rows among them."""
    rng = random.Random(9)
    good, bad = [f"w{k}" for k in range(60)], [f"w{k}" for k in range(40, 100)]
    rows, labels = [], []
    for k in range(600):
        y = rng.random() < 0.7
        rows.append((k, " ".join(rng.choice(good if y else bad) for _ in range(rng.randint(20, 60))), "en", 9.0))
        if k % 2:
            labels.append((k, int(y), 0))
    rows += [(1000, None, None, None), (1001, "", "de", None), (1002, "w1 " * 30_000, None, 0.0), (1003, "?", None, None), (1003, "?", None, None)]
    labels += [(1000, 1, 0), (1003, None, 0), (None, 0, 0), (1, labels[0][1], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: y for i, y, _ in labels if i is not None and i < 600}


def test_held_out_documents_are_told_apart(world):
    docs, labels, truth = world
    got = quality.fit(docs, labels).score(docs, "doc_id", "lang").collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 50
    assert np.mean([(r.score >= 0.5) == bool(truth[r.doc_id]) for r in held]) > 0.95
    twins = [r.score for r in got if r.doc_id == 1003]
    assert twins[0] == twins[1]
    assert len({r.score for r in got if r.doc_id in (1000, 1001)}) == 1


def test_labels_of_held_out_rows_change_nothing(spark, world):
    docs, labels, _ = world
    held = quality.held_out(labels.doc_id)
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (dict(quality.fit(docs, x).score(docs.where("doc_id < 600"), "doc_id").collect()) for x in (labels, turned))
    assert a == pytest.approx(b)


def test_word_vectors_equal_a_loop(spark):
    texts = ["Aa bb, cc aa", None, "dd", "bb bb"]
    got = quality.word_vectors(spark.createDataFrame([(t,) for t in texts], "text string"))
    import pyarrow as pa

    want = np.zeros_like(got)
    for _, row, first in quality.hashed_words(pa.array(texts)):
        for a, b in zip(first, first[1:]):
            own = row[a:b]
            for i in range(len(own)):
                for j in range(max(0, i - quality.REACH), min(len(own), i + quality.REACH + 1)):
                    if i != j:
                        for k in range(quality.NONZERO):
                            want[own[i], quality._DIM[own[j], k]] += quality._SIGN[own[j], k]
    assert np.array_equal(got, want)


def test_without_labels_or_documents(spark, world, no_documents):
    docs, labels, _ = world
    none = labels.where("false")
    assert {r.score for r in quality.fit(docs, none).score(docs.limit(5), "doc_id").collect()} == {0.5}
    assert quality.fit(no_documents, labels).score(no_documents, "doc_id").count() == 0


def test_temperature_calibrates():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 4))
    p = 1 / (1 + np.exp(-2 * x[:, 0]))
    y = (rng.random(4000) < p).astype(float)
    net = quality.Network.fit(x, y, epochs=40)
    out = net(x)
    for lo in (0.1, 0.3, 0.5, 0.7):
        some = (out >= lo) & (out < lo + 0.2)
        assert abs(out[some].mean() - y[some].mean()) < 0.07
