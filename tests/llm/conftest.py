import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text) with copies, near copies, shared passages, and the awkward cases."""
    rng = random.Random(4)
    word = lambda: "".join(rng.sample(WORDS, 2))
    text = lambda n: [word() for _ in range(n)]
    rows, passage = [], text(40)
    for k in range(40):
        rows.append(text(rng.randint(30, 160)))
    for k in range(12):  # near copies at many similarities
        base = list(rng.choice(rows[:40]))
        for _ in range(rng.randint(1, 9)):
            base[rng.randrange(len(base))] = word()
        rows.append(base)
    for k in range(10):  # copies
        rows.append(list(rows[3]))
    for k in range(10):  # a passage that many share
        rows.append(text(20) + passage[: rng.randint(10, 40)] + text(20))
    texts = [rng.choice((" ", " ", " ", "\n")).join(r) for r in rows]
    texts += [None, "", "  \n\t ", "one", "one two", "One TWO", "one two three", text(1)[0] * 400, " ".join(["so"] * 60), "a b c\x0bd"]
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts))


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """The corpus with clashing and unknown extra columns, nulls and a repeated row."""
    rows = [(i, t, "x", None, 1) for i, t in corpus] + [(*corpus[0], "x", None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, component_id string, kept string, n_words int")


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string")
