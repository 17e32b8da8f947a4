import re

import pytest

from capturelake.llm import licenses

MIT = licenses.TEMPLATES[1].text.capitalize().replace(" software ", ' "Software", ').replace(" conditions ", " conditions:\n") + " in all copies."
TEXTS = [
    "Plain words only.",
    "Some text.\nReleased under the MIT License.",
    "mit-LICENSE mit license, MIT/License",
    "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0.",
    "general public license general public licenses ageneral public license",
    "the Apache licence and the mit licenses",
    MIT,
    MIT.replace("the above copyright notice", "some notice"),
    "mit\xa0license mit license élicense mitélicense",
    "Mit Licen\u017fe",
    None,
    "",
    "...",
    "license " * 5000 + "mit license",
    "a " * 100 + "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
]


def base(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, places = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered), []
    for phrase, label in licenses.PHRASES.items():
        own = phrase.split()
        places += [(k, label) for k in range(len(words)) if words[k : k + len(own)] == own]
    starts = [k for k, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_base_equals_brute_force(spark):
    df = spark.createDataFrame([(k, t, "none", 0.0) for k, t in enumerate(TEXTS * 2)], "doc_id long, text string, labels string, row double")
    got = licenses.scan(df).collect()
    assert len(got) == 2 * len(TEXTS)
    for r in got:
        n, places, first, last, labels = base(TEXTS[r.doc_id % len(TEXTS)])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, places, first, last, labels), TEXTS[r.doc_id % len(TEXTS)]
        assert set(labels.split(",")) - {""} <= set(r.labels.split(",")) and r.labels == ",".join(sorted(r.labels.split(",")))
        assert 0 <= r.score <= 1


@pytest.mark.parametrize(
    "k,labels",
    [(0, ""), (1, "mit"), (3, "apache,apache-2.0"), (4, "gpl,gpl-3.0"), (5, "cc-by-nc-4.0"), (7, ""), (8, "mit"), (9, ""), (12, ""), (16, "bsd")],
)
def test_templates(spark, k, labels):
    # other texts give the words their frequencies
    df = spark.createDataFrame([(0, TEXTS[k]), *((j, "the of is under to and a in this words") for j in range(1, 20))], "doc_id long, text string")
    assert licenses.scan(df).where("doc_id = 0").first().labels == labels


def test_frequencies_cover_all_documents(spark):
    df = spark.createDataFrame([("the the license",), ("THE x",), (None,), ("İ \u212a",)], "text string")
    assert dict(licenses.document_frequencies(df, ["the", "license", "k"]).collect()) == {"the": 2, "license": 1}


def test_no_python_in_the_plan(spark, no_documents):
    plan = licenses.scan(no_documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert licenses.scan(no_documents).count() == 0


def test_every_template_is_found(spark):
    """A template's own words, among others, with punctuation and over several lines."""
    rows = [(k, "Some words first.\n" + t.text.upper().replace(" of ", "\n OF ").replace("PUBLIC DOMAIN", "PUBLIC\nDOMAIN") + ".\nMore words.", t.label) for k, t in enumerate(licenses.TEMPLATES)]
    rows += [(100 + k, "the of is under to and a in this words", None) for k in range(200)]
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, want string")).collect()}
    assert [want for k, _, want in rows if want and want not in got[k]] == []
