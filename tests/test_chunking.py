import time
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from capturelake.operators.chunking import chunk, chunks, estimate, manifest, sections_table


def spans_hold(text, **limits):
    out = chunk(text, **limits)
    for c in out:
        assert text[c["start"] : c["end"]] == c["content"] and c["char_count"] == len(c["content"])
    return out


def test_sections():
    got = spans_hold("pre\n\n# Title\nx\n## Section A\ny\n## Section B\n\n# Next\n")
    assert [(c["chunk_id"], c["heading_path"]) for c in got] == [("c0", []), ("c1", ["Title"]), ("c2", ["Title", "Section A"]), ("c3", ["Title", "Section B"]), ("c4", ["Next"])]
    assert [c["chunk_id"] for c in chunk("Just a paragraph.")] == ["c0"]
    assert chunk("") == [] and chunk(" \n ") == []


def test_fences_hide_headings():
    got = chunk("# A\n```\n# not a heading\n```\n~~~\n## nor this\n~~~\n# B")
    assert [c["heading_path"] for c in got] == [["A"], ["B"]]


def test_estimate():
    assert estimate("") == 1 and estimate("alpha beta") == 3 and estimate("汉字 ab") == 3


@pytest.mark.parametrize("text,limit,overlap", [("alpha " * 400, 128, 64), ("汉" * 400, 100, 64), (("汉" * 199 + "。 ") * 8, 64, 16), ("words go here. " * 50 + "汉" * 600 + " words again." * 20, 128, 64), ("x" * 5000, 100, 10)])
def test_budget(text, limit, overlap):
    got = spans_hold(text, max_tokens=limit, overlap_tokens=overlap)
    assert len(got) > 1 and all(c["token_count"] <= limit for c in got)
    assert all(c["chunk_id"] == f"c0.{k}" for k, c in enumerate(got))


def test_overlap_is_the_tail_of_the_window_before():
    text = "".join(f"Sentence number {k} is here. " for k in range(60))
    got = chunk(text, max_tokens=60, overlap_tokens=12)
    assert all(a["end"] > b["start"] for a, b in zip(got, got[1:]))
    assert all(estimate(text[b["start"] : a["end"]]) <= 12 for a, b in zip(got, got[1:]))


def test_legacy_characters():
    got = spans_hold("One sentence here. " * 60, max_chars=300)
    assert len(got) > 1 and all(c["token_count"] <= 76 for c in got)
    assert all(a["end"] <= b["start"] for a, b in zip(got, got[1:]))


@given(st.text(alphabet="ab. \n#汉`!", max_size=300), st.integers(1, 40), st.integers(0, 10))
@settings(max_examples=150, deadline=None)
def test_spans_always_hold(text, limit, overlap):
    spans_hold(text, max_tokens=limit, overlap_tokens=overlap)


def test_tables(spark):
    df = spark.createDataFrame([("u", "# A\ntext\n## B\nmore", "h"), ("v", None, "i"), ("w", "", "j")], "url string, markdown string, content_hash string")
    rows = manifest(df).orderBy("chunk_id").collect()
    assert [(r.doc_id, r.chunk_id, r.heading_path, len(r.chunk_sha256)) for r in rows] == [("u", "c0", ["A"], 64), ("u", "c1", ["A", "B"], 64)]
    assert df.select(chunks(df.markdown).alias("c")).where("size(c) = 0").count() == 2
    assert [(r.level, r.title) for r in sections_table(df, "url", "markdown").orderBy("line").collect()] == [(1, "A"), (2, "B")]


@pytest.mark.parametrize("unit", ["\u8a9e", "x", "\u8a9ex", ". "])
def test_long_unbroken_text_is_linear(unit):
    """Slices of a run cost their own length: a long run takes its share, and its slices are as long as they may be."""

    def seconds(n):
        began = time.process_time()
        made = chunk(unit * (n // len(unit)))
        assert "".join(c["content"] for c in made).strip() == (unit * (n // len(unit))).strip() or unit == ". "
        assert all(c["token_count"] == 512 for c in made[:-2]) or len(unit) > 1
        return time.process_time() - began

    assert seconds(800_000) < 20 * max(seconds(100_000), 0.05)


@pytest.mark.parametrize("name", ["chunk_spans", "chunk_whole", "chunk_windows", "chunk_hard_split"])
def test_chunk_queries_hold_short_batches(spark, tmp_path, name):
    """A task holds the chunks of one Arrow batch, however many rows its partition has."""
    from capturelake.batches import BYTES, ROWS
    from capturelake.plans.queries import REGISTRY

    spark.createDataFrame([(1, "word " * 900)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(rows, "10000")
    spark.conf.unset(size)
    REGISTRY[name](spark, str(tmp_path)).collect()
    assert int(spark.conf.get(rows)) <= ROWS and int(spark.conf.get(size)) <= BYTES
