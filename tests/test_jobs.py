import json

import pytest
from pyspark.sql import functions as F

from capturelake.config import Settings
from capturelake.operators import dedup, jobs
from capturelake.operators.crawl import crawl
from capturelake.plans.job import JobOptions, manifest_rows, page_records, run, write

PAGE = "url string, status_code int, raw_bytes bigint, markdown_chars bigint, retention_ratio double, stripped_elements int, low_content boolean, license string, ai_txt map<string,string>, llms_txt boolean, error string"
ROWS = [
    ("https://a/x", 200, 100, 50, 0.9, 3, False, "CC-BY", {"training": "Allow"}, True, None),
    ("https://a/y", 200, 150, 60, 0.5, 1, False, "CC-BY", {"training": "Allow"}, None, None),
    ("https://b/z", None, 0, 0, None, None, None, None, None, None, "boom"),
]


def content(path):
    return json.loads(path.read_text())


def test_data_card(spark, tmp_path):
    df = spark.createDataFrame(ROWS, PAGE)
    r = jobs.summary(df).first()
    assert (r.pages, r.succeeded, r.failed, r.total_raw_bytes, r.total_markdown_chars) == (3, 2, 1, 250, 110)
    assert (r.retention_min, r.retention_max, r.retention_avg, r.licenses_seen) == (0.5, 0.9, 0.7, ["CC-BY"])
    assert (r.ai_txt_hosts, r.llms_txt_hosts, r.low_content_pages) == (1, 1, 0)
    jobs.write_data_card(df, "a", "crawl", str(tmp_path / "card.json"))
    card = content(tmp_path / "card.json")
    assert "1.0" == card["schema_version"] and card["summary"]["retention_ratio"] == {"min": 0.5, "max": 0.9, "avg": 0.7} and len(card["pages"]) == 3


def test_data_card_edges(spark):
    empty = jobs.summary(spark.createDataFrame([], PAGE)).first()
    assert (empty.pages, empty.total_raw_bytes, empty.retention_avg) == (0, 0, None)
    bare = jobs.summary(spark.createDataFrame([("https://a/",)], "url string")).first()
    assert (bare.succeeded, bare.failed) == (1, 0)


def test_scorecard(spark):
    rows = [("a", 200, 10.0, 100, 50, True), ("b", 200, 20.0, 0, 7, False), ("c", None, 99.0, 0, 0, False)]
    r = jobs.scorecard(spark.createDataFrame(rows, "url string, status_code int, latency_ms double, raw_bytes bigint, markdown_chars bigint, provenance_complete boolean")).first()
    assert (r.total, r.successful, r.success_rate, r.avg_latency_ms, r.avg_markdown_ratio, r.provenance_complete, r.token_estimate) == (3, 2, 0.6667, 15.0, 3.75, 1, 14)


def test_context(spark):
    files = spark.createDataFrame([(f"{k}.md", f"# Doc {k}\n" + "word " * 100) for k in range(3)], "name string, text string")
    got = jobs.context_sample(files, 2, 200).first()["content"]
    assert got.startswith("## File: 0.md\n# Doc 0") and "truncated" in got and "1.md" not in got and got.endswith("[Note: Showing 2 of 3 files]")
    assert jobs.context_sample(files.limit(0)).first()["content"] == "No content available."
    assert jobs.context_sample(files.limit(1), 2).first()["content"].startswith("# Doc 0")


def test_llms(spark, tmp_path):
    pages = spark.createDataFrame([(2, "https://h/b", "", "B\n"), (1, "https://h/a", "A", "text\n")], "seq int, url string, title string, markdown string")
    assert jobs.llms_txt(pages, "h").first()["content"].endswith("## Pages\n\n- [A](https://h/a)\n- [https://h/b](https://h/b)\n")
    jobs.write_llms_full(pages, str(tmp_path / "full.txt"))
    assert (tmp_path / "full.txt").read_text() == "# A\n\nSource: https://h/a\n\ntext\n\n\n---\n\n# https://h/b\n\nSource: https://h/b\n\nB\n"


def test_dedup(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("b", 2), (None, 4), (None, 5), ("c", 6)], "h string, seq int")
    seen = spark.createDataFrame([("c",), ("c",)], "h string")
    got = {(r.h, r.seq): r.is_duplicate for r in dedup.marked(df, "h", "seq", seen).collect()}
    assert got == {("a", 3): True, ("a", 1): False, ("b", 2): False, (None, 4): False, (None, 5): False, ("c", 6): True}
    assert sorted(r.seq for r in dedup.first_of_each(df.where("h is not null"), "h", "seq").collect()) == [1, 2, 6]


def test_crawl(spark):
    edges = spark.createDataFrame([("hub", "a", 0), ("hub", "b", 1), ("a", "hub", 0), ("a", "c", 1), ("b", "c", 0), ("c", "d", 0), ("b", "gone", 1)], "src string, dst string, pos int")
    known = spark.createDataFrame([(u,) for u in ("hub", "a", "b", "c", "d")], "url string")
    start = spark.createDataFrame([("hub",)], "url string")
    all_of = crawl(edges, known, start)
    assert [(r.url, r.depth, r.ok) for r in all_of.visited.orderBy("seq").collect()] == [("hub", 0, True), ("a", 1, True), ("b", 1, True), ("c", 2, True), ("gone", 2, False), ("d", 3, True)]
    assert not all_of.hit_limit and all_of.frontier.count() == 0
    assert {r.url for r in crawl(edges, known, start, max_depth=1).visited.collect()} == {"hub", "a", "b"}
    some = crawl(edges, known, start, max_pages=2)
    assert [r.url for r in some.visited.orderBy("seq").collect()] == ["hub", "a"] and some.hit_limit
    rest = crawl(edges, known, some.frontier, visited=some.visited)
    assert {r.url for r in rest.visited.collect()} == {"b", "c", "gone", "d"}


LONG = "Words of a page that is long enough to be content. " * 6


@pytest.fixture
def captured(spark):
    page = lambda t, lic="": f"<html><head><title>{t}</title>{lic}</head><body><main><h1>{t}</h1><p>{LONG}{t}</p></main>"
    rows = [
        (1, "https://h.org/a", 200, page("A"), None),
        (2, "https://h.org/b", 200, page("B"), None),
        (3, "https://h.org/copy", 200, page("A"), None),
        (4, "https://h.org/prop", 200, page("P", "<meta name=license content='All Rights Reserved'>"), None),
        (5, "https://h.org/gone", 404, "", None),
        (6, "https://h.org/boom", None, None, "refused"),
        (7, "https://h.org/empty", 200, "<html></html>", None),
        (8, "https://h.org/same", 304, "", None),
        (9, "https://h.org/unchanged", 200, page("U"), None),
        (10, "https://h.org/there", 200, page("T"), None),
    ]
    df = spark.createDataFrame(rows, "seq long, url string, status_code int, html string, error string")
    return df.withColumns({"final_url": F.col("url"), "fetched_at": F.lit("2026-01-01T00:00:00Z"), "response_headers": F.create_map(F.lit("etag"), F.lit('"e"')), "content_type": F.lit("text/html")})


def test_job(spark, captured, tmp_path):
    options = JobOptions(source="h.org", policies=[dict(deny_if=dict(license="All Rights Reserved"), name="no-proprietary")], extra={"team": "kb", "url": "x"})
    old = captured.where("seq = 9").select("url", F.sha2("html", 256).alias("bytes_sha256"), F.lit("h").alias("content_hash"))
    existing = spark.createDataFrame([(r["f"],) for r in captured.where("seq = 10").select(F.concat(F.lit("h.org-there-"), F.substring(F.sha2("url", 256), 1, 8), F.lit(".md")).alias("f")).collect()], "file string")
    results = run(captured, options, Settings(), old, existing=existing)
    got = {r.seq: r.outcome for r in results.select("seq", "outcome").collect()}
    assert got == {1: "saved", 2: "saved", 3: "duplicate", 4: "blocked", 5: "failed", 6: "failed", 7: "failed", 8: "not_modified", 9: "unchanged", 10: "skipped"}
    one = results.where("seq = 1").first()
    assert one.document.startswith("---\ntitle: A\nurl: https://h.org/a\n") and "team: kb" in one.document and "etag: '\"e\"'" in one.document
    cards = page_records(results)
    assert {r.url[14:] for r in cards.collect()} == {"a", "b", "prop", "gone", "boom", "empty", "same", "unchanged"}
    assert [r.title for r in manifest_rows(results).orderBy("seq").collect()] == ["A", "B"]
    from dataclasses import replace

    settings = replace(Settings(), output=replace(Settings().output, chunk=True, warc=True))
    counts = write(results, str(tmp_path), options, settings, export="json", llms=True)
    assert counts["saved"] == 2
    names = sorted(p.name for p in tmp_path.iterdir() if p.is_file() and not p.name.startswith("."))
    assert [n for n in names if n.endswith(".md")] and {"_manifest.json", "data-card.json", "documents.json", "llms.txt", "llms-full.txt"} <= set(names)
    assert len(content(tmp_path / "documents.json")) == 2
    assert len(content(tmp_path / "_manifest.json")) == 2
    assert len(list((tmp_path / "store").glob("[0-9a-f]*"))) == 3
    chunk_file = next(tmp_path.glob("*.chunks.json"))
    assert json.loads(chunk_file.read_text())[0]["chunk_id"] == "c0"


def test_blocked_page_owns_its_hash(spark, captured):
    twin = captured.where("seq = 4").withColumns({"seq": F.lit(11).cast("long"), "url": F.lit("https://h.org/twin")})
    results = run(captured.unionByName(twin), JobOptions(policies=[{"deny_if": {"license": "all rights"}}]))
    assert {r.seq: r.outcome for r in results.where("seq in (4, 11)").collect()} == {4: "blocked", 11: "duplicate"}


def test_exit_code(spark):
    assert jobs.exit_code(spark.createDataFrame([("failed",)], "outcome string")) == 1
    assert jobs.exit_code(spark.createDataFrame([("failed",), ("skipped",)], "outcome string")) == 0
