"""Queries of the library by name: (spark, folder of tables) to a DataFrame with columns of plain types."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..batches import short_batches
from ..functions import consent, hashing, policy, text, urls
from ..operators import bench, chunking, dedup, documents, jobs, provenance
from ..operators.capture import converted, fetch_and_convert, links_in_scope, needs_render
from ..operators.crawl import crawl
from ..sinks import files
from ..sources import network, tables, warc
from .job import JobOptions, manifest_rows, page_records, run

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

#: Ed25519 test key of RFC 8032, section 7.1, and a fixed time of signing.
SEED = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
SIGNED_AT = "2026-01-01T00:00:00Z"
FETCHED_AT = "2026-01-01T00:00:00Z"


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages")


def converted_pages(spark: SparkSession, folder: str) -> DataFrame:
    return converted(tables.captures(pages(spark, folder), fetched_at=FETCHED_AT))


# --- sources and hashes


@query
def capture_hash(spark: SparkSession, folder: str) -> DataFrame:
    return pages(spark, folder).select("page_id", hashing.bytes_hash(F.col("html")).alias("bytes_sha256"), F.octet_length("html").cast("bigint").alias("raw_bytes"))


@query
def content_hash(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", hashing.content_hash(F.col("text")).alias("content_hash"), hashing.short_hash(F.col("text")).alias("short_hash"))


@query
def capture_rows(spark: SparkSession, folder: str) -> DataFrame:
    return tables.captures(pages(spark, folder), fetched_at=FETCHED_AT).select("page_id", "url", "final_url", "status_code", "fetched_at", "content_type", F.col("redirect_chain")[0].alias("last_hop"), F.length("html").cast("bigint").alias("html_chars"))


@query
def url_list_lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = pages(spark, folder).select("page_id", F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("#"), F.col("url"))).when(F.col("page_id") % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("url"))).alias("value"))
    return lines.where(~F.col("value").startswith("#")).select("page_id", F.trim("value").alias("url")).where("url <> ''")


# --- URL functions


@query
def url_parts(spark: SparkSession, folder: str) -> DataFrame:
    u = F.col("url")
    return pages(spark, folder).select("page_id", urls.scheme(u).alias("scheme"), urls.netloc(u).alias("netloc"), urls.host(u).alias("host"), urls.port(u).cast("bigint").alias("port"), urls.path(u).alias("path"), urls.query(u).alias("query"), urls.origin(u).alias("origin"))


@query
def url_normalize(spark: SparkSession, folder: str) -> DataFrame:
    return pages(spark, folder).select("page_id", urls.normalize(F.col("url")).alias("normalized"))


@query
def url_base_path(spark: SparkSession, folder: str) -> DataFrame:
    return pages(spark, folder).select("page_id", urls.base_path(urls.path(F.col("url"))).alias("base_path"))


@query
def url_filename(spark: SparkSession, folder: str) -> DataFrame:
    return pages(spark, folder).select("page_id", urls.file_name(F.col("url")).alias("file"))


@query
def url_collection(spark: SparkSession, folder: str) -> DataFrame:
    return pages(spark, folder).select("page_id", urls.collection_name(F.col("url")).alias("collection"))


@query
def url_same_origin(spark: SparkSession, folder: str) -> DataFrame:
    secure = F.regexp_replace("url", "^http:", "https:")
    upper = F.concat(urls.scheme(F.col("url")), F.lit("://"), F.upper(urls.netloc(F.col("url"))), F.when(urls.scheme(F.col("url")) == "https", ":443").otherwise(":8080"), F.lit("/x"))
    return pages(spark, folder).select("page_id", urls.same_origin(F.col("url"), secure).alias("same_secure"), urls.same_origin(F.col("url"), upper).alias("same_upper"))


@query
def header_scoping(spark: SparkSession, folder: str) -> DataFrame:
    headers = F.create_map(F.lit("Authorization"), F.lit("secret"), F.lit("User-Agent"), F.lit("lake"))
    hop = F.when(F.col("page_id") % 2 == 0, F.concat(urls.origin(F.col("url")), F.lit("/landed"))).otherwise("https://else.example/")
    return pages(spark, folder).select("page_id", F.size(urls.scoped_headers(headers, F.col("url"), hop)).cast("bigint").alias("n_headers"))


# --- HTML


@query
def fetch_and_convert_rows(spark: SparkSession, folder: str) -> DataFrame:
    made = fetch_and_convert(tables.captures(pages(spark, folder), fetched_at=FETCHED_AT))
    return made.select("url", "content_hash", "bytes_sha256", "status_code", "fetched_at")


@query
def page_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return converted_pages(spark, folder).select("page_id", "metadata.title", "metadata.language", "metadata.author", "metadata.license")


@query
def page_links(spark: SparkSession, folder: str) -> DataFrame:
    # an inner explode filters by the size of the array first, and would convert each page twice for that
    found = converted_pages(spark, folder).select("page_id", F.posexplode_outer("links").alias("pos", "link")).where("pos IS NOT NULL")
    return found.select("page_id", F.col("pos").cast("bigint").alias("pos"), "link")


@query
def links_in_site(spark: SparkSession, folder: str) -> DataFrame:
    """Links of all pages that stay on one site, and in one folder of it."""
    start = "https://thther.example.org/"
    return links_in_scope(pages(spark, folder), start).groupBy("link").agg(F.count("*").alias("n"))


@query
def html_to_markdown(spark: SparkSession, folder: str) -> DataFrame:
    return converted_pages(spark, folder).select("page_id", "markdown")


@query
def page_measures(spark: SparkSession, folder: str) -> DataFrame:
    measures = ("source_chars", "markdown_chars", "kept_chars", "stripped_elements")
    return converted_pages(spark, folder).select("page_id", *(F.col(c).cast("bigint").alias(c) for c in measures), "low_content")


@query
def retention(spark: SparkSession, folder: str) -> DataFrame:
    c = converted_pages(spark, folder)
    return c.select("page_id", text.retention(F.col("kept_chars"), F.col("source_chars")).alias("retention_ratio"), (F.abs(F.col("retention_ratio") - text.retention(F.col("kept_chars"), F.col("source_chars"))) < 0.00015).alias("agrees"))


@query
def markdown_text(spark: SparkSession, folder: str) -> DataFrame:
    """The visible text of Markdown by SQL functions, over the converted pages."""
    c = converted_pages(spark, folder)
    return c.select("page_id", F.length(text.visible_text(F.col("markdown"))).cast("bigint").alias("visible_chars"), (text.tidy(F.col("markdown")) == F.col("markdown")).alias("is_tidy"))


@query
def render_routing(spark: SparkSession, folder: str) -> DataFrame:
    return needs_render(pages(spark, folder), "auto").select("page_id", "needs_render")


# --- elements: fragments made of each document's columns, converted


#: Fragments by query; W, S, L and N stand for a document's word (w and its id), source, language and id.
FRAGMENTS = {
    "markdown_inline": "<p>A <strong>W</strong> and <em>S</em>, <code>f(N)</code>.<br>next <i></i><b> L </b></p><hr>",
    "markdown_code": "<pre><code class='hljs language-python'>x = N\n</code></pre><p>or</p><pre><code class='lang-js'>W</code></pre><pre><code class='rust'>S</code></pre><pre> plain L </pre>",
    "markdown_lists": "<ul><li>W</li><li></li><li>S<p>L</p></li></ul><ol start=3><li>a</li><li></li><li>W</li></ol><ol start=x><li>N</ol>",
    "markdown_quotes": "<blockquote><p>W</p></blockquote><dl><dt>T W</dt><dd>S</dd></dl><section><div>L</div></section>",
    "markdown_tables": "<table><thead><tr><th>Name<th>Lang<tbody><tr><td>W<td>L<tr><td>a | S<td><p>x<p>N<tr><td>W</table>",
    "markdown_links": "<p><a href='/a?n=N'>W</a> <a href='#f'>S</a> <a href='javascript:z()'>z</a> <a href='/e'></a><img src='N.png' alt='I L'><img src='data:x'></p>",
}


def _filled(fragment: str):  # noqa: ANN202
    """``fragment`` with a document's values: pieces between W, S, L and N standing alone."""
    import re

    values = {"W": F.concat(F.lit("w"), F.col("doc_id")), "S": F.col("source"), "L": F.col("lang"), "N": F.col("doc_id").cast("string")}
    return F.concat(*(values.get(part, F.lit(part)) for part in re.split(r"\b([WSLN])\b", fragment) if part))


def _fragments(spark: SparkSession, folder: str, html: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.lit("https://h.org/d/").alias("url"), _filled(html).alias("html"))
    return converted(docs)


def _element_query(name: str, fragment: str) -> None:
    def run_one(spark: SparkSession, folder: str) -> DataFrame:
        return _fragments(spark, folder, f"<html><body><main>{fragment}</main></body></html>").select("doc_id", "markdown")

    run_one.__name__ = name
    query(run_one)


for _name, _fragment in FRAGMENTS.items():
    _element_query(_name, _fragment)


@query
def markdown_boilerplate(spark: SparkSession, folder: str) -> DataFrame:
    """Comments, excluded tags, classes, class words, permalinks and unknown elements of a page without a main part."""
    html = "<html><head><title>t</title></head><body><!-- N --><h2>W<a class='headerlink' href='#x'>\u00b6</a></h2><nav>menu</nav><div class='bd-sidebar-primary'>side</div><div class='cookie-note'>bar</div><div class='research-content'>kept W</div><script>x()</script><p>S</p><foo>L</foo><footer>f</footer></body></html>"
    return _fragments(spark, folder, html).select("doc_id", "markdown", F.col("stripped_elements").cast("bigint").alias("stripped_elements"))


@query
def markdown_shadow_tables(spark: SparkSession, folder: str) -> DataFrame:
    """A sticky clone of a table's header goes, the table stays."""
    html = "<html><body><div class='pm-table-sticky-wrapper'><table><tr><th>S</th></tr></table></div><table><tr><th>S</th></tr><tr><td>W</td></tr></table></body></html>"
    return _fragments(spark, folder, html).select("doc_id", "markdown")


@query
def markdown_content(spark: SparkSession, folder: str) -> DataFrame:
    """Outer articles that are long enough are the content; inner, short and outside text is not taken twice, or at all."""
    long = "Many words of content stand here for W. " * 8
    return _fragments(spark, folder, f"<html><body><p>outside</p><article>{long}<article>inner {long}</article></article><article>short</article></body></html>").select("doc_id", "markdown")


@query
def meta_tags(spark: SparkSession, folder: str) -> DataFrame:
    html = "<html lang=' L '><head><title>W &amp;amp; S</title><meta name='author' content='A W'><meta property='og:site_name' content='S'><meta name='description' content='D &quot;L&quot;'><meta property='article:published_time' content='20N'><meta property='article:modified_time' content='2021'><link rel='stylesheet license' href='/lic/N'></head><body>x</body></html>"
    return _fragments(spark, folder, html).select("doc_id", "metadata.*")


# --- text


@query
def token_estimate(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query
def token_budgets(spark: SparkSession, folder: str) -> DataFrame:
    """Running token budget of each conversation."""
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = table(spark, folder, "conversations").withColumn("tokens", text.token_estimate(F.col("text")))
    return rows.select("conv_id", "turn", "tokens", F.sum("tokens").over(order).cast("bigint").alias("running"))


@query
def token_histogram(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("lang", F.floor(text.token_estimate(F.col("text")) / 256).alias("bucket"))
    return rows.groupBy("lang", "bucket").agg(F.count("*").alias("n"))


@query
def thinking_tags(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", F.concat(F.lit("<think>why\n</think>\n\n \n"), F.col("text"), F.lit("\n")).alias("answer"))
    return rows.select("conv_id", "turn", text.without_thinking(F.col("answer")).alias("answer"))


@query
def prompts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "benchmark").select("item_id", text.prompt("Describe: {content} Briefly.", F.col("text"), "qwen-small").alias("prompt"))


# --- duplicates and changes


@query
def content_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", hashing.content_hash(F.col("text")).alias("content_hash"))
    return dedup.marked(rows, "content_hash", "doc_id").select("doc_id", "is_duplicate")


@query
def first_of_each(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", "lang", hashing.content_hash(F.col("text")).alias("content_hash"))
    return dedup.first_of_each(rows, "content_hash", "doc_id").select("doc_id", "lang", "content_hash")


@query
def duplicate_report(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").groupBy(hashing.content_hash(F.col("text")).alias("content_hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))
    return rows.where("copies > 1")


@query
def seen_hashes(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", hashing.content_hash(F.col("text")).alias("content_hash"))
    seen = docs.where("doc_id % 3 = 0").select("content_hash")
    return dedup.unseen(docs, seen, "content_hash").select("doc_id")


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    """A manifest of an earlier run: a third of the pages as they are, a third changed, a third not there."""
    old = pages(spark, folder).where("page_id % 3 < 2")
    body = F.when(F.col("page_id") % 3 == 0, F.col("html")).otherwise(F.concat("html", F.lit("old")))
    return old.select("page_id", "url", F.sha2(body, 256).alias("bytes_sha256"), hashing.content_hash(body).alias("content_hash"), F.concat(F.lit('"'), F.col("page_id"), F.lit('"')).alias("etag"), F.lit("").alias("last_modified"), (F.col("page_id") % 2 == 0).alias("file_exists"), F.col("page_id").alias("seq"))


@query
def incremental_changes(spark: SparkSession, folder: str) -> DataFrame:
    now = pages(spark, folder).select("page_id", "url", F.when(F.col("page_id") % 10 == 9, 304).otherwise(200).alias("status_code"), F.sha2("html", 256).alias("bytes_sha256"))
    old = dedup.latest_manifest(_manifest(spark, folder).drop("page_id"))
    return dedup.changes(now, old).select("page_id", "change")


@query
def conditional_headers(spark: SparkSession, folder: str) -> DataFrame:
    old = dedup.latest_manifest(_manifest(spark, folder).drop("page_id"))
    asked = dedup.validators(pages(spark, folder).select("page_id", "url"), old)
    return asked.select("page_id", F.size("request_headers").cast("bigint").alias("n_headers"), F.coalesce(F.try_element_at("request_headers", F.lit("If-None-Match")), F.lit("")).alias("if_none_match"))


# --- policy and consent


LICENSE_LINE = r"(?im)^(.*(?:license|all rights reserved).*)$"


def _licensed(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    n = F.col("doc_id") % 6
    ai = F.when(n == 0, F.create_map(F.lit("training"), F.lit("Deny"))).when(n == 1, F.create_map(F.lit("data"), F.lit("deny"))).when(n == 2, F.create_map(F.lit("disallow"), F.lit("/private/"))).otherwise(F.create_map().cast("map<string,string>"))
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org"), F.when(F.col("doc_id") % 4 == 0, "/private/").otherwise("/docs/"), F.col("doc_id").cast("string"))
    return docs.select("doc_id", url.alias("url"), F.regexp_extract("text", LICENSE_LINE, 1).alias("license"), ai.alias("ai_txt"))


def _decided(df: DataFrame, rules: list[dict], key: str) -> DataFrame:
    decision = policy.Policy(rules).decide(F.col("url"), F.col("license"), F.col("ai_txt"))
    return df.withColumn("d", decision).select(key, "d.allowed", "d.rule", "d.reason")


@query
def policy_strict(spark: SparkSession, folder: str) -> DataFrame:
    return _decided(_licensed(spark, folder), policy.profile("strict-optout"), "doc_id")


@query
def policy_open(spark: SparkSession, folder: str) -> DataFrame:
    return _decided(_licensed(spark, folder), policy.profile("open-only"), "doc_id")


PATH_RULES = [{"name": "no-english", "deny_if": {"path": ["/en/[5-9]*", "/fr/?"]}}, {"allow_if": {"path": "/de/*"}, "name": "german"}, {"deny_if": {"path": "*/7*"}, "reason": "seven"}]


@query
def policy_paths(spark: SparkSession, folder: str) -> DataFrame:
    rows = pages(spark, folder).select("page_id", "url", F.lit("").alias("license"), F.create_map().cast("map<string,string>").alias("ai_txt"))
    return _decided(rows, PATH_RULES, "page_id")


AI_TXT = "# policy\nUser-Agent: *\nTraining: opt-out # no\nData: yes\nDisallow: /private/\nEmpty:\nUser-Agent: lake\nTraining: permitted\nAllow: /\nUser-Agent: lake/2\nData: never\n"
AGENTS = ["lake", "lake/1.0", "lake/2", "lake/2 beta", "lakes", "other"]


@query
def ai_txt_groups(spark: SparkSession, folder: str) -> DataFrame:
    out = None
    for agent in AGENTS:
        one = spark.createDataFrame([(AI_TXT,)], "body string").select(F.lit(agent).alias("agent"), F.explode(consent.summary(consent.parse_ai_txt(F.col("body"), agent))).alias("key", "value"))
        out = one if out is None else out.unionByName(one)
    return out


@query
def directives(spark: SparkSession, folder: str) -> DataFrame:
    words = ["Deny", " no ", "opt-in", "TRUE", "ask first", "never", "Permitted"]
    return spark.createDataFrame([(w,) for w in words], "value string").select("value", consent.directive(F.col("value")).alias("directive"))


def _host_files(spark: SparkSession, folder: str) -> DataFrame:
    """Well-known files of each site of the pages: an ai.txt where the host's name has an even length, some llms.txt."""
    sites = pages(spark, folder).select(urls.scheme(F.col("url")).alias("s"), urls.netloc(F.col("url")).alias("n")).distinct()
    size = F.length("n")
    ai = sites.select(F.concat("s", F.lit("://"), "n", F.lit("/ai.txt")).alias("url"), F.when(size % 2 == 0, 200).otherwise(404).alias("status_code"), F.lit(AI_TXT).alias("body"))
    llms = sites.select(F.concat("s", F.lit("://"), "n", F.lit("/llms.txt")).alias("url"), F.when(size % 3 == 0, 200).otherwise(500).alias("status_code"), F.lit("# site").alias("body"))
    folders = sites.where(size % 5 == 0).select(F.concat("s", F.lit("://"), "n", F.lit("/en/llms.txt")).alias("url"), F.lit(200).alias("status_code"), F.lit("# en").alias("body"))
    return ai.unionByName(llms).unionByName(folders)


@query
def page_consent(spark: SparkSession, folder: str) -> DataFrame:
    rows = consent.with_consent(pages(spark, folder).select("page_id", "url"), _host_files(spark, folder), "other")
    return rows.select("page_id", F.coalesce(F.try_element_at("ai_txt", F.lit("training")), F.lit("")).alias("training"), "llms_txt")


ROBOTS = "User-agent: *\nDisallow: /en/\nCrawl-delay: 2.5\n"


@query
def robots_rules(spark: SparkSession, folder: str) -> DataFrame:
    sites = pages(spark, folder).select(urls.origin(F.col("url")).alias("o")).distinct()
    files = sites.select(F.concat("o", F.lit("/robots.txt")).alias("url"), F.when(F.col("o").startswith("https"), 200).otherwise(404).alias("status_code"), F.lit(ROBOTS).alias("body"))
    rows = consent.robots_allowed(pages(spark, folder).select("page_id", "url"), files, "lake")
    return rows.select("page_id", "robots_allowed")


@query
def robots_redirects(spark: SparkSession, folder: str) -> DataFrame:
    """Whether every hop of a redirect is allowed; every other page comes from /en/ of its site."""
    files = pages(spark, folder).select(urls.origin(F.col("url")).alias("o")).distinct().select(F.concat("o", F.lit("/robots.txt")).alias("url"), F.lit(200).alias("status_code"), F.lit(ROBOTS).alias("body"))
    first = F.concat(urls.origin(F.col("url")), F.when(F.col("page_id") % 2 == 0, "/en/start").otherwise("/start"))
    rows = pages(spark, folder).select("page_id", "url", F.array(first, F.col("url")).alias("redirect_chain"))
    return consent.robots_allow_chain(rows, files, "lake").select("page_id", "robots_allowed")


@query
def rate_delays(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.createDataFrame([(1, ROBOTS, 500), (2, "crawl-DELAY : 90", 500), (3, "none", 500), (4, " Crawl-delay: 0.1", 500)], "id int, body string, rate_limit_ms int")
    delay = consent.crawl_delay(F.col("body"))
    return files.select("id", F.coalesce(delay, F.lit(-1.0)).alias("crawl_delay_s"), consent.delay_ms(F.col("rate_limit_ms"), delay).alias("delay_ms"))


ADDRESSES = "127.0.0.1 10.1.2.3 172.16.0.9 192.168.1.1 169.254.0.1 100.64.0.1 0.0.0.0 224.0.0.1 8.8.8.8 1.1.1.1 example.com ::1 ::ffff:10.0.0.1 2002:7f00:1:: 64:ff9b::1 2606:4700::1111".split()


@query
def private_addresses(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame([(a,) for a in ADDRESSES], "host string").select("host", network.is_blocked(F.col("host")).alias("blocked"))


# --- chunks


@query
def chunk_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("url"), F.col("text").alias("markdown"), hashing.content_hash(F.col("text")).alias("content_hash"))
    return chunking.manifest(docs).select("doc_id", "chunk_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), F.col("char_count").cast("bigint").alias("char_count"), F.col("token_count").cast("bigint").alias("token_count"), "chunk_sha256")


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    docs = short_batches(table(spark, folder, "documents"))
    return docs.select("doc_id", "text", F.explode(chunking.chunks(F.col("text"))).alias("c"))


@query
def chunk_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that are not the text of their span, or over their budget: none."""
    c = _chunks(spark, folder)
    wrong = (F.substring(F.col("text"), F.col("c.start") + 1, F.col("c.end") - F.col("c.start")) != F.col("c.content")) | (F.col("c.char_count") != F.col("c.end") - F.col("c.start")) | (F.col("c.token_count") > chunking.MAX_TOKENS + 1)
    return c.where(wrong).select("doc_id", "c.chunk_id")


def _sentences(spark: SparkSession, folder: str) -> DataFrame:
    """A heading and some hundred equal sentences of four tokens for each document."""
    n = (F.col("doc_id") % 397 + 3).cast("int")
    return table(spark, folder, "documents").select("doc_id", F.concat(F.lit("# T\n"), F.repeat(F.lit("aaaa bbbb cccc dddd. "), n)).alias("markdown"))


def _plain_chunks(docs: DataFrame, **limits: int) -> DataFrame:
    c = short_batches(docs).select("doc_id", F.explode(chunking.chunks(F.col("markdown"), **limits)).alias("c"))
    longs = (F.col(f"c.{k}").cast("bigint").alias(k) for k in ("start", "end", "char_count", "token_count"))
    return c.select("doc_id", "c.chunk_id", F.array_join("c.heading_path", "/").alias("heading"), *longs, F.sha2("c.content", 256).alias("content_sha256"))


@query
def chunk_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Long sections in overlapping windows of at most 512 tokens."""
    return _plain_chunks(_sentences(spark, folder))


@query
def chunk_legacy_chars(spark: SparkSession, folder: str) -> DataFrame:
    """A limit in characters: windows of a quarter as many tokens, without overlap."""
    return _plain_chunks(_sentences(spark, folder), max_chars=1000)


@query
def chunk_hard_split(spark: SparkSession, folder: str) -> DataFrame:
    """One word of thousands of letters, cut where 512 tokens are full."""
    docs = table(spark, folder, "documents").select("doc_id", F.repeat(F.lit("x"), (F.col("doc_id") % 97 * 100 + 1).cast("int")).alias("markdown"))
    return _plain_chunks(docs)


@query
def chunk_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of one section that fit into one chunk."""
    c = _chunks(spark, folder).where("c.chunk_id = 'c0'")
    return c.select("doc_id", F.col("c.start").cast("bigint").alias("start"), F.col("c.end").cast("bigint").alias("end"), F.col("c.token_count").cast("bigint").alias("token_count"))


@query
def chunk_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Headings of the converted pages."""
    return chunking.sections_table(converted_pages(spark, folder), "page_id", "markdown").select(F.col("doc_id").alias("page_id"), F.col("level").cast("bigint").alias("level"), "title")


# --- provenance and exports


def _records(spark: SparkSession, folder: str) -> DataFrame:
    rows = converted_pages(spark, folder)
    return rows.withColumn("frontmatter", provenance.front_matter(rows.drop("raw_bytes"), {"team": "kb", "url": "never"}))


@query
def provenance_records(spark: SparkSession, folder: str) -> DataFrame:
    f = F.col("frontmatter")
    return _records(spark, folder).select("page_id", *(f[c].alias(c) for c in "url title bytes_sha256 content_hash fetched_at status_code language team".split()), f["low_content"].alias("low_content"))


@query
def provenance_complete(spark: SparkSession, folder: str) -> DataFrame:
    return _records(spark, folder).agg(F.count("*").alias("pages"), F.count_if(provenance.complete(F.col("frontmatter"))).alias("complete"))


@query
def export_flat(spark: SparkSession, folder: str) -> DataFrame:
    return provenance.flat_record(_records(spark, folder)).select("url", "raw_bytes", "markdown_chars", "redirect_chain", "bytes_sha256")


@query
def loader_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = provenance.loader_documents(_records(spark, folder), "pages")
    return rows.select(F.col("metadata.source").alias("source"), F.col("metadata.bytes_sha256").alias("bytes_sha256"), F.length("page_content").cast("bigint").alias("chars"))


@query
def yaml_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents written with front matter and read back."""
    rows = _records(spark, folder).withColumn("document", documents.rendered(F.col("frontmatter"), F.col("markdown")))
    return rows.select("page_id", (tables.markdown_body(F.col("document")) == F.col("markdown")).alias("round_trip"))


@query
def sign_verify(spark: SparkSession, folder: str) -> DataFrame:
    """Signed documents: verified with the right key, with a wrong one, and after a change."""
    import base64

    from ..operators import ed25519

    pem, key = ed25519.to_pem(SEED), base64.b64encode(ed25519.public_of(SEED)).decode()
    rows = _records(spark, folder).withColumn("document", documents.signed(documents.rendered(F.col("frontmatter"), F.col("markdown")), pem, SIGNED_AT))
    other = base64.b64encode(ed25519.public_of(bytes(32))).decode()
    return rows.select("page_id", documents.verified(F.col("document"), key)["ok"].alias("ok"), documents.verified(F.col("document"), other)["ok"].alias("ok_other"), documents.verified(F.concat("document", F.lit("x")), key)["ok"].alias("ok_changed"))


@query
def warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Records read back from archives of all pages."""
    raw = tables.captures(pages(spark, folder), fetched_at=FETCHED_AT).withColumn("raw_bytes", F.col("html").cast("binary"))

    found = warc.stored_records(warc.archives(raw)).where("record_type = 'response'")
    return found.select("target_uri", F.sha2("body", 256).alias("bytes_sha256"))


# --- sinks, written to the shared folder and read back


def _written(spark: SparkSession, name: str) -> str:
    from ..checkpoints import Steps

    return Steps(spark, name).root


@query
def sink_markdown_files(spark: SparkSession, folder: str) -> DataFrame:
    where = _written(spark, "markdown")
    rows = converted_pages(spark, folder)
    files.write_markdown(rows.select("url", F.col("markdown").alias("document")), where)
    return tables.stored_markdown(spark, where).select("file", F.sha2("document", 256).alias("document_sha256"))


@query
def sink_markdown_existing(spark: SparkSession, folder: str) -> DataFrame:
    """Files that are there stay: a second write of other text changes nothing but what is new."""
    where = _written(spark, "existing")
    rows = pages(spark, folder).select("page_id", "url", F.col("url").alias("document"))
    files.write_markdown(rows.where("page_id % 2 = 0"), where)
    files.write_markdown(rows.withColumn("document", F.lit("new")), where)
    return tables.stored_markdown(spark, where).select("file", "document")


def _exported(spark: SparkSession, folder: str, kind: str) -> str:
    rows = provenance.flat_record(_records(spark, folder)).select("url", "raw_bytes", "markdown_chars", "redirect_chain", "bytes_sha256")
    return files.export(rows, _written(spark, kind), kind)


@query
def sink_export_parquet(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(_exported(spark, folder, "parquet"))


@query
def sink_export_jsonl(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("url string, raw_bytes bigint, markdown_chars bigint, redirect_chain string, bytes_sha256 string").json(_exported(spark, folder, "jsonl"))


@query
def sink_export_json(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("url string, raw_bytes bigint, markdown_chars bigint, redirect_chain string, bytes_sha256 string").option("multiLine", True).json(_exported(spark, folder, "json"))


@query
def sink_store(spark: SparkSession, folder: str) -> DataFrame:
    """Each distinct body once, under its digest."""
    where = _written(spark, "store")
    rows = pages(spark, folder).select(F.sha2("html", 256).alias("bytes_sha256"), F.col("html").cast("binary").alias("raw_bytes"))
    files.write_store(rows.unionByName(rows), where)
    return tables.binary_documents(spark, where).select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length", F.sha2("content", 256).alias("bytes_sha256"))


@query
def sink_chunk_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """Chunk rows of each page, from the manifests beside its file."""
    where = _written(spark, "chunks")
    rows = converted_pages(spark, folder).select("url", "markdown", "content_hash")
    files.write_chunk_manifests(chunking.manifest(rows), where)
    found = spark.read.schema("doc_id string, content_hash string, chunk_id string, start bigint, `end` bigint").option("multiLine", True).json(where)
    return found.groupBy("doc_id", "content_hash").agg(F.min("start").alias("first"), F.count_if(F.col("start") == 0).alias("openings"))


@query
def sink_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Archive files read back through the data source."""
    where = _written(spark, "archive")
    files.write_archives(warc.archives(tables.captures(pages(spark, folder), fetched_at=FETCHED_AT).withColumn("raw_bytes", F.col("html").cast("binary"))), where)
    spark.dataSource.register(warc.WarcSource)
    rows = spark.read.format("warc").load(where).where("record_type = 'response'")
    return rows.select("target_uri", F.sha2("body", 256).alias("bytes_sha256"))


@query
def sink_llms_txt(spark: SparkSession, folder: str) -> DataFrame:
    """The index as it is streamed to a file."""
    where = f"{_written(spark, 'llms')}/llms.txt"
    rows = pages(spark, folder).select(F.col("page_id").alias("seq"), "url", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("Page "), F.col("page_id"))).otherwise("").alias("title"))
    jobs.write_llms_txt(rows, "example", where, "All pages.")
    return spark.read.text(where, wholetext=True).select(F.col("value").alias("content"))


@query
def url_list_file(spark: SparkSession, folder: str) -> DataFrame:
    """A list of addresses with comments and blank lines, read from files."""
    where = f"{_written(spark, 'urls')}/list"
    line = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("#"), F.col("url"))).when(F.col("page_id") % 7 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("url")))
    pages(spark, folder).select(line.alias("value")).write.text(where)
    return tables.url_list(spark, where)


# --- jobs


def _page_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Page records of all pages, some of them failed."""
    c = converted_pages(spark, folder)
    failed = F.col("page_id") % 11 == 10
    return c.select("page_id", "url", F.when(failed, F.lit(None)).when(F.col("page_id") % 13 == 12, 404).otherwise(200).cast("int").alias("status_code"), "raw_bytes", F.col("markdown_chars").cast("bigint").alias("markdown_chars"), text.retention(F.col("kept_chars"), F.col("source_chars")).alias("retention_ratio"), "low_content", F.when(F.col("page_id") % 4 == 0, "CC-BY").otherwise("").alias("license"), F.when(F.col("page_id") % 3 == 0, F.create_map(F.lit("training"), F.lit("Allow"))).otherwise(F.create_map().cast("map<string,string>")).alias("ai_txt"), (F.col("page_id") % 5 == 0).alias("llms_txt"), F.when(failed, "boom").alias("error"))


def _flat(card: DataFrame) -> DataFrame:
    return card.withColumn("licenses_seen", F.array_join("licenses_seen", ","))


@query
def data_card(spark: SparkSession, folder: str) -> DataFrame:
    return _flat(jobs.summary(_page_rows(spark, folder)))


@query
def data_card_by_host(spark: SparkSession, folder: str) -> DataFrame:
    rows = _page_rows(spark, folder).withColumn("host", urls.host(F.col("url")))
    return _flat(jobs.summary(rows, "host", digits=6))


@query
def scorecard(spark: SparkSession, folder: str) -> DataFrame:
    rows = _page_rows(spark, folder).select("url", "status_code", (F.col("page_id") % 7 * 10.0).alias("latency_ms"), "raw_bytes", "markdown_chars", (F.col("page_id") % 2 == 0).alias("provenance_complete"))
    return jobs.scorecard(rows)


@query
def scorecard_of_captures(spark: SparkSession, folder: str) -> DataFrame:
    rows = tables.captures(pages(spark, folder), fetched_at=FETCHED_AT).withColumns({"latency_ms": F.lit(12.0), "error": F.when(F.col("page_id") % 9 == 8, "boom")})
    return jobs.scorecard(bench.results(rows)).select("total", "successful", "success_rate", "avg_latency_ms", "provenance_complete")


def _job(spark: SparkSession, folder: str) -> DataFrame:
    stored = pages(spark, folder)
    again = stored.where("page_id % 8 = 0").select((F.col("page_id") + 1_000_000_000).alias("page_id"), F.concat("url", F.lit("&copy=1")).alias("url"), "html")
    rows = tables.captures(stored.unionByName(again), fetched_at=FETCHED_AT).withColumnRenamed("page_id", "seq")
    rows = rows.withColumn("error", F.when(F.col("seq") % 17 == 16, "boom"))
    return run(rows, JobOptions(source="example", policies=[{"name": "no-spanish", "deny_if": {"path": "/es/*"}}], user_agent="other"), manifest=dedup.latest_manifest(_manifest(spark, folder).drop("page_id")), consent_files=_host_files(spark, folder))


@query
def job_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return _job(spark, folder).select("seq", "outcome")


@query
def job_counters(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.run_counters(_job(spark, folder))


@query
def job_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest_rows(_job(spark, folder)).select("seq", "url", "file", "bytes_sha256", "status_code")


@query
def job_data_card(spark: SparkSession, folder: str) -> DataFrame:
    return jobs.summary(page_records(_job(spark, folder))).select("pages", "succeeded", "failed", "total_raw_bytes")


@query
def llms_txt(spark: SparkSession, folder: str) -> DataFrame:
    rows = pages(spark, folder).select(F.col("page_id").alias("seq"), "url", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("Page "), F.col("page_id"))).otherwise("").alias("title"))
    return jobs.llms_txt(rows, "example", "All pages.")


@query
def llms_full_blocks(spark: SparkSession, folder: str) -> DataFrame:
    rows = pages(spark, folder).select(F.col("page_id").alias("seq"), "url", F.lit("").alias("title"), F.col("html").alias("markdown"))
    return jobs.llms_blocks(rows).select("seq", F.length("block").cast("bigint").alias("chars"), F.sha2("block", 256).alias("block_sha256"))


@query
def context_sample(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select(F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".md")).alias("name"), "text")
    return jobs.context_sample(rows, 5, 10_000)


# --- crawl


def _edges(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """A site over the pages: page n links to 2n + 1, 2n + 2 and back to the first."""
    p = pages(spark, folder).select(F.col("page_id").alias("id"), F.concat(F.lit("p"), F.col("page_id")).alias("url"))
    to = F.explode(F.array(F.col("id") * 2 + 1, F.col("id") * 2 + 2, F.lit(0).cast("bigint")))
    edges = p.select(F.col("url").alias("src"), to.alias("n")).select("src", F.concat(F.lit("p"), F.col("n")).alias("dst"), F.col("n").alias("pos"))
    return edges, p.where("id % 9 <> 8").select("url")


@query
def crawl_bfs(spark: SparkSession, folder: str) -> DataFrame:
    edges, known = _edges(spark, folder)
    found = crawl(edges, known, spark.createDataFrame([("p0",)], "url string"), max_depth=4, max_pages=1_000_000)
    return found.visited.select("url", F.col("depth").cast("bigint").alias("depth"), "ok")


@query
def crawl_whole(spark: SparkSession, folder: str) -> DataFrame:
    """Every page that the links reach; neither depth nor pages are limited."""
    edges, known = _edges(spark, folder)
    found = crawl(edges, known, spark.createDataFrame([("p0",)], "url string"), max_depth=2**31 - 1, max_pages=2**62)
    return found.visited.select("url", F.col("depth").cast("bigint").alias("depth"), "ok")


@query
def crawl_limited(spark: SparkSession, folder: str) -> DataFrame:
    edges, known = _edges(spark, folder)
    found = crawl(edges, known, spark.createDataFrame([("p0",)], "url string"), max_depth=10, max_pages=20)
    return found.visited.where("ok").agg(F.count("*").alias("pages"), F.max("depth").cast("bigint").alias("deepest"))


@query
def sitemap_urls(spark: SparkSession, folder: str) -> DataFrame:
    loc = F.concat(F.lit("<url><loc>"), F.regexp_replace(F.col("url"), "&", "&amp;"), F.lit("</loc></url>"))
    body = F.concat(F.when(F.col("page_id") % 6 == 5, "<!DOCTYPE x>").when(F.col("page_id") % 6 == 4, "<broken>").otherwise(""), F.lit(f'<urlset xmlns="{tables.SITEMAP}">'), loc, loc, F.lit("</urlset>"))
    return tables.sitemap_urls(pages(spark, folder).select("page_id", body.alias("body"))).select("page_id", F.col("seq").cast("bigint").alias("seq"), "url")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Pages to documents with provenance: the whole capture plan in one row a page."""
    rows = _records(spark, folder)
    return rows.select("page_id", "frontmatter.url", "frontmatter.title", "frontmatter.language", "frontmatter.content_hash", "frontmatter.bytes_sha256", "retention_ratio", "low_content", F.length("markdown").alias("markdown_chars"), text.token_estimate(F.col("markdown")).alias("tokens"))

