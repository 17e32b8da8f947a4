"""Provenance records: the front matter of a converted capture as a struct of nullable columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import GENERATOR
from ..functions.hashing import bytes_hash, content_hash

#: Front matter in its order; what is null is left out of a document.
CORE = tuple("title url fetched_at content_hash bytes_sha256 status_code generator".split())
REQUIRED = CORE[1:]
ABOUT = ("language", "author", "description", "site_name", "published_time", "modified_time", "license")


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def front_matter(df: DataFrame, extra: dict[str, str] | None = None) -> Column:
    """struct of the front matter of rows with capture columns, markdown, metadata, and whatever measures they have.

    Captures need url and markdown; final_url, fetched_at, status_code, raw_bytes (or html), response_headers,
    content_type, redirect_chain and render_* are used where there are such columns.  ``extra`` adds constants that never
    replace a field of the record.
    """
    have = set(df.columns)

    def col(name: str, kind: str = "string") -> Column:
        return F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)

    about = dict(df.dtypes).get("metadata", "")
    meta = {f: _filled(F.col(f"metadata.{f}")) if f"{f}:" in about else F.lit(None).cast("string") for f in ("title", *ABOUT)}
    raw = F.col("raw_bytes") if dict(df.dtypes).get("raw_bytes") == "binary" else col("html")
    header = (lambda k: _filled(F.try_element_at("response_headers", F.lit(k)))) if "response_headers" in have else (lambda k: F.lit(None).cast("string"))
    final = F.coalesce(_filled(col("final_url")), F.col("url"))
    rendered = _filled(col("render_engine"))
    fields: list[tuple[str, Column]] = [
        ("title", F.coalesce(meta["title"], F.lit(""))),
        ("url", final),
        ("fetched_at", col("fetched_at")),
        ("content_hash", content_hash(F.col("markdown"))),
        ("bytes_sha256", bytes_hash(raw)),
        ("status_code", col("status_code", "int")),
        ("generator", F.lit(GENERATOR)),
        *((f, meta[f]) for f in ABOUT),
        ("retention_ratio", col("retention_ratio", "double")),
        ("stripped_elements", F.when(col("stripped_elements", "int") != 0, col("stripped_elements", "int"))),
        ("low_content", F.when(col("low_content", "boolean"), F.lit(True))),
        ("ai_txt", F.when(F.size("ai_txt") > 0, F.col("ai_txt")) if "ai_txt" in have else F.lit(None).cast("map<string,string>")),
        ("llms_txt", F.when(col("llms_txt", "boolean"), F.lit(True))),
        ("policy_decision", F.when(F.col("policy_decision.rule") != "", F.col("policy_decision")) if "policy_decision" in have else F.lit(None).cast("struct<allowed:boolean,rule:string,reason:string>")),
        ("etag", header("etag")),
        ("last_modified", header("last-modified")),
        ("requested_url", F.when(final != F.col("url"), F.col("url"))),
        ("content_type", _filled(col("content_type"))),
        ("redirect_chain", F.when(F.size("redirect_chain") > 0, F.col("redirect_chain")) if "redirect_chain" in have else F.lit(None).cast("array<string>")),
        ("render_engine", rendered),
        *((f, F.when(rendered.isNotNull(), col(f))) for f in ("render_version", "render_timestamp")),
        ("js_executed", F.when(rendered.isNotNull(), col("js_executed", "boolean"))),
    ]
    names = {n for n, _ in fields}
    # a user's value fills a field that the record leaves empty, and never replaces one
    fields = [(n, F.coalesce(c.cast("string"), F.lit(str(extra[n]))) if extra and n in extra and n not in CORE and n in ABOUT else c) for n, c in fields]
    return F.struct(*(c.alias(n) for n, c in fields), *(F.lit(v).alias(k) for k, v in (extra or {}).items() if k not in names))


def complete(record: Column) -> Column:
    """Whether all required fields are there."""
    out = F.lit(True)
    for f in REQUIRED:
        out = out & record.getField(f).isNotNull()
    return out


def body_matches(body: Column, stored: Column) -> Column:
    """Hash-only verification of a body."""
    return F.sha2(body, 256) == stored


def flat_record(df: DataFrame, record: str = "frontmatter", markdown: str = "markdown") -> DataFrame:
    """Export rows: markdown, raw_bytes, markdown_chars and all front matter, nested values as JSON."""
    fields = df.schema[record].dataType.fields
    flat = [F.col(f"{record}.{f.name}").alias(f.name) if f.dataType.simpleString() in ("string", "int", "bigint", "double", "boolean") else F.to_json(F.col(f"{record}.{f.name}")).alias(f.name) for f in fields]
    return df.select(F.col(markdown).alias("markdown"), F.col("raw_bytes").cast("bigint").alias("raw_bytes"), F.length(markdown).cast("bigint").alias("markdown_chars"), *flat)


def loader_documents(df: DataFrame, shape: str) -> DataFrame:
    """Rows as retrieval frameworks load them: ``nodes`` (text, metadata) or ``pages`` (page_content, metadata)."""
    f = lambda n: F.col(f"frontmatter.{n}").alias(n)
    if shape == "nodes":
        return df.select(F.col("markdown").alias("text"), F.struct(f("url"), f("content_hash"), f("bytes_sha256"), f("status_code"), f("fetched_at")).alias("metadata"))
    if shape == "pages":
        return df.select(F.col("markdown").alias("page_content"), F.struct(F.col("frontmatter.url").alias("source"), f("content_hash"), f("bytes_sha256")).alias("metadata"))
    raise ValueError(f"unknown shape: {shape!r}")
