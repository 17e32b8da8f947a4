"""From captured pages to converted ones: one Arrow UDF parses a page once for metadata, links and Markdown."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..batches import short_batches
from ..functions.hashing import bytes_hash, content_hash
from ..functions.text import bare
from ..html.dom import parse
from ..html.markdown import ConvertOptions, convert_tree
from ..html.metadata import FIELDS, base_path, links, metadata, normalize_url

_META = ", ".join(f"{f}: string" for f in FIELDS)
_COUNTS = "source_chars int, markdown_chars int, kept_chars int, stripped_elements int, retention_ratio double"
PAGE_TYPE = f"markdown string, {_COUNTS}, metadata struct<{_META}>, links array<string>"


def read_page(html: str, url: str | None, options: ConvertOptions, scope: tuple[str, str] | None = None) -> dict:
    """Markdown, counts, metadata and links of one page; ``scope`` is (domain, base path), by default the page's own site."""
    from urllib.parse import urlparse

    tree = parse(html)
    about = metadata(tree)
    try:
        found = links(tree, url, *(scope or (urlparse(url).netloc, ""))) if url else []
    except ValueError:
        found = []
    out = convert_tree(tree, url, options)
    return {"markdown": out.markdown, "source_chars": out.source_chars, "markdown_chars": out.markdown_chars, "kept_chars": out.kept_chars, "stripped_elements": out.stripped_elements, "retention_ratio": out.retention_ratio, "metadata": about, "links": found}


def page(html: Column, url: Column, options: ConvertOptions = ConvertOptions(), scope: tuple[str, str] | None = None) -> Column:
    @F.pandas_udf(PAGE_TYPE)
    def run(htmls: pd.Series, urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([read_page(h or "", u, options, scope) for h, u in zip(htmls, urls)], columns=["markdown", "source_chars", "markdown_chars", "kept_chars", "stripped_elements", "retention_ratio", "metadata", "links"])

    return run(html, url)




def converted(pages: DataFrame, html: str = "html", url: str = "url", options: ConvertOptions = ConvertOptions()) -> DataFrame:
    """``pages`` with markdown, its measures, metadata, links, content_hash, bytes_sha256, raw_bytes, low_content."""
    out = short_batches(pages).withColumn("_page", page(F.col(html), F.col(url), options))
    return out.select(
        *pages.columns,
        "_page.*",
        content_hash(F.col("_page.markdown")).alias("content_hash"),
        bytes_hash(F.col(html)).alias("bytes_sha256"),
        F.octet_length(html).cast("bigint").alias("raw_bytes"),
        (F.col("_page.markdown_chars") < 150).alias("low_content"),
    )


def fetch_and_convert(captures: DataFrame) -> DataFrame:
    """(url, markdown, content_hash, bytes_sha256, status_code, fetched_at): what a tool call returns for a page."""
    return converted(captures).select(F.coalesce("final_url", "url").alias("url"), "markdown", "content_hash", "bytes_sha256", "status_code", "fetched_at")


def links_in_scope(pages: DataFrame, start_url: str, html: str = "html", url: str = "url") -> DataFrame:
    """(url, seq, link): the links of each page that stay in the site part of ``start_url``."""
    from urllib.parse import urlparse

    u = urlparse(start_url)
    scope = (u.netloc, base_path(u.path))

    @F.pandas_udf("array<string>")
    def run(htmls: pd.Series, urls: pd.Series) -> pd.Series:
        return pd.Series([links(parse(h), p, *scope) if h and p else [] for h, p in zip(htmls, urls)], dtype=object)

    return pages.select(F.col(url).alias("url"), F.posexplode(run(F.col(html), F.col(url))).alias("seq", "link"))


def needs_render(pages: DataFrame, mode: str, html: str = "html", url: str = "url", options: ConvertOptions = ConvertOptions()) -> DataFrame:
    """``pages`` with needs_render: always, never, or (auto) where conversion gives under 200 characters, white space around them not counted."""
    if mode in ("always", "never"):
        return pages.withColumn("needs_render", F.lit(mode == "always"))
    if mode != "auto":
        raise ValueError(f"unknown render mode: {mode!r}")
    return pages.withColumn("needs_render", F.length(bare(page(F.col(html), F.col(url), options)["markdown"])) < 200)


__all__ = ["base_path", "converted", "links_in_scope", "needs_render", "normalize_url", "page", "read_page"]
