"""Sources of offline captures, URL lists, sitemaps and stored Markdown."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SITEMAP = "/".join(("http://www.sitemaps.org", "schemas", "sitemap", "0.9"))


def captures(pages: DataFrame, url: str = "url", html: str = "html", fetched_at: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """A table of pages as capture rows: each was answered with status 200 at ``fetched_at``."""
    return pages.select(
        *(c for c in pages.columns if c not in (url, html)),
        F.col(url).alias("url"),
        F.col(url).alias("final_url"),
        F.lit(200).alias("status_code"),
        F.col(html).alias("html"),
        F.lit(fetched_at).alias("fetched_at"),
        F.create_map().cast("map<string,string>").alias("response_headers"),
        F.lit("text/html").alias("content_type"),
        F.array(F.col(url)).alias("redirect_chain"),
    )


def bodies(spark: SparkSession, path: str) -> DataFrame:
    """Just the pages' HTML: only that column is read."""
    return spark.read.parquet(path).select("html")


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """(url): one a line; blank lines and lines that begin with # are none."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#"))
    return lines.select(F.trim("value").alias("url")).where("url <> ''")


def locations(xml: bytes | str | None) -> list[str]:
    """The page locations of a sitemap; malformed ones, and any with a document type or entities, have none."""
    raw = xml.encode() if isinstance(xml, str) else xml or b""
    if b"<!DOCTYPE" in raw.upper() or b"<!ENTITY" in raw.upper():
        return []
    try:
        root = ET.fromstring(raw)
    except (ET.ParseError, ValueError):
        return []
    return [e.text for e in root.iterfind(f".//{{{SITEMAP}}}loc") if e.text]


def sitemap_urls(files: DataFrame, body: str = "body") -> DataFrame:
    """(seq, url) of each sitemap in a column of XML, with the other columns."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(locations)

    return files.select(*(c for c in files.columns if c != body), F.posexplode(run(F.col(body))).alias("seq", "url"))


def markdown_body(document: Column) -> Column:
    """The body of a stored document: behind a closed block of front matter, without blank lines in front."""
    bare = F.regexp_replace(document, r"(?s)\A---\n(?:(?!---[^\S\n]*(?:\n|\z)).*?\n)??---[^\S\n]*(?:\n|\z)", "")
    return F.when(document.startswith("---\n") & (bare != document), F.regexp_replace(bare, r"\A\n+", "")).otherwise(document)


def stored_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(file, document, body) of a folder of Markdown files."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("file"), F.col("value").alias("document"))
    return files.withColumn("body", markdown_body(F.col("document")))


def binary_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of PDF, office and image files for a converter that the user supplies."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")
