"""Aggregates of a job: data card, scorecard, run counters, and the sampled context of its files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import GENERATOR
from ..functions.text import rounded
from ..functions.urls import netloc
from ..storage import whole_file

SCHEMA_VERSION = "1.0"


def succeeded() -> Column:
    """No error, and no status of 400 and above; a missing status without an error is a success."""
    return (F.coalesce("error", F.lit("")) == "") & (F.coalesce("status_code", F.lit(0)) < 400)


def _given(pages: DataFrame) -> DataFrame:
    kinds = {"url": "string", "status_code": "int", "raw_bytes": "bigint", "markdown_chars": "bigint", "retention_ratio": "double", "low_content": "boolean", "license": "string", "ai_txt": "map<string,string>", "llms_txt": "boolean", "error": "string"}
    return pages.select("*", *(F.lit(None).cast(kind).alias(name) for name, kind in kinds.items() if name not in pages.columns))


def summary(pages: DataFrame, *by: str, digits: int = 4) -> DataFrame:
    """The figures of a data card over page records, for all or for each value of ``by``."""
    rows = _given(pages)
    ok, site = succeeded(), netloc(F.col("url"))
    ratio = F.col("retention_ratio")
    return rows.groupBy(*by).agg(
        F.count("*").alias("pages"),
        F.count_if(ok).alias("succeeded"),
        F.count_if(~ok).alias("failed"),
        F.coalesce(F.sum(F.coalesce("raw_bytes", F.lit(0))), F.lit(0)).cast("bigint").alias("total_raw_bytes"),
        F.coalesce(F.sum(F.coalesce("markdown_chars", F.lit(0))), F.lit(0)).cast("bigint").alias("total_markdown_chars"),
        rounded(F.min(ratio), 4).alias("retention_min"),
        rounded(F.max(ratio), 4).alias("retention_max"),
        rounded(F.avg(ratio), digits).alias("retention_avg"),
        F.sort_array(F.collect_set(F.when(F.col("license") != "", F.col("license")))).alias("licenses_seen"),
        F.count_distinct(F.when(F.size(F.coalesce("ai_txt", F.create_map().cast("map<string,string>"))) > 0, site)).alias("ai_txt_hosts"),
        F.count_distinct(F.when(F.col("llms_txt"), site)).alias("llms_txt_hosts"),
        F.count_if(F.coalesce("low_content", F.lit(False))).alias("low_content_pages"),
    )


def data_card(pages: DataFrame, source: str, mode: str) -> DataFrame:
    """One row of nested structs; pages themselves stay a table (``write_data_card`` adds them)."""
    s = summary(pages)
    return s.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.struct(F.lit(source).alias("source"), F.lit(mode).alias("mode"), F.lit(GENERATOR).alias("generator")).alias("job"),
        F.struct("pages", "succeeded", "failed", "total_raw_bytes", "total_markdown_chars", F.struct(F.col("retention_min").alias("min"), F.col("retention_max").alias("max"), F.col("retention_avg").alias("avg")).alias("retention_ratio")).alias("summary"),
        "licenses_seen",
        F.struct("ai_txt_hosts", "llms_txt_hosts", "low_content_pages").alias("compliance"),
    )


def write_data_card(pages: DataFrame, source: str, mode: str, path: str) -> None:
    """data-card.json: the card and its pages, which stream to the file a partition at a time."""
    card = data_card(pages, source, mode).first().asDict(recursive=True)
    with whole_file(path) as f:
        f.write((json.dumps(card, indent=2, ensure_ascii=False)[:-2] + ',\n  "pages": [').encode())
        for k, line in enumerate(pages.toJSON().toLocalIterator()):
            f.write(((",\n    " if k else "\n    ") + line).encode())
        f.write(b"\n  ]\n}\n")


def scorecard(results: DataFrame, *by: str) -> DataFrame:
    """Figures of a benchmark run over (url, status_code, latency_ms, raw_bytes, markdown_chars, provenance_complete)."""
    ok = F.col("status_code").isNotNull()
    return results.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(ok).alias("successful"),
        rounded(F.count_if(ok) / F.count("*"), 4).alias("success_rate"),
        rounded(F.avg(F.when(ok, F.col("latency_ms"))), 1).alias("avg_latency_ms"),
        rounded(F.avg(F.when(ok, F.col("markdown_chars") / F.greatest(F.lit(1), F.col("raw_bytes")))), 3).alias("avg_markdown_ratio"),
        F.count_if(ok & F.col("provenance_complete")).alias("provenance_complete"),
        F.floor(F.coalesce(F.sum(F.when(ok, F.col("markdown_chars"))), F.lit(0)) / 4).cast("bigint").alias("token_estimate"),
    )


def run_counters(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))


def exit_code(outcomes: DataFrame) -> int:
    """0 if anything was saved, skipped, a duplicate or unchanged."""
    return int(not outcomes.where(F.col("outcome").isin("saved", "skipped", "duplicate", "unchanged")).limit(1).count())


def context_sample(files: DataFrame, max_files: int = 5, max_chars: int = 10_000, name: str = "name", text: str = "text", order: str | None = None) -> DataFrame:
    """One row (content): the first files under headings, up to a number of characters that counts what was cut before."""
    total = files.count()
    # max_files rows
    first = files.orderBy(order or name).limit(max_files).withColumn("_k", F.row_number().over(Window.orderBy(order or name)))
    mark = "\n[... truncated ...]"
    # every file before the one that is cut counts in full, so the running sum of lengths gives the room
    upto = F.coalesce(F.sum(F.length(text)).over(Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = first.withColumn("_room", F.lit(max_chars) - upto).where("_room > 0")
    cut = F.when(F.length(text) > F.col("_room"), F.concat(F.substring(F.col(text), F.lit(1), F.col("_room").cast("int")), F.lit(mark))).otherwise(F.col(text))
    parts = room.select("_k", F.concat(F.lit("## File: "), F.col(name), F.lit("\n"), cut).alias("_part"), cut.alias("_text"))
    joined = parts.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_k", "_part"))), lambda x: x["_part"]), "\n\n").alias("all"), F.first("_text").alias("only"), F.count("*").alias("n"))
    note = "\n\n[Note: Showing %d of %d files]" % (max_files, total) if total > max_files else ""
    content = F.when(F.col("n") == 0, "No content available.").when((F.col("n") == 1) & F.lit(total == 1), F.regexp_replace("only", r"(?U)^\s+|\s+\z", "")).otherwise(F.concat("all", F.lit(note)))
    return joined.select(content.alias("content"))


def _entry() -> Column:
    title = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("url"))
    return F.concat(F.lit("- ["), title, F.lit("]("), F.col("url"), F.lit(")"))


def llms_txt(pages: DataFrame, site: str, tagline: str = "Pages of this site as Markdown.", order: str = "seq") -> DataFrame:
    """One row (content): the index of a site's pages in the order of ``seq``; a page without a title goes by its url.

    A row holds it whole, so this is for sites of a size that a model's context could take; files are written by
    ``write_llms_txt``.
    """
    listed = pages.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), _entry().alias("l")))), lambda x: x["l"]), "\n").alias("lines"))
    return listed.select(F.concat(F.regexp_replace(F.concat(F.lit(f"# {site}\n\n> {tagline}\n\n## Pages\n\n"), "lines"), r"(?U)\s+\z", ""), F.lit("\n")).alias("content"))


def llms_blocks(pages: DataFrame, order: str = "seq") -> DataFrame:
    """(seq, block): the parts of llms-full.txt; they are written in order, never gathered in one row."""
    title = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("url"))
    return pages.select(F.col(order).alias("seq"), F.concat(F.lit("# "), title, F.lit("\n\nSource: "), F.col("url"), F.lit("\n\n"), F.col("markdown")).alias("block"))


def write_llms_full(pages: DataFrame, path: str, order: str = "seq") -> None:
    """The parts in order, streamed partition by partition; white space at the end goes."""
    with whole_file(path) as f:
        held = ""
        for k, row in enumerate(llms_blocks(pages, order).orderBy("seq").toLocalIterator()):
            f.write((held if not k else held + "\n\n---\n\n").encode())
            held = row["block"]
        f.write((held.rstrip() + "\n").encode())


def write_llms_txt(pages: DataFrame, site: str, path: str, tagline: str = "Pages of this site as Markdown.", order: str = "seq") -> None:
    """``llms_txt`` as a file, streamed line by line: no row holds a site's pages."""
    head = f"# {site}\n\n> {tagline}\n\n## Pages\n\n"
    with whole_file(path) as f:
        held = ""
        for row in pages.select(F.col(order).alias("o"), _entry().alias("line")).orderBy("o").toLocalIterator():
            f.write((held or head).encode())
            held = ("\n" if held else "") + row["line"]
        f.write(((held or head).rstrip() + "\n").encode())
