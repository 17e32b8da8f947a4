"""Jobs: captures of a site or a list to documents, each page with one outcome."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import Steps
from ..config import Settings
from ..functions.consent import with_consent
from ..functions.hashing import content_hash
from ..functions.policy import Policy
from ..functions.urls import file_name
from ..operators import chunking, dedup, jobs
from ..operators.capture import converted
from ..operators.documents import rendered, signed
from ..operators.plugins import Plugins
from ..operators.provenance import flat_record, front_matter
from ..sinks import files
from ..storage import join

OUTCOMES = ("failed", "not_modified", "unchanged", "duplicate", "blocked", "skipped", "saved")


@dataclass
class JobOptions:
    source: str = ""
    mode: str = "crawl"
    policies: list[dict] = field(default_factory=list)
    user_agent: str = "capturelake"
    extra: dict[str, str] = field(default_factory=dict)
    private_key: str = ""
    signed_at: str | None = None
    overwrite: bool = False


def _recorded(df: DataFrame, outcome: str) -> DataFrame:
    return df.withColumn("outcome", F.lit(outcome))


def run(captures: DataFrame, options: JobOptions, settings: Settings = Settings(), manifest: DataFrame | None = None, consent_files: DataFrame | None = None, seen: DataFrame | None = None, existing: DataFrame | None = None) -> DataFrame:
    """One row per capture with its outcome, and for those that are saved or blocked what was made of them.

    captures (url, final_url, status_code, html, fetched_at, response_headers, ..., seq[, error]) in order of seq; manifest (url,
    bytes_sha256, content_hash[, file_exists]) of the run before; consent_files (url, status_code, body) of well-known paths;
    seen (content_hash) of pages stored before; existing (file) of the target folder.

    The order of the decisions is: failed, answered by 304, unchanged bytes, empty, duplicate of an earlier page's Markdown
    (a blocked page still owns its hash), blocked by policy, file exists, saved.  Only pages past the third are parsed.
    """
    spark = captures.sparkSession
    steps, plugins = Steps(spark, "job"), Plugins(settings.plugins)
    have = set(captures.columns)
    rows = captures if "error" in have else captures.withColumn("error", F.lit(None).cast("string"))
    rows = rows.withColumn("bytes_sha256", F.sha2(F.col("html"), 256))
    old = manifest if manifest is not None else spark.createDataFrame([], "url string, bytes_sha256 string, content_hash string")
    known = dedup.changes(rows, old, options.overwrite)
    bad = (F.coalesce("error", F.lit("")) != "") | (F.coalesce("status_code", F.lit(0)) >= 400)

    early = known.where(bad | F.col("change").isin("not_modified", "unchanged"))
    early = early.withColumn("outcome", F.when(bad, "failed").when(F.col("change") == "not_modified", "not_modified").otherwise("unchanged"))
    early = early.join(old.select("url", F.col("content_hash")), "url", "left").drop("html")

    fresh = converted(known.where(~bad & ~F.col("change").isin("not_modified", "unchanged")).drop("bytes_sha256"), options=settings.converting)
    fresh = steps.save(fresh, "converted")
    empty = _recorded(fresh.where("markdown = ''"), "failed").withColumn("error", F.lit("empty conversion"))
    full = dedup.marked(fresh.where("markdown <> ''"), "content_hash", "seq", seen)
    copies = _recorded(full.where("is_duplicate"), "duplicate")

    single = full.where(~F.col("is_duplicate"))
    single = with_consent(single, consent_files, options.user_agent) if consent_files is not None else single.withColumns({"ai_txt": F.create_map().cast("map<string,string>"), "llms_txt": F.lit(False)})
    policy = Policy(options.policies)
    single = single.withColumn("policy_decision", policy.decide(F.col("url"), F.col("metadata.license"), F.coalesce("ai_txt", F.create_map().cast("map<string,string>"))))
    blocked = _recorded(single.where(~F.col("policy_decision.allowed")), "blocked").withColumn("error", F.concat(F.lit("policy: "), F.col("policy_decision.reason")))

    allowed = single.where(F.col("policy_decision.allowed")).withColumn("markdown", plugins.processed(F.col("markdown"), F.col("metadata")))
    allowed = allowed.withColumn("content_hash", content_hash(F.col("markdown"))).withColumn("file", F.concat(file_name(F.col("url")), F.lit(settings.output.extension)))
    if existing is not None and not options.overwrite:
        allowed = allowed.join(existing.select("file").distinct().withColumn("_there", F.lit(True)), "file", "left")
    else:
        allowed = allowed.withColumn("_there", F.lit(None).cast("boolean"))
    kept = allowed.withColumn("outcome", F.when(F.col("_there"), "skipped").otherwise("saved")).drop("_there")
    kept = kept.withColumn("frontmatter", front_matter(kept.drop("raw_bytes"), options.extra))
    document = rendered(F.col("frontmatter"), F.col("markdown")) if settings.output.frontmatter else F.col("markdown")
    kept = kept.withColumn("document", signed(document, options.private_key, options.signed_at) if options.private_key else document)

    out = early
    for part in (empty, copies, blocked, kept):
        out = out.unionByName(part.drop("is_duplicate", "change"), allowMissingColumns=True)
    return out.drop("change")


def page_records(results: DataFrame) -> DataFrame:
    """Data card rows: all but duplicates and files that were there; pages not fetched anew have no measures."""
    listed = results.where(~F.col("outcome").isin("duplicate", "skipped"))
    return listed.select(
        F.coalesce(F.when(F.col("final_url") != "", F.col("final_url")), F.col("url")).alias("url"),
        "status_code",
        F.coalesce("raw_bytes", F.lit(0)).cast("bigint").alias("raw_bytes"),
        F.coalesce("markdown_chars", F.lit(0)).cast("bigint").alias("markdown_chars"),
        "content_hash",
        "bytes_sha256",
        "retention_ratio",
        "stripped_elements",
        "low_content",
        F.col("metadata.license").alias("license"),
        "ai_txt",
        "llms_txt",
        "policy_decision",
        F.when(F.col("final_url") != F.col("url"), F.col("url")).alias("requested_url"),
        "error",
    )


def manifest_rows(results: DataFrame) -> DataFrame:
    """Rows that a later run compares with."""
    header = lambda k: F.try_element_at("response_headers", F.lit(k))
    return results.where("outcome = 'saved'").select("url", "file", F.col("metadata.title").alias("title"), "content_hash", "bytes_sha256", "fetched_at", "status_code", header("etag").alias("etag"), header("last-modified").alias("last_modified"), "seq")


def write(results: DataFrame, folder: str, options: JobOptions, settings: Settings = Settings(), export: str | None = None, llms: bool = False, manifest: DataFrame | None = None) -> dict[str, int]:
    """Writes a job's files to ``folder``; the counts by outcome.  Rows of an earlier ``manifest`` stay unless a page is saved anew."""
    steps = Steps(results.sparkSession, "write")
    done = steps.save(results, "results")
    saved = done.where("outcome = 'saved'")
    files.write_markdown(saved, folder, options.overwrite, settings.output.extension)
    if settings.output.chunk:
        files.write_chunk_manifests(chunking.manifest(saved), folder)
    if settings.output.warc:
        from ..sources.warc import archives

        raw = done.where(F.col("outcome").isin("saved", "skipped")).withColumn("raw_bytes", F.col("html").cast("binary"))
        files.write_archives(archives(raw), join(folder, "archive"))
        files.write_store(raw, join(folder, "store"))
    jobs.write_data_card(page_records(done), options.source, options.mode, join(folder, "data-card.json"))
    made = manifest_rows(done)
    if manifest is not None:
        kept = manifest.select(*(F.col(c) if c in manifest.columns else F.lit(None).alias(c) for c in made.columns)).join(made, "url", "left_anti")
        # what was there stands in front; saved pages go on behind it
        last = kept.agg(F.coalesce(F.max("seq") + 1, F.lit(0))).first()[0]
        made = kept.unionByName(made.withColumn("seq", F.col("seq") + last))
    files.write_json_array(made.orderBy("seq"), join(folder, "_manifest.json"))
    if export:
        files.export(flat_record(saved), folder, export)
    if llms:
        pages = saved.select("seq", "url", F.col("metadata.title").alias("title"), "markdown")
        jobs.write_llms_txt(pages, options.source, join(folder, "llms.txt"))
        jobs.write_llms_full(pages, join(folder, "llms-full.txt"))
    return {r["outcome"]: r["n"] for r in jobs.run_counters(done).collect()}
