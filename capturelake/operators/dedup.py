"""Exact duplicates and changes since an earlier run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_of_each(df: DataFrame, key: str, seq: str) -> DataFrame:
    """The row of the smallest ``seq`` of each key; one aggregation with partial minima, no sort of the rows."""
    whole = F.struct(*df.columns)
    return df.groupBy(key).agg(F.min_by(whole, F.col(seq)).alias("_row")).select("_row.*")


def marked(df: DataFrame, key: str, seq: str, seen: DataFrame | None = None) -> DataFrame:
    """``df`` with is_duplicate: the key is in ``seen`` or another row with a smaller ``seq`` has it.

    Only keys and minima are aggregated, and only keys that repeat (or were seen) are joined back: as long as those are few,
    the wide rows need no shuffle; a key that very many rows share meets them in a join that can be split.
    """
    first = df.groupBy(key).agg(F.min(seq).alias("_first"), F.count("*").alias("_n"))
    if seen is not None:
        first = first.join(seen.select(F.col(seen.columns[0]).alias(key)).distinct().withColumn("_seen", F.lit(True)), key, "left")
    else:
        first = first.withColumn("_seen", F.lit(None).cast("boolean"))
    first = first.where("_n > 1 OR _seen").drop("_n")
    out = df.join(first, key, "left")
    return out.withColumn("is_duplicate", F.coalesce("_seen", F.lit(False)) | F.coalesce(F.col(seq) > F.col("_first"), F.lit(False))).drop("_first", "_seen")


def unseen(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Rows whose key an earlier run has not stored."""
    return df.join(seen.select(key).distinct(), key, "left_anti")


def latest_manifest(manifest: DataFrame, order: str = "seq") -> DataFrame:
    """One row per url: of repeated entries the last."""
    return manifest.groupBy("url").agg(F.max_by(F.struct(*(c for c in manifest.columns if c != "url")), F.col(order)).alias("m")).select("url", "m.*")


def changes(captures: DataFrame, manifest: DataFrame, overwrite: bool = False) -> DataFrame:
    """``captures`` (url, status_code, bytes_sha256) with change: not_modified, unchanged, changed or new.

    manifest is (url, bytes_sha256[, file_exists]), one row per url.  Captures answered by 304 are not modified; equal bytes
    are unchanged if the stored file is there and is not to be overwritten.
    """
    exists = F.col("file_exists") if "file_exists" in manifest.columns else F.lit(True)
    old = manifest.select("url", F.col("bytes_sha256").alias("_old"), exists.alias("_there"))
    out = captures.join(old, "url", "left")
    same = (F.col("_old") == F.col("bytes_sha256")) & F.col("_there") & F.lit(not overwrite)
    change = F.when(F.col("status_code") == 304, "not_modified").when(same, "unchanged").when(F.col("_old").isNotNull(), "changed").otherwise("new")
    return out.withColumn("change", change).drop("_old", "_there")


def validators(captures: DataFrame, manifest: DataFrame) -> DataFrame:
    """``captures`` (url) with the request headers of a conditional fetch from the manifest's etag and last_modified."""
    known = manifest.select("url", F.map_filter(F.create_map(F.lit("If-None-Match"), F.col("etag"), F.lit("If-Modified-Since"), F.col("last_modified")), lambda k, v: F.coalesce(v != "", F.lit(False))).alias("request_headers"))
    return captures.join(known, "url", "left").withColumn("request_headers", F.coalesce("request_headers", F.create_map().cast("map<string,string>")))


def ranked(df: DataFrame, by: str, order: str) -> DataFrame:
    """``df`` with rank within ``by``."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(order)))
