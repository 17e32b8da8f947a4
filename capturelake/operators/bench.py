"""Scorecard of a list of URLs: capture, convert, provenance, figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Fetching
from ..sources.http import capture
from ..sources.tables import url_list
from .capture import converted
from .jobs import scorecard
from .provenance import complete, front_matter


def results(captures: DataFrame) -> DataFrame:
    """Scorecard rows of captures; those with an error have no status."""
    bad = F.coalesce("error", F.lit("")) != ""
    made = converted(captures.where(~bad).drop("raw_bytes"))
    good = made.withColumn("frontmatter", front_matter(made.drop("raw_bytes"))).select("url", "status_code", "latency_ms", "raw_bytes", F.col("markdown_chars").cast("bigint").alias("markdown_chars"), complete(F.col("frontmatter")).alias("provenance_complete"), F.lit(None).cast("string").alias("error"))
    none = captures.where(bad).select("url", F.lit(None).cast("int").alias("status_code"), "latency_ms", F.lit(0).cast("bigint").alias("raw_bytes"), F.lit(0).cast("bigint").alias("markdown_chars"), F.lit(False).alias("provenance_complete"), "error")
    return good.unionByName(none)


def run_list(spark: SparkSession, path: str, settings: Fetching = Fetching()) -> DataFrame:
    return scorecard(results(capture(url_list(spark, path), settings)))
