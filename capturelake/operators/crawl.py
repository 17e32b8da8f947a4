"""Breadth-first crawl over tables of links and captures: one round of joins per level."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import Steps


#: Visits of a level are numbered below 2^LEVEL_BITS.
LEVEL_BITS = 52


@dataclass
class CrawlResult:
    """visited (url, depth, seq, ok); frontier (url, depth) is what a limit left over."""

    visited: DataFrame
    frontier: DataFrame
    hit_limit: bool


def crawl(edges: DataFrame, captures: DataFrame, start: DataFrame, max_depth: int = 10, max_pages: int = 500, visited: DataFrame | None = None) -> CrawlResult:
    """Visits ``start`` (url[, depth]) and what is linked from it.

    edges (src, dst[, pos]) lead from page to page in order of ``pos``; a url without a row in captures (url) fails: it stays
    visited but does not count for ``max_pages``.  A page's links are followed while its depth is under ``max_depth``.  seq
    orders the visits: level by level, within a level by the order in which links were met.  ``visited`` (url) holds urls
    of an earlier run that are not to be visited again.
    """
    spark = edges.sparkSession
    steps = Steps(spark, "crawl")
    known = steps.save(captures.select("url").distinct(), "known").withColumn("ok", F.lit(True))
    links = edges.select("src", "dst", F.col("pos").cast("long").alias("pos") if "pos" in edges.columns else F.lit(0).cast("long").alias("pos"))
    depth = F.col("depth").cast("int") if "depth" in start.columns else F.lit(0)
    before = steps.save(visited.select("url").distinct(), "before") if visited is not None else None
    first = start.groupBy("url").agg(F.min(depth).alias("depth"))
    level = steps.save(_numbered(_without(first, before), ["depth", "url"]), "level-0")
    seen = None
    waiting, done, k = level.count(), 0, 0
    last = level
    while waiting and done < max_pages:
        ranked = level.join(known, "url", "left").select("url", "depth", (F.col("seq") + (k << LEVEL_BITS)).alias("seq"), F.coalesce("ok", F.lit(False)).alias("ok"))
        if done + waiting > max_pages:
            # the limit may fall into this level
            ranked = _running(ranked.withColumn("n", F.col("ok").cast("long"))).where(F.col("before") + done < max_pages).select("url", "depth", "seq", "ok")
        taken = steps.save(ranked, f"taken-{k}")
        done += taken.where("ok").count()
        last, seen = level, taken if seen is None else seen.unionByName(taken)
        k += 1
        found = taken.where(F.col("ok") & (F.col("depth") < max_depth)).join(links, F.col("url") == F.col("src"))
        found = found.groupBy(F.col("dst").alias("url")).agg(F.min(F.col("depth") + 1).alias("depth"), F.min(F.struct("seq", "pos")).alias("at"))
        fresh = _without(_without(found, seen), before)
        level = steps.save(_numbered(fresh, ["at", "url"]).select("url", "depth", "seq"), f"level-{k}")
        waiting = level.count()
    rest = last.select("url", "depth").unionByName(level.select("url", "depth")).groupBy("url").agg(F.min("depth").alias("depth"))
    seen = seen if seen is not None else spark.createDataFrame([], "url string, depth int, seq long, ok boolean")
    frontier = steps.save(_without(rest, seen), "frontier")
    return CrawlResult(seen, frontier, done >= max_pages and bool(frontier.limit(1).count()))


def _without(df: DataFrame, urls: DataFrame | None) -> DataFrame:
    return df if urls is None else df.join(urls.select("url"), "url", "left_anti")


def _numbered(df: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with seq, ascending in the order of ``by``; ranges are sorted on their own, and numbers leave gaps."""
    return df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("seq", F.monotonically_increasing_id()).drop("at")


def _running(df: DataFrame) -> DataFrame:
    """``df`` (seq, n) with before: the sum of n over smaller seq, by blocks of seq."""
    block = df.withColumn("_block", F.floor(F.col("seq") / 100_000))
    inner = block.withColumn("_in", F.coalesce(F.sum("n").over(Window.partitionBy("_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = block.groupBy("_block").agg(F.sum("n").alias("_n"))
    offsets = sums.withColumn("_off", F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_block", "_off")
    return inner.join(offsets, "_block").withColumn("before", F.col("_in") + F.col("_off")).drop("_block", "_in", "_off", "n")
