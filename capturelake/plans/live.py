"""Live jobs: breadth-first fetching with a state to resume from, conditional requests, well-known files, rendering."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import Steps
from ..config import Fetching, Rendering
from ..functions.urls import netloc, path, scheme
from ..operators import dedup
from ..operators.capture import links_in_scope, needs_render
from ..sinks.files import load_checkpoint, save_checkpoint
from ..sources.http import capture
from ..sources.render import rendered
from ..storage import exists, get, join

STATE = "_crawl.json"
MANIFEST = "_manifest.json"
_OLD = "url string, file string, title string, content_hash string, bytes_sha256 string, fetched_at string, status_code int, etag string, last_modified string, seq long"
Fetch = Callable[[DataFrame], DataFrame]


def crawl_live(spark: SparkSession, start: str, scope: str, fetch: Fetch, max_depth: int = 10, max_pages: int = 500, state: str | None = None, resume: bool = False) -> DataFrame:
    """Captures, with seq, of ``start`` and what is linked from it within ``scope``, until ``max_pages`` were fetched.

    ``fetch`` turns urls (url) into capture rows.  Pages of a level are fetched in the order in which their links were met, as
    many at a time as are still wanted; where some fail, the next ones of the level follow.  Only urls that were
    fetched count as seen.  ``state`` is a file that holds what was visited and what waits, written behind every batch;
    with ``resume`` the crawl goes on from it.  A page answered by 304 has no body and so leads nowhere.  What waits is as much as a live crawl of ``max_pages`` pages has met.
    """
    steps, waiting, visited = Steps(spark, "live"), [(start, 0)], []
    if resume and state:
        _, _, frontier, visited = load_checkpoint(state)
        # a crawl that was completed starts over
        waiting, visited = (frontier, visited) if frontier else (waiting, [])
    level = spark.createDataFrame([(u, d, k) for k, (u, d) in enumerate(waiting)], "url string, depth int, at long")
    seen = spark.createDataFrame([(u,) for u in visited], "url string")
    level = steps.save(level.join(seen, "url", "left_anti"), "level-0")
    rows, done, k = None, 0, 0
    while done < max_pages and level.limit(1).count():
        depth = level.agg(F.min("depth")).first()[0]
        # at most max_pages rows
        batch = steps.save(level.where(F.col("depth") == depth).orderBy("at").limit(max_pages - done), f"batch-{k}")
        order = batch.select("url", "depth", F.row_number().over(Window.orderBy("at")).alias("place"))
        got = fetch(batch.select("url")).join(order, "url").withColumn("seq", (F.lit(k) * (1 << 32) + F.col("place")).cast("long"))
        got = steps.save(got.drop("place"), f"captures-{k}")
        good = got.where("error IS NULL")
        done += good.count()
        rows = got if rows is None else rows.unionByName(got)
        seen = steps.save(seen.union(batch.select("url")).distinct(), f"seen-{k}")
        found = links_in_scope(good.where(F.col("depth") < max_depth), scope).join(good.select("url", F.col("seq").alias("by")), "url")
        found = found.groupBy(F.col("link").alias("url")).agg(F.min(F.struct("by", "seq")).alias("m"))
        fresh = found.join(level, "url", "left_anti").select("url", F.lit(depth + 1).cast("int").alias("depth"), (F.col("m.by") * (1 << 20) + F.col("m.seq")).alias("at"))
        level = steps.save(level.unionByName(fresh).join(seen, "url", "left_anti"), f"level-{k + 1}")
        k += 1
        if state:
            left = [(r["url"], r["depth"]) for r in level.orderBy("depth", "at").select("url", "depth").toLocalIterator()]
            save_checkpoint(state, [], [], left, [r["url"] for r in seen.toLocalIterator()])
    if rows is None:
        rows = fetch(spark.createDataFrame([], "url string")).withColumns({"depth": F.lit(0), "seq": F.lit(0).cast("long")})
    return rows.drop("depth")


def discovered(rows: DataFrame) -> DataFrame:
    return rows.orderBy("seq").select("url")


def old_manifest(spark: SparkSession, folder: str, existing: list[str]) -> DataFrame | None:
    """One row per url of the manifest that an earlier run left in ``folder``, with file_exists; None without any."""
    where = join(folder, MANIFEST)
    if not exists(where):
        return None
    # Spark takes names that begin with _ for hidden; one file that one run of a live job wrote is read as one
    found = [r for r in json.loads(get(where)) if r.get("url")]
    names = [c.split()[0] for c in _OLD.split(", ")]
    rows = spark.createDataFrame([tuple(r.get(n) for n in names) for r in found], _OLD)
    there = spark.createDataFrame([(n, True) for n in existing], "file string, _there boolean")
    old = dedup.latest_manifest(rows).join(there, "file", "left")
    return Steps(spark, "manifest").save(old.withColumn("file_exists", F.coalesce("_there", F.lit(False))).drop("_there"), "old")


def conditional(fetch: Callable[[DataFrame], DataFrame], manifest: DataFrame | None) -> Fetch:
    """``fetch`` with If-None-Match and If-Modified-Since for pages of the manifest whose file is still there."""
    if manifest is None:
        return fetch
    return lambda urls: fetch(dedup.validators(urls.select("url"), manifest.where("file_exists")))


def consent_files(pages: DataFrame, settings: Fetching, fetch: Callable[[DataFrame, Fetching], DataFrame] = capture) -> DataFrame:
    """(url, status_code, body) of the ai.txt and llms.txt of each origin of ``pages`` (url), and the llms.txt of their folders."""
    u = F.col("url")
    folder = F.regexp_extract(path(u), "^(.*)/[^/]*$", 1)
    places = F.array(F.lit("/ai.txt"), F.lit("/llms.txt"), F.concat(folder, F.lit("/llms.txt")))
    asked = pages.select(F.explode(F.transform(places, lambda p: F.concat(scheme(u), F.lit("://"), netloc(u), p))).alias("url")).distinct()
    got = fetch(asked, settings)
    status = F.coalesce("status_code", F.regexp_extract(F.coalesce("error", F.lit("")), r"^status (\d+)$", 1).try_cast("int"))
    return Steps(pages.sparkSession, "consent").save(got.select("url", status.alias("status_code"), F.col("html").alias("body")), "files")


def with_rendering(captures: DataFrame, settings: Rendering, mode: str) -> DataFrame:
    """``captures`` with the HTML of the renderer where ``mode`` (always, auto) asks for it; a page that fails keeps its own."""
    if mode == "never":
        return captures
    wanted = needs_render(captures.where("error IS NULL AND coalesce(html, '') <> ''"), mode)
    made = rendered(wanted, settings).where("js_executed").select("url", F.col("html").alias("_html"), "render_engine", "render_version", "render_timestamp")
    return captures.join(made, "url", "left").withColumn("html", F.coalesce("_html", "html")).drop("_html")
