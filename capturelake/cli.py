"""Command line: captures of pages, lists and sites, and the tools around signed documents."""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import replace
from urllib.parse import urlparse

import yaml

from .config import Auth, Settings, expand, load
from .functions.policy import PROFILES, profile


def extras(pairs: list[str]) -> dict[str, str]:
    """``KEY: VALUE`` pairs; values are YAML where they can be."""
    out = {}
    for pair in pairs:
        key, colon, value = pair.partition(":")
        if not colon or not key.strip():
            raise SystemExit(f"not KEY: VALUE: {pair!r}")
        try:
            out[key.strip()] = yaml.safe_load(value)
        except yaml.YAMLError:
            out[key.strip()] = value.strip()
    return out


def headers_of(pairs: list[str]) -> dict[str, str]:
    """``NAME: VALUE`` pairs; ${NAME} in values comes from the environment."""
    out = {}
    for pair in pairs:
        name, colon, value = pair.partition(":")
        if not colon or not name.strip():
            raise SystemExit(f"not NAME: VALUE: {pair!r}")
        out[name.strip()] = expand(value.strip())
    return out


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="capturelake", description="Captured web pages to Markdown with provenance.")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="capture a page, a list or a site")
    run.add_argument("url")
    run.add_argument("--all", action="store_true", help="follow links within the site")
    run.add_argument("--dry-run", action="store_true", help="list the pages of --all without converting them")
    run.add_argument("--sitemap", action="store_true", help="print the URLs of the site's sitemap")
    run.add_argument("--captures", help="Parquet of captures (url, html) instead of the network")
    run.add_argument("--output", default="./")
    run.add_argument("--config")
    run.add_argument("--profile", choices=sorted(PROFILES))
    run.add_argument("--frontmatter", action="append", default=[], metavar="KEY: VALUE")
    run.add_argument("--no-frontmatter", action="store_true")
    run.add_argument("--overwrite", action="store_true")
    run.add_argument("--max-depth", type=int)
    run.add_argument("--max-pages", type=int)
    run.add_argument("--rate-limit-ms", type=int)
    run.add_argument("--no-robots", action="store_true")
    run.add_argument("--allow-private-networks", action="store_true")
    run.add_argument("--warc", action="store_true")
    run.add_argument("--chunk", action="store_true")
    run.add_argument("--llms", action="store_true")
    run.add_argument("--export", choices=("json", "jsonl", "parquet"))
    run.add_argument("--sign", metavar="KEY", help="private key: a file; or set CAPTURELAKE_KEY or CAPTURELAKE_KEY_PEM", nargs="?", const="")
    run.add_argument("--header", action="append", default=[], metavar="NAME: VALUE", help="send with every request to the site")
    run.add_argument("--render", choices=("never", "auto", "always"), default="never", help="by the program of the settings: always, or where static HTML gives little text")
    run.add_argument("--resume", action="store_true", help="go on with the crawl whose state is in the output folder")
    run.add_argument("--no-consent", action="store_true", help="do not ask for ai.txt and llms.txt")
    run.add_argument("--index", metavar="PROGRAM", help="hand the output to a vector index program")
    run.add_argument("--quiet", action="store_true")
    run.add_argument("--verbose", action="store_true", help="print each page's outcome")
    run.add_argument("--auth", choices=("bearer", "basic", "header"), help="with CAPTURELAKE_TOKEN, CAPTURELAKE_USER and CAPTURELAKE_PASSWORD, or CAPTURELAKE_HEADER")
    sub.add_parser("keygen", help="print a new key pair")
    verify = sub.add_parser("verify", help="check a signed document")
    verify.add_argument("file")
    verify.add_argument("--public-key")
    bench = sub.add_parser("scorecard", help="capture a list of URLs and print its figures")
    bench.add_argument("--urls", required=True)
    return p


def auth_from_environment(kind: str) -> Auth:
    env = os.environ.get
    name, _, value = (env("CAPTURELAKE_HEADER") or "").partition(":")
    found = {"bearer": Auth("bearer", token=env("CAPTURELAKE_TOKEN", "")), "basic": Auth("basic", username=env("CAPTURELAKE_USER", ""), password=env("CAPTURELAKE_PASSWORD", "")), "header": Auth("header", header_name=name.strip(), header_value=value.strip())}[kind]
    if not found.headers():
        raise SystemExit(f"--auth {kind}: nothing set in the environment")
    return found


def signing_key(given: str) -> str:
    path = given or os.environ.get("CAPTURELAKE_KEY", "")
    if path:
        with open(path, encoding="utf-8") as f:
            return f.read()
    pem = os.environ.get("CAPTURELAKE_KEY_PEM", "")
    if not pem:
        raise SystemExit("--sign: no key given")
    return pem


def settings_of(a: argparse.Namespace) -> Settings:
    s = load(a.config)
    fetching = replace(s.fetching, **{k: v for k, v in {"rate_limit_ms": a.rate_limit_ms, "respect_robots": False if a.no_robots else None, "block_private_networks": False if a.allow_private_networks else None, "auth": auth_from_environment(a.auth) if a.auth else None, "headers": s.fetching.headers | headers_of(a.header) if a.header else None}.items() if v is not None})
    crawling = replace(s.crawling, **{k: v for k, v in {"max_depth": a.max_depth, "max_pages": a.max_pages}.items() if v is not None})
    output = replace(s.output, warc=a.warc or s.output.warc, chunk=a.chunk or s.output.chunk, frontmatter=s.output.frontmatter and not a.no_frontmatter, overwrite=a.overwrite or s.output.overwrite)
    return replace(s, fetching=fetching, crawling=crawling, output=output)


def run_job(a: argparse.Namespace) -> int:
    if a.dry_run and not a.all:
        raise SystemExit("--dry-run needs --all")
    if a.sign is not None and a.no_frontmatter:
        raise SystemExit("--sign needs front matter")
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .html.metadata import normalize_url
    from .operators.capture import links_in_scope
    from .operators.crawl import crawl
    from .plans import live
    from .plans.job import JobOptions, run, write
    from .sinks.files import existing_files
    from .sources.http import capture
    from .sources.tables import captures, locations
    from .storage import join

    settings = settings_of(a)
    if a.render != "never" and not settings.rendering.binary:
        raise SystemExit("--render needs the renderer's program in the settings")
    spark = SparkSession.builder.appName("capturelake").getOrCreate()
    start = normalize_url(a.url)
    there = existing_files(a.output)
    manifest = live.old_manifest(spark, a.output, there)
    fetch = live.conditional(lambda urls: capture(urls, settings.fetching, settings.plugins), None if a.overwrite else manifest)
    if a.sitemap:
        page = capture(spark.createDataFrame([(a.url if a.url.endswith(".xml") else f"{start.rstrip('/')}/sitemap.xml",)], "url string"), settings.fetching).first()
        print("\n".join(locations(page["html"])))
        return 0
    if a.captures:
        stored = captures(spark.read.parquet(a.captures))
        if a.all:
            edges = links_in_scope(stored, a.url).select(F.col("url").alias("src"), F.col("link").alias("dst"), F.col("seq").alias("pos"))
            found = crawl(edges, stored, spark.createDataFrame([(start,)], "url string"), settings.crawling.max_depth, settings.crawling.max_pages)
            rows = found.visited.select("url", "seq").join(stored, "url", "left").withColumn("error", F.when(F.col("html").isNull(), "no capture"))
        else:
            rows = stored.where(F.col("url") == a.url).withColumn("seq", F.lit(1).cast("long"))
    elif a.all:
        rows = live.crawl_live(spark, start, a.url, fetch, settings.crawling.max_depth, settings.crawling.max_pages, None if a.dry_run else join(a.output, live.STATE), a.resume)
    else:
        rows = fetch(spark.createDataFrame([(a.url,)], "url string")).withColumn("seq", F.lit(1).cast("long"))
    if a.dry_run:
        for r in live.discovered(rows).toLocalIterator():
            print(r["url"])
        return 0
    if a.render != "never":
        rows = live.with_rendering(rows, settings.rendering, a.render)
    consent = live.consent_files(rows.where("error IS NULL").select(F.coalesce("final_url", "url").alias("url")), settings.fetching) if not a.captures and not a.no_consent else None
    options = JobOptions(source=urlparse(a.url).netloc, mode="crawl" if a.all else "single", policies=profile(a.profile) if a.profile else settings.policies, user_agent=settings.fetching.user_agent, extra=extras(a.frontmatter), private_key=signing_key(a.sign) if a.sign is not None else "", overwrite=settings.output.overwrite)
    existing = spark.createDataFrame([(n,) for n in there], "file string")
    results = run(rows.drop("raw_bytes"), options, settings, manifest=manifest, consent_files=consent, existing=existing)
    counts = write(results, a.output, options, settings, a.export, a.llms, manifest)
    if a.verbose:
        for r in results.orderBy("seq").select("url", "outcome", "error").toLocalIterator():
            print(f"{r['outcome']}: {r['url']}" + (f" ({r['error']})" if r["error"] else ""))
    if not a.quiet:
        print(", ".join(f"{k} {v}" for k, v in sorted(counts.items())))
    if a.index:
        from .functions.urls import collection_name
        from .sinks.index import IndexFailed, IndexNotFound, VectorIndex

        try:
            name = spark.range(1).select(collection_name(F.lit(a.url))).first()[0]
            VectorIndex(a.index).run(a.output, name)
        except (IndexNotFound, IndexFailed) as e:
            print(f"index: {e}", file=sys.stderr)
    return int(not any(counts.get(k) for k in ("saved", "skipped", "duplicate", "unchanged", "not_modified")))


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "keygen":
        from .operators.ed25519 import new_keypair

        private, public = new_keypair()
        print(private + public)
        return 0
    if a.command == "verify":
        from .operators.documents import verify

        with open(a.file, encoding="utf-8") as f:
            good, why = verify(f.read(), a.public_key)
        print(why)
        return int(not good)
    if a.command == "scorecard":
        from pyspark.sql import SparkSession

        from .operators.bench import run_list

        run_list(SparkSession.builder.appName("capturelake").getOrCreate(), a.urls).show(truncate=False)
        return 0
    return run_job(a)


if __name__ == "__main__":
    try:
        sys.exit(main())
    except KeyboardInterrupt:
        sys.exit(130)
