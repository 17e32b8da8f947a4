"""ai.txt and robots.txt: directives of a host, and what they mean for a page."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .urls import netloc, origin, path, scheme

_DENY = "never no false deny disallow opt-out optout forbidden prohibited".split()
_ALLOW = "always yes true allow permitted opt-in optin".split()
MAX_CRAWL_DELAY_S = 60


def directive(value: Column) -> Column:
    """Allow, Deny, or the trimmed value itself."""
    plain = F.lower(F.trim(value))
    return F.when(plain.isin(_DENY), "Deny").when(plain.isin(_ALLOW), "Allow").otherwise(F.trim(value))


def summary(directives: Column) -> Column:
    """The directives that provenance keeps: training and data in standard form, allow and disallow as they are."""
    kept = F.map_filter(directives, lambda k, v: k.isin("training", "data", "allow", "disallow"))
    return F.transform_values(kept, lambda k, v: F.when(k.isin("training", "data"), directive(v)).otherwise(v))


def directives_of(text: str, user_agent: str) -> dict[str, str]:
    """The group of an ai.txt that a user agent belongs to: the longest name that is a token prefix of it, else ``*``."""
    group: dict[str, str] = {}
    groups = {"*": group}
    for line in map(str.strip, text.splitlines()):
        if not line or line[0] == "#":
            continue
        key, colon, value = line.partition(":")
        if colon and key.lower() == "user-agent":
            group = groups.setdefault(value.strip().lower() or "*", {})
        elif colon and (value := value.split("#", 1)[0].strip()):
            group[key.strip().lower()] = value
    agent = user_agent.lower()
    fitting = [g for g in groups if g and g != "*" and (agent == g or agent.startswith((f"{g}/", f"{g} ")))]
    return groups[max(fitting, key=len)] if fitting else groups["*"]


def parse_ai_txt(text: Column, user_agent: str) -> Column:
    """map<string, string> of the directives for ``user_agent``; null text has none."""

    @F.pandas_udf("map<string,string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: dict(directives_of(t, user_agent)) if t is not None else {})

    return run(text)


def host_consent(files: DataFrame, user_agent: str) -> DataFrame:
    """(scheme, netloc, ai_txt, llms_txt, retryable) per host from files (url, status_code, body) of the well-known paths.

    Only status 200 counts; 404 is a definite no, other failures may be asked for again.
    """
    named = files.withColumns({"scheme": scheme(F.col("url")), "netloc": netloc(F.col("url")), "file": path(F.col("url"))})
    good = F.col("status_code") == 200
    per_host = named.where(F.col("file").isin("/ai.txt", "/llms.txt")).groupBy("scheme", "netloc").agg(
        F.max_by(F.when(good & (F.col("file") == "/ai.txt"), F.col("body")), F.when(good & (F.col("file") == "/ai.txt"), 1).otherwise(0)).alias("ai_body"),
        F.max(good & (F.col("file") == "/llms.txt")).alias("llms_txt"),
        F.max(~good & (F.col("status_code") != 404) | F.col("status_code").isNull()).alias("retryable"),
    )
    return per_host.select("scheme", "netloc", summary(parse_ai_txt(F.col("ai_body"), user_agent)).alias("ai_txt"), "llms_txt", "retryable")


def with_consent(pages: DataFrame, files: DataFrame, user_agent: str, url: str = "url") -> DataFrame:
    """``pages`` with ai_txt and llms_txt of their host, or an llms.txt in the folder of the page."""
    hosts = host_consent(files, user_agent).select("scheme", "netloc", "ai_txt", F.col("llms_txt").alias("host_llms"))
    folders = files.where(F.col("status_code") == 200).select(scheme(F.col("url")).alias("scheme"), netloc(F.col("url")).alias("netloc"), F.regexp_extract(path(F.col("url")), "^(.+)/llms[.]txt$", 1).alias("folder")).where("folder <> ''").distinct().withColumn("folder_llms", F.lit(True))
    keyed = pages.withColumns({"scheme": scheme(F.col(url)), "netloc": netloc(F.col(url)), "folder": F.regexp_extract(path(F.col(url)), "^(.*)/[^/]*$", 1)})
    out = keyed.join(hosts, ["scheme", "netloc"], "left").join(folders, ["scheme", "netloc", "folder"], "left")
    return out.withColumn("llms_txt", F.coalesce("host_llms", F.lit(False)) | F.coalesce("folder_llms", F.lit(False))).drop("scheme", "netloc", "folder", "host_llms", "folder_llms")


def crawl_delay(robots: Column) -> Column:
    """Seconds of the first Crawl-delay line of a file, whatever its group."""
    return F.regexp_extract(robots, r"(?im)^[\s]*crawl-delay[\s]*:[\s]*([0-9]+(?:[.][0-9]+)?)", 1).try_cast("double")


def delay_ms(rate_limit_ms: Column, crawl_delay_s: Column) -> Column:
    """Pause between two requests to a host."""
    asked = F.least(F.coalesce(crawl_delay_s, F.lit(0.0)), F.lit(float(MAX_CRAWL_DELAY_S))) * 1000
    return F.greatest(rate_limit_ms.cast("double"), asked)


def robots_allowed(pages: DataFrame, robots: DataFrame, user_agent: str, url: str = "url") -> DataFrame:
    """``pages`` with robots_allowed; robots is (url, status_code, body), and anything but status 200 allows all.

    Pages meet the file of their origin in one join; each batch parses a file once.
    """

    @F.pandas_udf("boolean")
    def allowed(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        parsed: dict[str, RobotFileParser] = {}
        for urls, bodies in parts:
            out = []
            for u, body in zip(urls, bodies):
                if body is None or u is None:
                    out.append(True)
                    continue
                if body not in parsed:
                    if len(parsed) > 10_000:
                        parsed.clear()
                    parsed[body] = RobotFileParser()
                    parsed[body].parse(body.splitlines())
                out.append(parsed[body].can_fetch(user_agent, u))
            yield pd.Series(out, dtype=bool)

    files = robots.where(F.col("status_code") == 200).groupBy(origin(F.col("url")).alias("_origin")).agg(F.min("body").alias("_robots"))
    joined = pages.withColumn("_origin", origin(F.col(url))).join(files, "_origin", "left")
    return joined.withColumn("robots_allowed", allowed(F.col(url), F.col("_robots"))).drop("_origin", "_robots")


def robots_allow_chain(captures: DataFrame, robots: DataFrame, user_agent: str, chain: str = "redirect_chain") -> DataFrame:
    """``captures`` (redirect_chain) with robots_allowed: whether every hop is; a capture without hops is allowed.

    Chains are judged, not pages: one page may be reached by several of them.
    """
    hops = captures.select(F.explode(chain).alias("_hop")).distinct()
    denied = robots_allowed(hops, robots, user_agent, "_hop").where(~F.col("robots_allowed")).select("_hop")
    bad = captures.select(F.col(chain).alias("_chain"), F.explode(chain).alias("_hop")).join(denied, "_hop", "left_semi").select("_chain").distinct()
    judged = captures.join(bad.withColumn("_bad", F.lit(True)), F.col(chain) == F.col("_chain"), "left")
    return judged.withColumn("robots_allowed", F.col("_bad").isNull()).drop("_bad", "_chain")
