"""URL filters: host and path rules, and association rules mined from labelled URLs.

``fitting_rule`` is the longest given rule that fits a URL's host and path.  For URLs that no rule fits, token sets
that go with a label are mined by FP-growth from URLs that have one: tokens are the labels of the host, the segments of
the path (digits written as one 0) and the names of the query's parameters.  Mined rules are pruned by support, by
confidence, and where a smaller token set predicts the same label at least as well.  They are matched by an inverted
index from token to rule: a rule applies to a URL that has as many of its tokens as it is long.

Distinct token sets are judged, not rows, so a URL that a third of all rows repeat is judged once.  The index is
broadcast while it has at most ``BROADCAST_ROWS`` rows and joined by a shuffle beyond that.

Defined results: a null URL, or one without ``://``, has an empty host and path and no tokens, so no rule fits and the
verdict is the default; of rules that apply, the most confident decides, block before allow among equals.  Rows that repeat
a URL or an id get one verdict each, the same for equal URLs; a long URL is read whole; other columns stay, whatever their
names, but for ``host``, ``path``, ``rule`` and ``verdict``, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, free_name, quoted

SUPPORT, CONFIDENCE = 0.02, 0.9
BROADCAST_ROWS = 10_000
REPEAT = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``site`` is host and path as one string; the rule fits the host, its subdomains, and all longer paths."""

    verdict: str
    site: str

    def fits(self, host: Column, path: Column) -> Column:
        name, _, rest = self.site.partition("/")
        return ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")


RULES = (Rule("block", "com/en/"), Rule("allow", "example.com/en/7"), Rule("allow", "net/de/"), Rule("block", "example.net/de/8"), Rule("block", "org/es/"))


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    longest = sorted(rules, key=lambda r: (-len(r.site), r.site))
    none = F.lit(None).cast("string")
    pick = lambda value: F.coalesce(*(F.when(r.fits(host, path), F.lit(value(r))) for r in longest), none)
    return pick(lambda r: r.site), pick(lambda r: r.verdict)


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Sorted distinct tokens of a URL."""
    labels = F.transform(F.split(host, r"\."), lambda t: F.concat(F.lit("h:"), t))
    segments = F.transform(F.split(path, "/"), lambda t: F.concat(F.lit("p:"), F.regexp_replace(t, "[0-9]+", "0")))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda t: F.concat(F.lit("q:"), F.regexp_extract(t, "^[^=]*", 0)))
    return F.sort_array(F.array_distinct(F.filter(F.concat(labels, segments, names), lambda t: F.length(t) > 2)))


def _grouped(sets: DataFrame) -> DataFrame:
    """(group, token): tokens that the same of ``sets`` (set_id, tokens) hold are one group, named by its first token."""
    own = sets.select("set_id", F.explode("tokens").alias("token"))
    # 128 bits of the sets that hold a token; a set stands in ``sets`` once
    held = own.groupBy("token").agg(F.bit_xor(F.xxhash64("set_id")).alias("x"), F.bit_xor(F.xxhash64("set_id", F.lit(1))).alias("y"), F.count("*").alias("n"))
    names = held.groupBy("x", "y", "n").agg(F.min("token").alias("group"))
    return held.join(names, ["x", "y", "n"]).select("group", "token")


def mine(scratch: Scratch, labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(rule_id, groups, label, confidence, support) from ``labelled`` (tokens, label[, rows]); pruned and numbered by content.

    A rule says that a URL with a token of each of its ``groups`` has ``label``.  FP-growth lists every subset of a frequent
    token set, so it is given fewer tokens, by two steps that change no rule that pruning leaves:

    * tokens that stand in exactly the same token sets are one group, since either gives the same rules;
    * a group that only ever goes with one label is a rule by itself, which prunes all longer ones that it is part of.
    """
    rows = F.sum("rows") if "rows" in labelled.columns else F.count("*")
    sets = scratch.save(labelled.groupBy("tokens", "label").agg(rows.alias("rows")).withColumn("set_id", F.monotonically_increasing_id()), "sets")
    n = sets.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    groups = scratch.save(_grouped(sets), "groups")
    members = groups.groupBy("group").agg(F.sort_array(F.collect_set("token")).alias("tokens"))
    # a group's first token stands for it
    in_sets = sets.select("set_id", "label", "rows", F.explode("tokens").alias("group")).join(groups.select("group").distinct(), "group")
    counted = in_sets.groupBy("group", "label").agg(F.sum("rows").alias("rows"))
    totals = counted.groupBy("group").agg(F.sum("rows").alias("n"), F.max("rows").alias("most"), F.max_by("label", "rows").alias("label"))
    totals = scratch.save(totals.where(F.col("n") >= F.lit(support) * F.lit(float(n))), "totals")
    pure = totals.where("n = most").select(F.array("group").alias("names"), "label", F.lit(1.0).alias("confidence"), (F.col("n") / n).alias("support"))
    mixed = in_sets.join(totals.where("n > most").select("group"), "group").groupBy("set_id").agg(F.collect_set("group").alias("names"))
    some = sets.select("set_id", "label", "rows").join(mixed, "set_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    # FP-growth takes rows, not counts; repeated in two steps, so that no array holds more than REPEAT of them
    some = some.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("rows") - 1) / REPEAT))))
    times = F.least(F.lit(REPEAT), F.col("rows") - F.col("part") * REPEAT).cast("int")
    items = some.select(F.explode(F.array_repeat(F.concat("names", F.array(F.concat(F.lit("y:"), F.col("label")))), times)).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    found = model.associationRules.where(F.col("consequent")[0].startswith("y:") & ~F.exists("antecedent", lambda t: t.startswith("y:")))
    rules = found.select(F.sort_array("antecedent").alias("names"), F.substring(F.col("consequent")[0], 3, 1000).alias("label"), "confidence", "support").unionByName(pure)
    rules = scratch.save(rules.withColumn("rule_id", F.monotonically_increasing_id()), "found")
    # a rule goes if one of its subsets, smaller by one, is as confident: chains of such steps end at the smallest
    less = rules.select("label", "confidence", F.explode(F.transform(F.sequence(F.lit(0), F.size("names") - 1), lambda i: F.filter("names", lambda t, k: k != i))).alias("names"), "rule_id")
    smaller = rules.select("names", "label", F.col("confidence").alias("other"))
    needless = less.join(smaller, ["names", "label"]).where("other >= confidence").select("rule_id").distinct()
    kept = rules.join(needless, "rule_id", "left_anti")
    parts = kept.select("rule_id", F.explode("names").alias("group")).join(members, "group").groupBy("rule_id").agg(F.sort_array(F.collect_list("tokens")).alias("groups"))
    return kept.join(parts, "rule_id").select(F.xxhash64("groups", "label").alias("rule_id"), "groups", "label", "confidence", "support")


def match(scratch: Scratch, sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(set_id, label) of the most confident rule that applies to each of ``sets`` (set_id, tokens)."""
    grouped = rules.select("rule_id", "label", "confidence", F.size("groups").alias("need"), F.posexplode("groups").alias("group", "tokens"))
    index = scratch.save(grouped.select("rule_id", "label", "confidence", "need", "group", F.explode("tokens").alias("token")), "index")
    if index.count() <= BROADCAST_ROWS:
        index = F.broadcast(index)
    hits = sets.select("set_id", F.explode("tokens").alias("token")).join(index, "token")
    parts = hits.groupBy("set_id", "rule_id", "group").agg(F.first("label").alias("label"), F.first("confidence").alias("confidence"), F.first("need").alias("need"))
    applied = parts.groupBy("set_id", "rule_id").agg(F.first("label").alias("label"), F.first("confidence").alias("confidence"), F.count("*").alias("n"), F.first("need").alias("need")).where("n = need")
    best = F.struct("confidence", (F.col("label") == "block").alias("blocks"), "label")
    return applied.groupBy("set_id").agg(F.max(best).alias("best")).select("set_id", F.col("best.label").alias("label"))


def judge(pages: DataFrame, url: str = "url", rules: tuple[Rule, ...] = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE, default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule, verdict (instead of columns of these names); where a rule fits, its verdict is also
    the label that is learnt from."""
    scratch = Scratch(pages.sparkSession, "urls")
    own = {"host", "path", "rule", "verdict"}
    address = F.col(quoted(url)).cast("string")
    place = {c: free_name(f"_{c}", pages.columns) for c in ("host", "path", "rule", "given", "set", "learnt")}
    located = pages.withColumns({place["host"]: host_of(address), place["path"]: path_of(address)})
    site, given = fitting_rule(F.col(quoted(place["host"])), F.col(quoted(place["path"])), rules)
    host, path = F.col(quoted(place["host"])), F.col(quoted(place["path"]))
    keyed = located.withColumns({place["rule"]: site, place["given"]: given, place["set"]: F.xxhash64(tokens_of(address, host, path))})
    named = keyed.select(tokens_of(address, host, path).alias("tokens"), F.col(quoted(place["given"])).alias("label"), F.col(quoted(place["set"])).alias("set_id"))
    seen = scratch.save(named.groupBy("set_id", "tokens", "label").agg(F.count("*").alias("rows")), "tokens")
    labelled = seen.where("label IS NOT NULL AND size(tokens) > 0").select("tokens", "label", "rows")
    unknown = seen.where("label IS NULL AND size(tokens) > 0").select("set_id", "tokens").dropDuplicates(["set_id"])
    if labelled.limit(1).count():
        mined = scratch.save(mine(scratch, labelled, support, confidence), "rules")
        learnt = scratch.save(match(scratch, unknown, mined), "learnt")
    else:
        learnt = unknown.select("set_id", F.lit(default).alias("label")).limit(0)
    out = keyed.join(learnt.select(F.col("set_id").alias(place["set"]), F.col("label").alias(place["learnt"])), place["set"], "left")
    last = {"host": host, "path": path, "rule": F.col(quoted(place["rule"])), "verdict": F.coalesce(F.col(quoted(place["given"])), F.col(quoted(place["learnt"])), F.lit(default))}
    return out.select(*(F.col(quoted(c)) for c in pages.columns if c.lower() not in own), *(c.alias(n) for n, c in last.items()))
