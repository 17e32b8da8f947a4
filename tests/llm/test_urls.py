from itertools import combinations, product
from math import ceil

import pytest

from capturelake.llm import urls
from capturelake.llm.scratch import Scratch


def located(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:cut], rest[cut:]
    end = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:end]


def ruled(host, path):
    best = None
    for r in urls.RULES:
        name, _, rest = r.site.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(r.site) > len(best.site)):
            best = r
    return best


URLS = [
    None,
    "",
    "no scheme",
    "http://",
    "https://A.Example.COM/en/7x?q=1#f",
    "https://example.com/en/7",
    "https://example.com/EN/7",
    "http://notexample.com/en/8",
    "x://com/en/",
    "http://com/en",
    "https://a.net/de/1",
    "https://example.net/de/8/9",
    "https://b.example.net/de/9",
    "https://a.org/es/1",
    "https://a.org?x=/es/",
    "https://a.org#/es/",
    "https://ÄB.org/es/é",
    "http://a://b/c",
    "https://u@a.org:8080/es/1",
    "https://a.org/" + "p/" * 3000,
]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(k, u, "mine") for k, u in enumerate(URLS * 2)], "page_id int, url string, host string")
    got = urls.judge(df).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        host, path = located(r.url)
        rule = ruled(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule.site if rule else None), r.url
        assert r.verdict == rule.verdict if rule else r.verdict in ("allow", "block")
        if r.url in (None, "", "no scheme"):
            assert r.verdict == "allow"


def mined_by_hand(rows, support, confidence):
    n, items = len(rows), {t for tokens, _ in rows for t in tokens}
    need, found = ceil(n * support), {}
    for size in range(1, 4):
        for combo in combinations(sorted(items), size):
            have = [y for tokens, y in rows if set(combo) <= set(tokens)]
            for y in set(have):
                if have.count(y) >= need and have.count(y) / len(have) >= confidence:
                    found[combo, y] = have.count(y) / len(have)
    return {(c, y): p for (c, y), p in found.items() if not any(found.get((tuple(x for x in c if x != t), y), 0) >= p for t in c)}


@pytest.fixture
def labelled():
    rows = []
    for k in range(40):
        tokens = [t for t, d in (("a", 2), ("b", 3), ("c", 5)) if k % d == 0] + ["z"]
        rows.append((tokens, "block" if k % 6 == 0 else "allow"))
    return rows


def test_mined_rules_equal_all_subsets(spark, labelled):
    # tokens that always go together, and one that only goes with a label
    rows = [(t + ["a2"] * ("a" in t) + ["b2", "b3"] * ("b" in t) + ["only"] * (y == "block"), y) for t, y in labelled]
    for given in (labelled, rows):
        got = urls.mine(Scratch(spark, "t"), spark.createDataFrame(given, "tokens array<string>, label string"), 0.05, 0.8).collect()
        # rules of any length beyond those tried by hand are pruned by a shorter one here
        assert expanded(got) == pytest.approx(mined_by_hand(given, 0.05, 0.8))


def expanded(rules):
    return {(tuple(sorted(c)), r.label): r.confidence for r in rules for c in product(*r.groups)}


def test_counts_are_rows(spark, labelled, monkeypatch):
    monkeypatch.setattr(urls, "REPEAT", 3)
    rows = [(t, y, 1 + k % 8) for k, (t, y) in enumerate(labelled)]
    got = urls.mine(Scratch(spark, "t"), spark.createDataFrame(rows, "tokens array<string>, label string, rows long"), 0.05, 0.8).collect()
    assert expanded(got) == pytest.approx(mined_by_hand([(t, y) for t, y, n in rows for _ in range(n)], 0.05, 0.8))


def test_long_shared_urls_do_not_explode(spark):
    shared = [f"t{k}" for k in range(40)]
    rows = [(shared + [f"u{k % 7}"], "block" if k % 10 else "allow") for k in range(1000)] + [(["z", "t0"], "allow")] * 500
    got = urls.mine(Scratch(spark, "t"), spark.createDataFrame(rows, "tokens array<string>, label string"), 0.02, 0.85).collect()
    assert {("z",), ("t1",)} <= {c for (c, _) in expanded(got)} and ("t0",) not in {c for (c, _) in expanded(got)}
    long = [(k, f"https://a.org/es/{'/'.join(shared)}?{'&'.join(f'q{j}=1' for j in range(30))}") for k in range(200)]
    assert {r.verdict for r in urls.judge(spark.createDataFrame(long, "page_id long, url string")).collect()} == {"block"}


def test_clashing_names(spark):
    rows = [(k, u, *"abcdefg") for k, u in enumerate(URLS)]
    df = spark.createDataFrame(rows, "page_id int, url string, _set string, _learnt string, rule_verdict string, verdict string, _Host string, `a.b` string, set_id string")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    plain = {r.page_id: r for r in urls.judge(df.select("page_id", "url")).collect()}
    assert {k: (r.host, r.path, r.rule, r.verdict) for k, r in got.items()} == {k: (r.host, r.path, r.rule, r.verdict) for k, r in plain.items()}
    assert {(r["_set"], r["_learnt"], r["rule_verdict"], r["_Host"], r["a.b"], r["set_id"]) for r in got.values()} == {tuple("abcefg")}
    assert list(got[0].asDict()).count("verdict") == 1


def test_matching_equals_containment(spark, labelled, monkeypatch):
    rules = urls.mine(Scratch(spark, "t"), spark.createDataFrame([(t + ["a2"] * ("a" in t), y) for t, y in labelled], "tokens array<string>, label string"), 0.05, 0.7)
    plain = [(set(tokens), y, p) for (tokens, y), p in expanded(rules.collect()).items()]
    sets = [(k, sorted(t)) for k, t in enumerate([{"a"}, {"a2"}, {"a2", "b"}, {"a", "a2"}, {"a", "b"}, {"b", "c", "q"}, {"q"}, {"a", "b", "c", "z"}, {"z"}])]
    want = {}
    for k, t in sets:
        fits = [(c, y == "block", y) for s, y, c in plain if s <= set(t)]
        if fits:
            want[k] = max(fits)[2]
    df = spark.createDataFrame(sets, "set_id long, tokens array<string>")
    for rows in (10_000, 0):
        monkeypatch.setattr(urls, "BROADCAST_ROWS", rows)
        assert dict(urls.match(Scratch(spark, "t"), df, rules).collect()) == want


def test_no_pages(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
