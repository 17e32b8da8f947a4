import hashlib

import pytest
from pyspark.sql import functions as F

from capturelake.functions import consent, hashing, policy, text, urls


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("r")).first()["r"]


def test_content_hash(spark):
    want = hashlib.sha256(b"a\n").hexdigest()
    assert one(spark, "a\n\n  ", hashing.content_hash) == want == one(spark, "a", hashing.content_hash)
    assert one(spark, "", hashing.content_hash) == hashlib.sha256(b"\n").hexdigest()


@pytest.mark.parametrize(
    "url,name",
    [("https://docs.a.org/", "docs.a.org"), ("https://a.org", "a.org"), ("https://a.org/x/y", "a.org-x-y-"), ("https://a.org/?q=1", "a.org-"), (r"https://example.com/a\..\..\evil", "example.com-a-..-..-evil-"), ("https://a.org:8080/x", "a.org-8080-x-")],
)
def test_file_names(spark, url, name):
    got = one(spark, url, urls.file_name)
    assert got == (name + digest(url)[:8] if name.endswith("-") else name)


@pytest.mark.parametrize("url,name", [("https://Docs.Example.com/", "docs-example-com"), ("https://a.org/Api/v2!", "a-org-api-v2"), ("https://a.org//", "a-org")])
def test_collections(spark, url, name):
    assert one(spark, url, urls.collection_name) == name


@pytest.mark.parametrize("a,b,same", [("https://a.org/x", "https://A.org:443/y", True), ("http://a.org", "https://a.org", False), ("http://a.org:8080", "http://a.org", False), ("https://a.org", "https://b.org", False)])
def test_same_origin(spark, a, b, same):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(urls.same_origin(F.col("a"), F.col("b"))).first()[0] is same


def test_url_functions_equal_those_of_the_tree(spark):
    from capturelake.html.metadata import base_path, normalize_url

    some = ["https://a.org/", "https://a.org/b//", "https://a.org/b/?q=1#f", "http://a.org", "https://a.org/b;p?q", "https://a.org/ü b/#x"]
    df = spark.createDataFrame([(u,) for u in some], "u string")
    assert [r[0] for r in df.select(urls.normalize(F.col("u"))).collect()] == [normalize_url(u) for u in some]
    paths = ["/a/b/", "/a/b.html", "/a", "/", "", "/v1.2/x", "//"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(urls.base_path(F.col("p"))).collect()] == [base_path(p) for p in paths]


def test_text_equals_its_python_form(spark):
    from capturelake.html.markdown import tidy, visible_text
    from capturelake.operators.chunking import estimate

    some = ["", "a b_c1 汉字", "# h\n\n\n\nx  \n\n **b** [l](u) ![i](s)\n```\nc\n```\n|a|b|\n", "\n\n x　\n", "wörd " * 9, "####### seven\n#\n> q ~"]
    df = spark.createDataFrame([(t,) for t in some], "t string").select("t", text.token_estimate(F.col("t")).alias("n"), text.visible_text(F.col("t")).alias("v"), text.tidy(F.col("t")).alias("c"))
    for r in df.collect():
        assert (r.n, r.v, r.c) == (estimate(r.t), visible_text(r.t), tidy(r.t)), r.t


def test_thinking(spark):
    assert one(spark, " <think>a\nb</think>x\n \n\ny ", text.without_thinking) == "x\n\ny"


def decide(spark, rules, url="https://a.org/x", license="", ai=None):
    df = spark.createDataFrame([(url, license, ai or {})], "u string, l string, a map<string,string>")
    return tuple(df.select(policy.Policy(rules).decide(F.col("u"), F.col("l"), F.col("a")).alias("d")).first()["d"])


def test_policy(spark):
    deny = dict(reason="nc", name="no-nc", deny_if=dict(license=["by-nd", "by-nc"]))
    assert decide(spark, [deny], license="CC BY-NC 4.0".replace(" ", "-")) == (False, "no-nc", "nc")
    assert decide(spark, [deny], license="CC BY 4.0") == (True, "", "")
    allow = {"name": "ok", "allow_if": {"license": "cc"}}
    assert decide(spark, [allow, deny], license="cc-by-nc") == (False, "no-nc", "nc")
    assert decide(spark, [allow], license="CC") == (True, "ok", "")
    admin = {"deny_if": {"path": "/admin/*"}}
    assert decide(spark, [admin], "https://a.org/admin/x/y") == (False, "deny", "blocked by policy")
    assert decide(spark, [admin], "https://a.org/Admin/x") == (True, "", "")
    gone = dict(deny_if=dict(ai_txt=dict(disallow=True)))
    for path, held in (("/private/a", False), ("/private", True)):
        assert decide(spark, [gone], f"https://a.org{path}", ai={"disallow": "/private/"})[0] is held
    assert decide(spark, policy.profile("strict-optout"), ai={"training": "deny"})[1] == "no-training-denied"
    assert decide(spark, policy.profile("open-only"), license="https://x.org/licenses/by-nc/4.0/")[0] is False
    assert decide(spark, policy.profile("default"), license="All Rights Reserved") == (True, "", "")
    for bad in ([{"name": "x"}], ["x"]):
        with pytest.raises(ValueError):
            policy.Policy(bad)
    with pytest.raises(ValueError):
        policy.profile("none")


@pytest.mark.parametrize(
    "body,agent,want",
    [
        ("Data: Deny # c\nTraining: Allow\n# x\nEmpty:\n", "lake/1", {"data": "Deny", "training": "Allow"}),
        ("User-Agent: *\nTraining: Deny\nUser-Agent: lake\nTraining: Allow\n", "Lake/2.0 x", {"training": "Allow"}),
        ("User-Agent: lake\nTraining: no\nUser-Agent: lake/2.0\nTraining: yes", "lake/2.0", {"training": "yes"}),
        ("User-Agent: l\nTraining: Deny", "lake/2.0", {}),
        ("User-Agent:\nTraining: Deny", "lake", {"training": "Deny"}),
        ("Training: Deny\nUser-Agent: lake\n", "lake", {}),
    ],
)
def test_ai_txt(body, agent, want):
    assert consent.directives_of(body, agent) == want


def test_consent_of_pages(spark):
    files = spark.createDataFrame([("https://a.org/ai.txt", 200, "Training: opt-out"), ("https://a.org/llms.txt", 404, ""), ("https://b.org/docs/llms.txt", 200, "x"), ("https://c.org/ai.txt", 503, "Training: no")], "url string, status_code int, body string")
    pages = spark.createDataFrame([(u,) for u in ("https://a.org/x", "https://b.org/docs/p", "https://b.org/p", "https://c.org/", "https://d.org/")], "url string")
    got = {r.url: (r.ai_txt or {}, r.llms_txt) for r in consent.with_consent(pages, files, "lake").collect()}
    assert got == {"https://a.org/x": ({"training": "Deny"}, False), "https://b.org/docs/p": ({}, True), "https://b.org/p": ({}, False), "https://c.org/": ({}, False), "https://d.org/": ({}, False)}
    hosts = {r.netloc: r.retryable for r in consent.host_consent(files, "lake").collect()}
    assert hosts == {"a.org": False, "c.org": True}


def test_robots(spark):
    robots = spark.createDataFrame([("https://a.org/robots.txt", 200, "User-agent: *\nDisallow: /blocked"), ("https://b.org/robots.txt", 500, "User-agent: *\nDisallow: /")], "url string, status_code int, body string")
    pages = spark.createDataFrame([(u,) for u in ("https://a.org/blocked/x", "https://a.org/ok", "https://b.org/x", "https://c.org/x")], "url string")
    assert {r.url[8:]: r.robots_allowed for r in consent.robots_allowed(pages, robots, "lake").collect()} == {"a.org/blocked/x": False, "a.org/ok": True, "b.org/x": True, "c.org/x": True}


def test_chains_of_one_page_are_judged_apart(spark):
    robots = spark.createDataFrame([("https://a.org/robots.txt", 200, "User-agent: *\nDisallow: /blocked")], "url string, status_code int, body string")
    rows = [(1, "https://a.org/x", ["https://a.org/blocked/s", "https://a.org/x"]), (2, "https://a.org/x", ["https://a.org/s", "https://a.org/x"]), (3, "https://a.org/x", []), (4, None, ["https://a.org/blocked/s"]), (5, "https://a.org/x", None)]
    captures = spark.createDataFrame(rows, "page_id int, url string, redirect_chain array<string>")
    got = consent.robots_allow_chain(captures, robots, "lake")
    assert {r.page_id: r.robots_allowed for r in got.collect()} == {1: False, 2: True, 3: True, 4: False, 5: True}
    assert got.columns == [*captures.columns, "robots_allowed"]


def test_rounding_goes_by_the_stored_double(spark):
    # 627 / 800 prints as 0.78375 and is stored as a little less
    made = spark.createDataFrame([(627, 800), (725, 928), (9, 8)], "kept int, source int")
    assert [r[0] for r in made.select(text.retention(F.col("kept"), F.col("source"))).collect()] == [0.7837, 0.7813, 1.0]
