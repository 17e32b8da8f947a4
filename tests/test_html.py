import pytest

from capturelake.html.dom import parse
from capturelake.html.markdown import ConvertOptions, convert, tidy, visible_text
from capturelake.html.metadata import base_path, links, metadata, normalize_url
from capturelake.html.selectors import select

LONG = "Many words of real content stand in this paragraph. " * 6


def md(body, base=None, **options):
    return convert(f"<html><body><main>{body}<p>{LONG}</p></main>", base, ConvertOptions(**options)).markdown


@pytest.mark.parametrize(
    "html,fragment",
    [
        ("<h2>A <b>bold</b> <a href='/x'>head</a></h2>", "## A bold head\n"),
        ("<p>a<br>b</p><hr>", "a\nb\n\n---\n"),
        ("<p><strong> x </strong> and <em>y</em> <i></i></p>", "**x** and *y*"),
        ("<p>use <code>f(x)</code></p>", "use `f(x)`"),
        ("<pre><code class='hljs language-python'>a = 1\n</code></pre>", "```python\na = 1\n```"),
        ("<pre><code class='lang-js'>x</code></pre>", "```js\nx\n```"),
        ("<pre><code class='rust'>x</code></pre>", "```rust\nx\n```"),
        ("<pre> plain </pre>", "```\nplain\n```"),
        ("<ul><li>a</li><li></li><li>b<p>c</p></li></ul>", "- a\n- b\n  c"),
        ("<ol start=3><li>a</li><li></li><li>b</li></ol>", "3. a\n5. b"),
        ("<ol start=abc><li>a</li></ol>", "1. a"),
        ("<blockquote><p>a</p><p>b</p></blockquote>", "> a\n>\n>\n>\n> b\n"),
        ("<dl><dt>T</dt><dd>D</dd></dl>", "**T**\n: D"),
        ("<table><tr><td>only<td>row</table>", "| only | row |\n| ---- | --- |"),
        ("<table><thead><tr><th>A<th>B<tbody><tr><td>1<tr><td>1<td>2<td>3</table>", "| A | B |\n| --- | --- |\n| 1 |  |\n| 1 | 2 |"),
        ("<table><tr><td><p>line one<p>line two<td>a | b</table>", "line one<br>line two | a \\| b"),
        ("<table><thead><tr><th>H<tbody><tr><td>H<tr><td>x</table>", "| H |\n| --- |\n| x |"),
        ("<p>a &amp; b &lt;c&gt; &copy;</p>", "a & b <c> ©"),
        ("<p><b>open bold<br><p>next</p>", "**open bold**\n\nnext"),
        ("<h1>Quickstart<a class='headerlink' href='#quickstart'>#</a></h1>", "# Quickstart\n"),
        ("<h2>Install<a href='#install'>¶</a></h2>", "## Install\n"),
        ("<h3>Read <a href='#part'>the guide</a></h3>", "### Read the guide\n"),
    ],
)
def test_elements(html, fragment):
    assert fragment in md(html)


def test_links_and_images():
    out = md("<p><a href='/a?b=1'>x</a> <a href='#f'>y</a> <a href='javascript:z()'>z</a> <a href='/e'></a><img src='i.png' alt='I'><img src='data:x'></p>", "https://h.org/d/")
    assert "[x](https://h.org/a?b=1) y z ![I](https://h.org/d/i.png)" in out
    assert "data:" not in out and "[](" not in out
    assert "![" not in md("<img src='i.png'>", include_images=False)
    assert "[x](/a)" in md("<a href='/a'>x</a>", "https://h.org/", absolute_urls=False)


def test_boilerplate():
    out = convert(f"<html class='vector-toc'><head><title>t</title></head><body><nav>menu</nav><!-- secret --><div class='bd-sidebar-primary'>side</div><div class='toc'>toc</div><div class='research-content'>kept</div><p>{LONG}</p><footer>f</footer></body></html>")
    assert "kept" in out.markdown and not any(x in out.markdown for x in ("menu", "secret", "side\n", "toc", "\nf\n"))
    # head, nav, footer, and two classes
    assert out.stripped_elements == 5


@pytest.mark.parametrize("body", [f"<main><div class='cookie-api-docs'>{LONG}</div></main>", f"<section class='markdown-body'><p class='toc'>x</p>{LONG}</section>"])
def test_content_is_protected(body):
    assert "real content" in convert(f"<html><body>{body}</body></html>").markdown


def test_content_choice():
    two = f"<article>{LONG}<article>inner {LONG}</article></article><article>second {LONG}</article><article>short</article>"
    out = convert(f"<html><body><p>outside</p>{two}</body></html>").markdown
    assert "outside" not in out and out.count("inner") == 1 and "second" in out and "short" not in out
    assert "outside" in convert("<html><body><p>outside</p><main>short</main></body></html>").markdown


def test_sticky_header_clone():
    real = "<table><tr><th>N</th></tr><tr><td>1</td></tr></table>"
    out = md(f"<div class='pm-table-sticky-wrapper'><table><tr><th>N</th></tr></table></div>{real}")
    assert out.count("| N |") == 1
    assert md(f"<table><tr><th>Who<td>Bob</table>{real}").count("Bob") == 1


def test_measures():
    out = convert("<html><body><main>" + "main " * 90 + "</main><aside>" + "side " * 90 + "</aside></body></html>")
    assert 0.4 < out.retention_ratio < 0.6 and not out.low_content
    empty = convert("")
    assert (empty.markdown, empty.source_chars, empty.low_content) == ("", 0, True)
    assert visible_text("# A [l](u) ![i](s) **b** `c`\n```\ncode\n```\n| x |") == "A l b c x"
    assert tidy("\n\na  \n\n\n\nb\n") == "a\n\nb\n"


def test_metadata():
    page = parse("""<html lang=" en "><head><title>T &amp;amp; t</title><meta name="author" content="A"><meta property="og:site_name" content="S"><meta name="description" content=""><link rel="stylesheet license" href="/lic"></head><body>x</body></html>""")
    got = metadata(page)
    assert (got["title"], got["language"], got["author"], got["site_name"], got["description"], got["license"]) == ("T & t", "en", "A", "S", "", "/lic")
    og = metadata(parse('<meta property="og:title" content="O"><title>t</title><meta name="license" content="CC"><meta property="og:locale" content="de">'))
    assert (og["title"], og["license"], og["language"]) == ("O", "CC", "de")
    assert metadata(parse('<link rel="licenses" href="/no">'))["license"] == ""


def test_links_in_scope():
    page = parse('<nav><a href="guide">g</a></nav><a href="/docs/x/">x</a><a href="/other">o</a><a href="https://h.org/docs/a#f">a</a><a href="mailto:m">m</a><a href="/docs/p.pdf">p</a><a href="//e.org/docs/z">e</a><a href="/docsish">d</a><a href="?q=1">q</a>')
    assert links(page, "https://h.org/docs", "h.org", "/docs") == ["https://h.org/docs/guide", "https://h.org/docs/x", "https://h.org/docs/a", "https://h.org/docs?q=1"]
    assert links(parse('<a href="b.html">b</a>'), "https://h.org/v1.2/a.html", "h.org", "/v1.2") == ["https://h.org/v1.2/b.html"]


@pytest.mark.parametrize("url,want", [("https://a.b/", "https://a.b/"), ("https://a.b/x//", "https://a.b/x"), ("https://a.b/x/?q=1#f", "https://a.b/x?q=1"), ("//a.b/x", "https://a.b/x")])
def test_normalize(url, want):
    assert normalize_url(url) == want


@pytest.mark.parametrize("path,want", [("/docs/", "/docs"), ("/docs/a.html", "/docs"), ("/docs/a", "/docs/a"), ("/", ""), ("", "")])
def test_base_path(path, want):
    assert base_path(path) == want


def test_tolerant_tree():
    tree = parse("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table><p>x<div>y</div></b>z")
    assert [e.texts() for e in tree.all("li")] == ["a", "b"]
    assert [[c.texts() for c in r.all("td")] for r in tree.all("tr")] == [["1", "2"], ["3"]]
    assert not [e for e in tree.all("div") if e.up.tag == "p"]
    assert parse("<script>var t='</p>'</script>t").texts().strip() == "t"
    assert [e.attrs["id"] for e in select(parse('<div id=a class="x y"><p id=b data-k="v"></p></div><p id=c></p>'), "div.x > p, [data-k='v'], #c")] == ["b", "c"]


@pytest.mark.parametrize("text,want", [("a &amp", "a &amp"), ("a &am", "a &am"), ("a &copy 1 &copy;", "a &copy 1 ©"), ("&notit; &#65 &#x42;", "&notit; A B"), ("a & b", "a & b")])
def test_references_need_their_semicolon(text, want):
    page = parse(f"<title>{text}</title><body><p>{text}</p><a href='/x?a=1&copy=2&amp;b=3'>y</a>")
    assert page.first("p").texts() == metadata(page)["title"] == want
    assert page.first("a").attrs["href"] == "/x?a=1&copy=2&b=3"


def test_rendering_is_wanted_under_200_characters(spark):
    from capturelake.operators.capture import needs_render

    rows = [(n, "https://h.org/", f"<html><body><p>{'x' * n}</p></body></html>") for n in (199, 200)]
    got = needs_render(spark.createDataFrame(rows, "n int, url string, html string"), "auto").collect()
    assert {r.n: r.needs_render for r in got} == {199: True, 200: False}


@pytest.mark.parametrize("tag,attrs", [("script", ""), ("nav", ""), ("div", " class=toc"), ("div", " class=cookie-x")])
def test_many_stripped_siblings_are_linear(tag, attrs):
    import time

    def seconds(n):
        page = f"<html><body><p>kept</p>{f'<{tag}{attrs}></{tag}>' * n}</body></html>"
        began = time.process_time()
        out = convert(page)
        assert out.markdown == "kept\n" and out.stripped_elements == (0 if tag == "script" else n)
        return time.process_time() - began

    assert seconds(16_000) < 20 * max(seconds(2_000), 0.05)


def test_stripped_elements_inside_others_count_once():
    # in the order of the settings: nav goes with the button in it, a form goes before the footer around it; sidebar before toc
    page = "<nav><button></button><nav></nav></nav><footer><form></form></footer><div class='toc'><p class='sidebar'></p></div><div class='sidebar'><p class='toc'></p></div><p>kept</p>"
    assert convert(f"<html><body>{page}</body></html>").stripped_elements == 2 + 1 + 2 + 1
