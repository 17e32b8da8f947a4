import pytest

from capturelake.config import Rendering
from capturelake.sinks.index import IndexFailed, IndexNotFound, VectorIndex, existing_name
from capturelake.sources.render import Renderer, RenderError, rendered


def test_rendering(spark, tmp_path):
    program = tmp_path / "browser"
    program.write_text('#!/bin/sh\n[ "$1" = --version ] && echo 1.2 && exit\n[ "$2" = https://bad/ ] && exit 3\necho "<p>rendered $2</p>"\n')
    program.chmod(0o755)
    df = spark.createDataFrame([("https://a/", "<p>a</p>", True), ("https://bad/", "<p>b</p>", True), ("https://c/", "<p>c</p>", False)], "url string, html string, needs_render boolean")
    got = {r.url: r for r in rendered(df, Rendering(binary=str(program))).collect()}
    assert (got["https://a/"].html.strip(), got["https://a/"].render_version, got["https://a/"].js_executed) == ("<p>rendered https://a/</p>", "1.2", True)
    assert [(got[u].html, got[u].render_engine, got[u].js_executed) for u in ("https://bad/", "https://c/")] == [("<p>b</p>", None, False), ("<p>c</p>", None, False)]
    with pytest.raises(RenderError):
        Renderer(Rendering(binary="no-such-program")).render("https://a/")


def test_index_commands():
    calls, taken = [], ["docs"]

    def execute(args):
        calls.append(args[1:])
        if args[1:3] == ["collection", "add"] and taken:
            return 1, "Collection already exists\n  Name: docs (x)"
        if args[1:3] == ["collection", "remove"]:
            taken.remove(args[3])
        return 0, "docs-old, docs"

    index = VectorIndex("index", execute)
    index.run("out", "site", "about it")
    assert [c[:2] for c in calls] == [["collection", "add"], ["collection", "remove"], ["collection", "add"], ["context", "add"], ["embed"]]
    assert index.exists("docs") and not index.exists("else") and existing_name("none") is None
    with pytest.raises(IndexFailed):
        VectorIndex("index", lambda a: (1, "broken")).run("out", "x")
    with pytest.raises(IndexNotFound):
        VectorIndex("no-such-program")
