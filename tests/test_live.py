import http.server
import json
import threading

import pytest

from capturelake.cli import main
from capturelake.plans import live
from capturelake.sinks.files import load_checkpoint

LONG = "Words of real content stand in this paragraph. " * 8


@pytest.fixture
def site():
    """A start page with links to ten pages, some of which fail; each good one links to one more."""
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append((self.path, self.headers.get("X-Own"), self.headers.get("If-None-Match")))
            links = {"/docs": [f"/docs/p{k}" for k in range(10)], **{f"/docs/p{k}": [f"/docs/q{k}", "/docs"] for k in range(10)}}
            status, kind, extra = 200, "text/html", {"ETag": f'"{self.path}"'}
            body = f"<main><h1>{self.path}</h1><p>{LONG}</p>" + "".join(f"<a href='{x}'>{x}</a> " for x in links.get(self.path, [])) + "</main>"
            if self.path == "/ai.txt":
                body, kind, extra = "User-Agent: *\nDisallow: /docs/p2\n", "text/plain", {}
            elif not self.path.startswith("/docs") or self.path in ("/docs/p1", "/docs/p3", "/docs/p4") or self.path.endswith("llms.txt"):
                status = 404
            elif self.headers.get("If-None-Match") == f'"{self.path}"':
                status, body = 304, ""
            self.send_response(status)
            for k, v in ({"Content-Type": kind} | extra).items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *rest):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield "http://%s:%d" % server.server_address, asked
    server.shutdown()


def test_crawls_of_the_command_line(spark, site, tmp_path, capsys):
    base, asked = site
    out = tmp_path / "out"
    args = ["run", f"{base}/docs", "--all", "--allow-private-networks", "--no-robots", "--rate-limit-ms", "0", "--output", str(out), "--max-pages", "6", "--header", "X-Own: yes"]
    assert main(args) == 0
    # p1, p3 and p4 fail inside the level: the next of the level follow until there are six
    assert "failed 3" in (said := capsys.readouterr().out) and "saved 6" in said
    pages = [p for p, _, _ in asked if p.startswith("/docs/p") and not p.endswith(".txt")]
    assert sorted(pages) == sorted(f"/docs/p{k}" for k in range(8)) and all(own == "yes" for _, own, _ in asked)
    _, _, frontier, visited = load_checkpoint(str(out / live.STATE))
    assert len(visited) == 9 and [u.rsplit("/", 1)[1] for u, _ in frontier][:2] == ["p8", "p9"] and {d for _, d in frontier} == {1, 2}

    del asked[:]
    assert main([*args, "--resume"]) == 0 and "saved 6" in capsys.readouterr().out
    again = {p for p, _, _ in asked if p.startswith("/docs") and not p.endswith(".txt")}
    assert {"/docs/p8", "/docs/p9", "/docs/q0", "/docs/q2"} <= again and not again & set(pages)
    names = [r["url"] for r in json.loads((out / "_manifest.json").read_text())]
    assert len(names) == len(set(names)) == 12

    # a new run asks whether what it has is still so
    del asked[:]
    assert main(args) == 0 and "not_modified 1" in capsys.readouterr().out
    assert {tag for p, _, tag in asked if p == "/docs"} == {'"/docs"'}
    assert len(json.loads((out / "_manifest.json").read_text())) == 12

    # the site's ai.txt is asked for and counts
    assert main([*args, "--output", str(tmp_path / "two"), "--profile", "strict-optout", "--verbose"]) == 0
    said = capsys.readouterr().out
    assert f"blocked: {base}/docs/p2" in said and "saved 5" in said


def test_hooks_around_fetches(spark, site, tmp_path):
    from capturelake.config import Fetching
    from capturelake.sources.http import capture

    base, asked = site
    hook = tmp_path / "hooks.py"
    hook.write_text("def pre_fetch(url, headers):\n    return url.replace('start', 'docs'), {**headers, 'X-Own': 'hook'}\n\ndef post_fetch(row):\n    return {**row, 'html': row['html'].upper()}\n")
    row = capture(spark.createDataFrame([(f"{base}/start",)], "url string"), Fetching(rate_limit_ms=0, respect_robots=False, block_private_networks=False), [str(hook)]).first()
    assert row["url"] == f"{base}/start" and "WORDS OF REAL" in row["html"] and asked[0][:2] == ("/docs", "hook")


def test_rendered_pages_take_the_place_of_thin_ones(spark, tmp_path):
    from capturelake.config import Rendering

    program = tmp_path / "browser"
    program.write_text(f"#!/bin/sh\ncase $1 in fetch) echo '<main><p>{LONG}</p></main>';; *) echo 1.2;; esac\n")
    program.chmod(0o755)
    rows = spark.createDataFrame([("https://h.org/thin", "<p>x</p>", None), ("https://h.org/full", f"<main><p>{LONG}</p></main>", None), ("https://h.org/bad", None, "boom")], "url string, html string, error string")
    got = {r["url"][-4:]: r for r in live.with_rendering(rows, Rendering(binary=str(program)), "auto").collect()}
    assert LONG.strip() in got["thin"]["html"] and got["thin"]["render_version"] == "1.2" and got["full"]["render_engine"] is None and got["/bad"]["html"] is None
