"""Pages rendered by an external browser program; without one, or when it fails, the static HTML stays."""

from __future__ import annotations

import shutil
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Rendering, utc_now

RENDERED = "url string, html string, render_engine string, render_version string, render_timestamp string, js_executed boolean"


class RenderError(Exception):
    """The program is not there, failed, or gave nothing."""


class Renderer:
    def __init__(self, settings: Rendering) -> None:
        self.settings = settings
        self.version = ""

    def command(self, url: str) -> list[str]:
        return [self.settings.binary, "fetch", url, *"--dump html --wait-until networkidle0 --quiet".split()]

    def _run(self, args: list[str]) -> str:
        if not self.settings.binary or not shutil.which(self.settings.binary):
            raise RenderError(f"no such program: {self.settings.binary!r}")
        try:
            done = subprocess.run(args, capture_output=True, text=True, timeout=self.settings.timeout_s)
        except (OSError, subprocess.TimeoutExpired) as e:
            raise RenderError(str(e)) from e
        if done.returncode or not done.stdout.strip():
            raise RenderError(done.stderr.strip() or "no output")
        return done.stdout

    def render(self, url: str) -> dict:
        html = self._run(self.command(url))
        if not self.version:
            try:
                self.version = self._run([self.settings.binary, "--version"]).strip()
            except RenderError:
                self.version = "unknown"
        at = utc_now()
        return {"html": html, "render_engine": self.settings.binary.rsplit("/", 1)[-1], "render_version": self.version, "render_timestamp": at, "js_executed": True}


def rendered(pages: DataFrame, settings: Rendering) -> DataFrame:
    """RENDERED rows of pages (url, html, needs_render)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        renderer, names = Renderer(settings), [c.split()[0] for c in RENDERED.split(", ")]
        for part in parts:
            rows = []
            for url, html, wanted in zip(part["url"], part["html"], part["needs_render"]):
                row = dict.fromkeys(names) | {"url": url, "html": html, "js_executed": False}
                if wanted:
                    try:
                        row |= renderer.render(url)
                    except RenderError:
                        pass
                rows.append(row)
            yield pd.DataFrame(rows, columns=names, dtype=object)

    return pages.select("url", "html", F.coalesce("needs_render", F.lit(False)).alias("needs_render")).mapInPandas(run, RENDERED)
