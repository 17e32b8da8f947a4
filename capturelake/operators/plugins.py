"""Hooks around a job: before and after capture, and on the Markdown.  None from a hook leaves its input as it is."""

from __future__ import annotations

import importlib.machinery
from collections.abc import Callable
from pathlib import Path
from types import ModuleType

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Plugins:
    """Modules, or paths of Python files, with any of pre_fetch(url, headers), post_fetch(row), post_process(markdown, metadata)."""

    def __init__(self, sources: list[str | ModuleType] | None = None) -> None:
        self.modules = [self._load(s) if isinstance(s, str) else s for s in sources or []]

    @staticmethod
    def _load(path: str) -> ModuleType:
        if not Path(path).is_file():
            raise FileNotFoundError(path)
        loader = importlib.machinery.SourceFileLoader(f"capturelake_plugin_{Path(path).stem}", path)
        made = ModuleType(loader.name)
        loader.exec_module(made)
        return made

    def _hooks(self, name: str) -> list[Callable]:
        return [h for m in self.modules if (h := getattr(m, name, None))]

    def pre_fetch(self, url: str, headers: dict[str, str]) -> tuple[str, dict[str, str]]:
        for hook in self._hooks("pre_fetch"):
            url, headers = hook(url, headers) or (url, headers)
        return url, headers

    def post_fetch(self, row: dict) -> dict:
        for hook in self._hooks("post_fetch"):
            row = hook(row) or row
        return row

    def post_process(self, markdown: str, about: dict) -> str:
        for hook in self._hooks("post_process"):
            changed = hook(markdown, about)
            markdown = markdown if changed is None else changed
        return markdown

    def processed(self, markdown: Column, metadata: Column) -> Column:
        """The Markdown column behind all post_process hooks; without any, the column itself."""
        if not self._hooks("post_process"):
            return markdown
        run_all = self.post_process

        @F.pandas_udf("string")
        def run(texts: pd.Series, about: pd.DataFrame) -> pd.Series:
            return pd.Series([run_all(t, m) if t is not None else None for t, m in zip(texts, about.to_dict("records"))], dtype=object)

        return run(markdown, metadata)


def then(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` through steps from table to table."""
    for step in steps:
        df = df.transform(step)
    return df
