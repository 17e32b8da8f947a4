"""Hand-over of a folder of Markdown to an external vector index program."""

from __future__ import annotations

import re
import shutil
import subprocess
from collections.abc import Callable

TIMEOUT_S = 120


class IndexNotFound(Exception):
    """The program is not installed."""


class IndexFailed(Exception):
    """A command failed."""


def existing_name(output: str) -> str | None:
    """The collection that a message about an existing one names."""
    found = re.search(r"Name:\s+(\S+)", output)
    return found[1] if found else None


class VectorIndex:
    def __init__(self, binary: str = "vector-index", execute: Callable[[list[str]], tuple[int, str]] | None = None) -> None:
        self.binary = binary
        if execute is None and not shutil.which(binary):
            raise IndexNotFound(binary)
        self.execute = execute or self._execute

    @staticmethod
    def _execute(args: list[str]) -> tuple[int, str]:
        done = subprocess.run(args, capture_output=True, text=True, timeout=TIMEOUT_S)
        return done.returncode, done.stdout + done.stderr

    def _do(self, *args: str) -> str:
        code, output = self.execute([self.binary, *args])
        if code:
            raise IndexFailed(output.strip())
        return output

    def exists(self, name: str) -> bool:
        return name in self._do("collection", "list")

    def remove(self, name: str) -> None:
        self._do("collection", "remove", name)

    def add(self, folder: str, name: str, files: str = "**/*.md"):  # noqa: ANN201
        """Adds a collection; one that is there already, under whatever name, is replaced."""
        command = ("collection", "add", folder, "--name", name, "--mask", files)
        try:
            self._do(*command)
        except IndexFailed as e:
            if "already exists" not in str(e):
                raise
            self.remove(existing_name(str(e)) or name)
            self._do(*command)

    def describe(self, name: str, context: str) -> None:
        self._do("context", "add", f"{self.binary}://{name}", context)

    def embed(self) -> None:
        self._do("embed")

    def run(self, folder: str, name: str, context: str | None = None) -> None:
        self.add(folder, name)
        if context:
            self.describe(name, context)
        self.embed()
