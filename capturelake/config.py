"""Settings: dataclasses, a YAML file over them, ${NAME} from the environment."""

from __future__ import annotations

import base64
import datetime as dt
import os
import re
from dataclasses import dataclass, field, fields, is_dataclass, replace
from pathlib import Path
from typing import Any

import yaml

from .html.markdown import ConvertOptions

GENERATOR = "capturelake/1.0"


@dataclass(frozen=True)
class Auth:
    """How to log in; ``type`` is bearer, basic or header."""

    type: str = ""
    username: str = ""
    token: str = ""
    header_name: str = ""
    password: str = ""
    header_value: str = ""

    def headers(self):  # noqa: ANN201
        """The login as request headers; without what it needs, none."""
        login = ":".join((self.username, self.password)).encode()
        ways = {
            "header": (self.header_name, self.header_name, self.header_value),
            "basic": (self.username, "Authorization", f"Basic {base64.b64encode(login).decode()}"),
            "bearer": (self.token, "Authorization", f"Bearer {self.token}"),
        }
        needed, name, value = ways.get(self.type, ("", "", ""))
        return {name: value} if needed else {}


@dataclass(frozen=True)
class Fetching:
    user_agent: str = f"{GENERATOR} (+offline)"
    timeout_s: float = 30
    retries: int = 3
    rate_limit_ms: int = 500
    respect_robots: bool = True
    block_private_networks: bool = True
    max_body_bytes: int = 50 << 20
    max_redirects: int = 10
    auth: Auth = Auth()
    headers: dict[str, str] = field(default_factory=dict)

    def request_headers(self):  # noqa: ANN201
        """Custom headers, and those of the login over them."""
        return self.headers | self.auth.headers()

    def effective_headers(self):  # noqa: ANN201
        usual = {"Accept-Language": "en", "Accept": "text/html,*/*;q=0.5", "User-Agent": self.user_agent}
        return usual | self.request_headers()


@dataclass(frozen=True)
class Crawling:
    concurrent_requests: int = 5
    max_pages: int = 500
    max_depth: int = 10


@dataclass(frozen=True)
class Output:
    directory: str = "./"
    extension: str = ".md"
    frontmatter: bool = True
    overwrite: bool = False
    warc: bool = False
    chunk: bool = False


@dataclass(frozen=True)
class Sampling:
    """How much of a job's files goes into a context."""

    files: int = 5
    max_chars: int = 10_000


@dataclass(frozen=True)
class Rendering:
    enabled: bool = False
    auto: bool = False
    binary: str = ""
    timeout_s: float = 30


@dataclass(frozen=True)
class Settings:
    fetching: Fetching = Fetching()
    crawling: Crawling = Crawling()
    converting: ConvertOptions = ConvertOptions()
    output: Output = Output()
    sampling: Sampling = Sampling()
    rendering: Rendering = Rendering()
    policies: list[dict] = field(default_factory=list)
    plugins: list[str] = field(default_factory=list)


def utc_text(moment: dt.datetime) -> str:
    """A moment in UTC to the second, or to its microseconds if it has any."""
    text = moment.astimezone(dt.timezone.utc).isoformat(timespec="microseconds" if moment.microsecond else "seconds")
    return text.replace("+00:00", "Z")


def utc_now() -> str:
    return utc_text(dt.datetime.now(dt.timezone.utc).replace(microsecond=0))


def expand(value: Any) -> Any:
    """``${NAME}`` in all strings replaced by the environment's value, or nothing."""
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m[1], ""), value)
    if isinstance(value, dict):
        return {k: expand(v) for k, v in value.items()}
    return [expand(v) for v in value] if isinstance(value, list) else value


def _over(base: Any, given: dict) -> Any:
    known = {f.name: f for f in fields(base)}
    unknown = set(given) - set(known)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    changed = {}
    for name, value in given.items():
        now = getattr(base, name)
        changed[name] = _over(now, value or {}) if is_dataclass(now) else tuple(value) if isinstance(now, tuple) else value
    return replace(base, **changed)


def load(path: str | None = None) -> Settings:
    """Settings of a YAML file; plugin paths are relative to it."""
    if not path:
        return Settings()
    given = expand(yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {})
    made = _over(Settings(), given)
    return replace(made, plugins=[str(p if (p := Path(x)).is_absolute() else Path(path).resolve().parent / p) for x in made.plugins])
