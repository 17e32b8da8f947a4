"""Live captures: a batch of URLs to capture rows, politely and within limits."""

from __future__ import annotations

import http.client
import re
import socket
import ssl
import time
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import urljoin, urlsplit
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Fetching, utc_now
from ..functions.urls import host
from ..operators.plugins import Plugins
from .network import FetchError, RobotsDisallowed, public_addresses

CAPTURE_SCHEMA = (
    "url string, final_url string, status_code int, html string, fetched_at string, response_headers map<string,string>, raw_bytes binary, content_type string, "
    "redirect_chain array<string>, latency_ms double, error string, error_kind string"
)
MAX_RETRY_AFTER_S = 60


def next_delay(attempt: int, status: int | None, retry_after: str | None) -> float | None:
    """Seconds before the next attempt; None if there is none.  4xx is final but for 429, which says how long it wants."""
    if status == 429:
        return float(min(int(retry_after), MAX_RETRY_AFTER_S)) if retry_after and retry_after.strip().isdigit() else 1.0
    return None if status is not None and 400 <= status < 500 else float(2**attempt)


def origin_of(url: str) -> tuple[str, str, int]:
    u = urlsplit(url)
    return u.scheme.lower(), (u.hostname or "").lower(), u.port or (443 if u.scheme == "https" else 80)


def decode(body: bytes, content_type: str) -> str:
    name = re.search(r"charset=[\"']?([\w.:-]+)", content_type or "", re.IGNORECASE)
    try:
        return body.decode(name[1] if name else "utf-8", errors="replace")
    except LookupError:
        return body.decode("utf-8", errors="replace")


class _Pinned(http.client.HTTPConnection):
    """Dials an address that was checked, under the name that was asked for."""

    def __init__(self, name: str, port: int, address: str, timeout: float, tls: bool) -> None:
        super().__init__(name, port, timeout=timeout)
        self.address, self.tls = address, tls

    def connect(self) -> None:
        self.sock = socket.create_connection((self.address, self.port), self.timeout)
        if self.tls:
            self.sock = ssl.create_default_context().wrap_socket(self.sock, server_hostname=self.host)


class Fetcher:
    """One per task: a robots file per origin, a pause per host, retries, redirects and a limit on bodies."""

    def __init__(self, settings: Fetching, resolve: Callable[[str, int], list[str]] | None = None, sleep: Callable[[float], None] = time.sleep) -> None:
        self.settings, self.sleep = settings, sleep
        plain = lambda name, port: [name]
        self.resolve = resolve or (public_addresses if settings.block_private_networks else plain)
        self.robots: dict[tuple, tuple[RobotFileParser | None, float]] = {}
        self.last: dict[str, float] = {}

    def _once(self, url: str, headers: dict[str, str]) -> tuple[int, dict[str, str], bytes]:
        scheme, name, port = origin_of(url)
        if scheme not in ("http", "https") or not name:
            raise FetchError(f"not a web address: {url}")
        u, error = urlsplit(url), None
        for address in self.resolve(name, port):
            link = _Pinned(name, port, address, self.settings.timeout_s, scheme == "https")
            try:
                link.request("GET", (u.path or "/") + (f"?{u.query}" if u.query else ""), headers=headers)
                answer = link.getresponse()
                body = answer.read(self.settings.max_body_bytes + 1)
                if len(body) > self.settings.max_body_bytes:
                    raise FetchError(f"body over {self.settings.max_body_bytes} bytes")
                return answer.status, {k.lower(): v for k, v in answer.getheaders()}, body
            except OSError as e:
                error = e
            finally:
                link.close()
        raise error or FetchError(f"no address for {name}")

    def _rules(self, url: str) -> tuple[RobotFileParser | None, float]:
        key = origin_of(url)
        if key not in self.robots:
            self.robots[key] = (None, 0.0)
            try:
                status, _, body = self._once(urljoin(url, "/robots.txt"), {"User-Agent": self.settings.user_agent})
                if status == 200:
                    text = body.decode("utf-8", "replace")
                    rules = RobotFileParser()
                    rules.parse(text.splitlines())
                    delay = re.search(r"(?im)^[\s]*crawl-delay[\s]*:[\s]*([0-9]+(?:[.][0-9]+)?)", text)
                    self.robots[key] = (rules, min(float(delay[1]), 60.0) if delay else 0.0)
            except (OSError, FetchError):
                pass
        return self.robots[key]

    def _wait(self, url: str) -> None:
        name = origin_of(url)[1]
        pause = max(self.settings.rate_limit_ms / 1000, self._rules(url)[1] if self.settings.respect_robots else 0.0)
        left = self.last.get(name, -1e9) + pause - time.monotonic()
        if left > 0:
            self.sleep(left)
        self.last[name] = time.monotonic()

    def fetch(self, url: str, extra: dict[str, str] | None = None) -> dict:
        """A capture row; login and custom headers go to the origin asked for and to no other."""
        chain, now = [], url
        tries = 1 + self.settings.retries
        for attempt in range(tries):
            try:
                chain, now = [], url
                for _ in range(self.settings.max_redirects + 1):
                    if self.settings.respect_robots and (rules := self._rules(now)[0]) and not rules.can_fetch(self.settings.user_agent, now):
                        raise RobotsDisallowed(now)
                    self._wait(now)
                    own = origin_of(now) == origin_of(url)
                    headers = self.settings.effective_headers() | (extra or {}) if own else {"User-Agent": self.settings.user_agent}
                    status, got, body = self._once(now, headers)
                    chain.append(now)
                    if status in (301, 302, 303, 307, 308) and "location" in got:
                        now = urljoin(now, got["location"])
                        continue
                    break
                else:
                    raise FetchError("too many redirects")
            except OSError as e:
                status, got, body, error = None, {}, b"", e
            if status is not None and status < 400:
                at = utc_now()
                body = b"" if status == 304 else body
                kind = got.get("content-type", "")
                return {"url": url, "final_url": now, "status_code": status, "html": decode(body, kind), "fetched_at": at, "response_headers": got, "raw_bytes": body, "content_type": kind, "redirect_chain": chain}
            wait = next_delay(attempt, status, got.get("retry-after"))
            if wait is None or attempt + 1 == tries:
                raise FetchError(f"status {status}" if status is not None else str(error))
            self.sleep(wait)
        raise FetchError("no attempt made")


def capture(urls: DataFrame, settings: Fetching = Fetching(), plugins: Sequence[str] = ()) -> DataFrame:
    """Capture rows of urls (url[, request_headers]); hooks of ``plugins`` run before and after each fetch.

    Rows of a host go to one task in order, so that pauses hold across the cluster; a failure is a row with an error.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetcher, hooks = Fetcher(settings), Plugins(list(plugins))
        names = [c.split()[0] for c in CAPTURE_SCHEMA.split(", ")]
        for part in parts:
            rows = []
            for url, extra in zip(part["url"], part["request_headers"]):
                began = time.monotonic()
                try:
                    asked, headers = hooks.pre_fetch(url, dict(extra or {}))
                    row = hooks.post_fetch(fetcher.fetch(asked, headers or None) | {"url": url})
                except Exception as e:  # a page that fails must not end the job
                    row = {"url": url, "final_url": url, "error": str(e), "error_kind": type(e).__name__}
                rows.append(dict.fromkeys(names) | row | {"latency_ms": 1000 * (time.monotonic() - began)})
            yield pd.DataFrame(rows, columns=names, dtype=object)

    headers = F.col("request_headers") if "request_headers" in urls.columns else F.create_map().cast("map<string,string>")
    asked = urls.select("url", headers.alias("request_headers"), host(F.col("url")).alias("_host"))
    return asked.repartition("_host").sortWithinPartitions("_host", "url").select("url", "request_headers").mapInPandas(run, CAPTURE_SCHEMA)


