"""Page metadata and links, from the same tree."""

from __future__ import annotations

from html import unescape
from urllib.parse import urljoin, urlparse, urlunparse

from .dom import Element, decoded

ASSETS = tuple(f".{x}" for x in "pdf jpg jpeg png gif svg ico css js json xml zip tar gz mp3 mp4 webm woff woff2 ttf eot".split())
NOT_PAGES = ("tel:", "mailto:", "javascript:", "#")
FIELDS = ("title", "author", "language", "description", "site_name", "published_time", "modified_time", "license")


def metadata(root: Element) -> dict[str, str]:
    """FIELDS of an unmodified tree; what is missing is the empty string."""
    found: dict[str, list[Element]] = {"meta": [], "title": [], "html": [], "link": []}
    for e in root.below():
        if e.tag in found:
            found[e.tag].append(e)
    tags = found["meta"]

    def meta(key: str, value: str) -> str:
        tag = next((t for t in tags if t.attrs.get(key) == value), None)
        return unescape(tag.attrs["content"].strip()) if tag and tag.attrs.get("content") else ""

    title = meta("property", "og:title")
    if not title and found["title"]:
        title = decoded(found["title"][0].texts().strip())
    top = next(iter(found["html"]), None)
    link = next((x for x in found["link"] if "license" in (x.attrs.get("rel") or "").split()), None)
    return {
        "title": title,
        "author": meta("name", "author") or meta("property", "article:author") or meta("name", "dc.creator"),
        "language": (top.attrs.get("lang", "").strip() if top else "") or meta("property", "og:locale"),
        "description": meta("name", "description") or meta("property", "og:description"),
        "site_name": meta("property", "og:site_name"),
        "published_time": meta("property", "article:published_time"),
        "modified_time": meta("property", "article:modified_time"),
        "license": meta("name", "license") or meta("property", "og:license") or (link.attrs.get("href", "").strip() if link else ""),
    }


def normalize_url(url: str) -> str:
    """https where no scheme is given, no fragment, no slashes at the end of a path that has more."""
    u = urlparse(url)
    path = u.path if u.path == "/" else u.path.rstrip("/")
    return urlunparse((u.scheme or "https", u.netloc, path, u.params, u.query, ""))


def base_path(path: str) -> str:
    """The part of the site that a start path stands for: itself, or its folder if it names a file."""
    head, _, last = path.rpartition("/")
    return (head if "." in last else path) if last else path.rstrip("/")


def links(root: Element, page_url: str, domain: str, base: str) -> list[str]:
    """Links in scope, normalised, in document order, repeats kept."""
    page = urlparse(page_url)
    path = page.path
    if not path.endswith("/") and ("." not in path.rsplit("/", 1)[-1] or path == base):
        path += "/"
    against, found = urlunparse((page.scheme, page.netloc, path, "", "", "")), []
    for a in root.all("a"):
        href = a.attrs.get("href", "")
        if not href or href.startswith(NOT_PAGES):
            continue
        try:
            url = normalize_url(urljoin(against, href))
            u = urlparse(url)
        except ValueError:
            continue
        if u.netloc == domain and (u.path == base or u.path.startswith(f"{base}/")) and not u.path.lower().endswith(ASSETS):
            found.append(url)
    return found
