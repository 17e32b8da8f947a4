"""URL functions as Column expressions, by the generic syntax of RFC 3986 (no parser that rejects what the web uses)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hashing import short_hash

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"
_UNSAFE = r"""[\x00-\x1f"*/:<>?\\|]"""


def _part(url: Column, n: int) -> Column:
    return F.regexp_extract(url, _PARTS, n)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def netloc(url: Column) -> Column:
    return _part(url, 2)


def raw_path(url: Column) -> Column:
    return _part(url, 3)


def path(url: Column) -> Column:
    """The path without parameters of its last segment."""
    return F.regexp_extract(raw_path(url), r"^((?:.*/)?[^/;]*)", 1)


def params(url: Column) -> Column:
    return F.regexp_extract(raw_path(url), r"^(?:.*/)?[^/;]*(;[^/]*)?$", 1)


def query(url: Column) -> Column:
    return _part(url, 4)


def host(url: Column) -> Column:
    """Lower-case host of the authority, without user and port."""
    return F.lower(F.regexp_extract(netloc(url), r"^(?:.*@)?(\[[^\]]*\]|[^:]*)", 1))


def port(url: Column) -> Column:
    """The effective port: the one given, else the scheme's."""
    given = F.regexp_extract(netloc(url), r":([0-9]+)$", 1)
    return F.when(given != "", given.cast("int")).when(scheme(url) == "https", 443).when(scheme(url) == "http", 80)


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), netloc(url))


def same_origin(a: Column, b: Column) -> Column:
    return (scheme(a) == scheme(b)) & (host(a) == host(b)) & port(a).eqNullSafe(port(b))


def normalize(url: Column) -> Column:
    """https where no scheme is given, no fragment, no slashes at the end of a longer path; parameters and query stay."""
    p, q = path(url), query(url)
    slim = F.when(p == "/", p).otherwise(F.regexp_replace(p, "/+$", ""))
    return F.concat(F.when(scheme(url) == "", "https").otherwise(scheme(url)), F.lit("://"), netloc(url), slim, params(url), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def base_path(p: Column) -> Column:
    """A path's folder if its last segment looks like a file, else the path itself without slashes at the end."""
    head = F.regexp_extract(p, r"^(.*)/[^/]*$", 1)
    return F.when(p.endswith("/"), F.regexp_replace(p, "/+$", "")).when(F.regexp_extract(p, r"([^/]*)$", 1).contains("."), head).otherwise(p)


def file_name(url: Column) -> Column:
    """A safe file name; everything but a bare host ends in a hash of the URL."""
    site = F.regexp_replace(netloc(url), _UNSAFE, "-")
    trimmed = F.regexp_replace(path(url), "^/+|/+$", "")
    slug = F.regexp_replace(trimmed, _UNSAFE, "-")
    named = F.when(trimmed != "", F.concat(site, F.lit("-"), slug)).otherwise(site)
    return F.when((trimmed == "") & (query(url) == ""), site).otherwise(F.concat(named, F.lit("-"), short_hash(url)))


def collection_name(url: Column) -> Column:
    trimmed = F.regexp_replace(path(url), "^/+|/+$", "")
    full = F.when(trimmed != "", F.concat(netloc(url), F.lit("/"), trimmed)).otherwise(netloc(url))
    return F.regexp_replace(F.regexp_replace(F.lower(full), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def scoped_headers(headers: Column, asked: Column, hop: Column, public: tuple[str, ...] = ("User-Agent", "Accept", "Accept-Language")) -> Column:
    """Headers for a hop of a redirect: all of them at the origin that was asked, else those that tell nothing."""
    return F.when(same_origin(asked, hop), headers).otherwise(F.map_filter(headers, lambda k, v: k.isin(*public)))
