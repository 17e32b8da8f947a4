"""Content addresses as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def body_text(markdown: Column) -> Column:
    """The hashed form of a body: no white space (of any script) at the end, then one line end."""
    return F.concat(F.regexp_replace(markdown, r"(?U)\s+\z", ""), F.lit("\n"))


def content_hash(markdown: Column) -> Column:
    return F.sha2(body_text(markdown), 256)


def bytes_hash(raw: Column) -> Column:
    return F.sha2(raw, 256)


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 8)
