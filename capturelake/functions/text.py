"""Text measures as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff]"
LOW_CONTENT_CHARS = 150


def token_estimate(text: Column) -> Column:
    """A quarter of each run of word characters, rounded up, and one for each CJK character; 1 at least."""
    runs = F.regexp_extract_all(text, F.lit("([A-Za-z0-9_]+)"), F.lit(1))
    quarters = F.aggregate(runs, F.lit(0).cast("bigint"), lambda n, r: n + F.floor((F.length(r) + 3) / 4))
    return F.greatest(F.lit(1).cast("bigint"), quarters + F.regexp_count(text, F.lit(CJK)))


def visible_text(markdown: Column) -> Column:
    """What a reader of Markdown sees, white space collapsed."""
    steps = [("(?s)```.*?```", " "), (r"!\[[^\]]*[\]][(][^)]*[)]", " "), (r"[\[]([^\]]*)[\]][(][^)]*[)]", "$1"), (r"(?m)^#{1,6}(?U:\s*)", ""), ("[*_`>~]", ""), (r"\|", " "), (r"(?U)\s+", " ")]
    for pattern, to in steps:
        markdown = F.regexp_replace(markdown, pattern, to)
    return F.trim(markdown)


def bare(text: Column) -> Column:
    """``text`` without white space at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def tidy(markdown: Column) -> Column:
    """At most one blank line, no white space at line ends, one line end at the end of what is not empty."""
    slim = F.regexp_replace(F.regexp_replace(markdown, "\n\n\n+", "\n\n"), r"(?U)[^\S\n]+(?=\n|\z)", "")
    held = bare(slim)
    return F.when(held == "", held).otherwise(F.concat(held, F.lit("\n")))


def rounded(value: Column, digits: int) -> Column:
    """The nearest number of so many digits to what is stored, as SQL engines and Python have it: 0.78375 is stored as less.

    ``F.round`` goes by the shortest decimal that a double prints as.
    """
    return F.round(value * F.lit(10.0**digits)) / F.lit(10.0**digits)


def retention(kept_chars: Column, source_chars: Column) -> Column:
    return rounded(F.least(F.lit(1.0), kept_chars / F.greatest(F.lit(1), source_chars)), 4)


def is_low_content(markdown_chars: Column) -> Column:
    return markdown_chars < LOW_CONTENT_CHARS


def without_thinking(text: Column) -> Column:
    """Model output without its <think> parts, blank lines collapsed."""
    said = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    return bare(F.regexp_replace(said, r"(?U)\n\s*\n+", "\n\n"))


def prompt(template: str, content: Column, model: str = "") -> Column:
    """A template with {content} filled in; models of the qwen family are told not to think aloud."""
    head, _, tail = template.partition("{content}")
    return F.concat(F.lit(head), content, F.lit(tail + (" /no_think" if "qwen" in model.lower() else "")))
