"""Chunks of Markdown documents: sections by heading, long sections in overlapping token windows, exact spans."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..batches import short_batches

MAX_TOKENS, OVERLAP_TOKENS, MAX_CHARS, CHARS_PER_TOKEN = 512, 64, 2000, 4

_WORDS = re.compile("[A-Za-z0-9_]+")
_CJK = re.compile("[\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff]")
#: Long words in pieces of a multiple of four characters, which have as many tokens together.
_TOKEN = re.compile("[A-Za-z0-9_]{1,1024}" + f"|(?P<cjk>{_CJK.pattern})")
_HEADING = re.compile(r"(#{1,6})\s+(.*)")
_BREAK = re.compile(r"(?<=[?!.？！。])[\s]+|\n[\s]*\n")
_RUN = re.compile(r"\S+\s*")

CHUNK_TYPE = "array<struct<chunk_id: string, heading_path: array<string>, content: string, start: int, end: int, char_count: int, token_count: int>>"


def estimate(text: str) -> int:
    return max(1, sum((len(w) + 3) // 4 for w in _WORDS.findall(text)) + len(_CJK.findall(text)))


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    tokens: int


def _longest_prefix(text: str, start: int, end: int, limit: int) -> int:
    """End of the longest prefix of text[start:end] within ``limit`` tokens; one character at least.  Reads no further."""
    tokens = 0
    for m in _TOKEN.finditer(text, start, end):
        need = 1 if m["cjk"] else (m.end() - m.start() + 3) // 4
        if tokens + need > limit:
            # as much of a word as there is room for
            return max(start + 1, m.start() + (0 if m["cjk"] else CHARS_PER_TOKEN * (limit - tokens)))
        tokens += need
    return end


def _tail_start(text: str, start: int, end: int, limit: int) -> int:
    """Start of the longest suffix of text[start:end] within ``limit`` tokens and four characters for each."""
    if limit <= 0:
        return end
    lo, hi = max(start, end - limit * CHARS_PER_TOKEN), end
    while lo < hi:
        mid = (lo + hi) // 2
        if estimate(text[mid:end]) <= limit:
            hi = mid
        else:
            lo = mid + 1
    return lo


def _split_piece(text: str, start: int, end: int, limit: int) -> list[Span]:
    """A piece without sentence ends: whole runs where they fit, slices of a run that does not."""
    spans: list[Span] = []
    held, tokens, used = start, 0, False
    for m in _RUN.finditer(text, start, end):
        need = estimate(m[0])
        if used and (need > limit or tokens + need > limit):
            spans.append(Span(held, m.start(), tokens))
            tokens, used, held = 0, False, m.start()
        if need > limit:
            at = m.start()
            while at < m.end():
                to = _longest_prefix(text, at, m.end(), limit)
                spans.append(Span(at, to, estimate(text[at:to])))
                at = to
            held = m.end()
        else:
            tokens, used = tokens + need, True
    if used:
        spans.append(Span(held, end, tokens))
    return spans


def _windows(text: str, start: int, end: int, limit: int, overlap: int) -> list[Span]:
    """Sentences and paragraphs packed greedily; a window begins with the tail of the one before it."""
    cuts = [start, *(m.end() for m in _BREAK.finditer(text[start:end])), end - start]
    pieces = [(a, b) for a, b in zip([start, *(start + c for c in cuts[1:-1])], [*(start + c for c in cuts[1:-1]), end]) if text[a:b].strip()]
    spans: list[Span] = []
    held, to, tokens, used = start, start, 0, False
    for a, b in pieces:
        need = estimate(text[a:b])
        if need > limit:
            if used:
                spans.append(Span(held, to, tokens))
            spans.extend(_split_piece(text, a, b, limit))
            held, to, tokens, used = b, b, 0, False
            continue
        if used and tokens + need > limit:
            spans.append(Span(held, to, tokens))
            tail = _tail_start(text, held, to, min(overlap, max(0, limit - need)))
            # an empty tail still counts as one token
            tokens, used, held = estimate(text[tail:to]), tail < to, tail
        if not used:
            held = a
        to, tokens, used = b, tokens + need, True
    if used:
        spans.append(Span(held, to, tokens))
    return spans


def sections(markdown: str) -> list[tuple[list[str], int, int]]:
    """(heading path, start, end) from each heading to the next; lines inside code fences are no headings."""
    lines, offsets, at = markdown.split("\n"), [], 0
    for line in lines:
        offsets.append(at)
        at += len(line) + 1
    heads: list[tuple[int, int, str]] = []
    fence = ""
    for k, line in enumerate(lines):
        bare = line.strip()
        if fence:
            fence = "" if bare.startswith(fence) else fence
        elif bare.startswith(("```", "~~~")):
            fence = bare[:3]
        elif m := _HEADING.match(line):
            heads.append((k, len(m[1]), m[2].strip()))

    def span(first: int, after: int) -> tuple[int, int]:
        return offsets[first], offsets[after - 1] + len(lines[after - 1])

    out = []
    first = heads[0][0] if heads else len(lines)
    if first and "\n".join(lines[:first]).strip():
        out.append(([], *span(0, first)))
    path: list[tuple[int, str]] = []
    for (k, level, title), after in zip(heads, [*(h[0] for h in heads[1:]), len(lines)]):
        path = [p for p in path if p[0] < level] + [(level, title)]
        out.append(([t for _, t in path], *span(k, after)))
    return out


def chunk(markdown: str, max_chars: int = MAX_CHARS, max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> list[dict]:
    """Chunks in document order; ``content == markdown[start:end]``.

    A ``max_chars`` other than the default asks for windows of a quarter as many tokens, without overlap.
    """
    if max_chars != MAX_CHARS:
        max_tokens, overlap_tokens = max(1, max_chars // CHARS_PER_TOKEN), 0
    out = []
    for k, (path, start, end) in enumerate(sections(markdown)):
        text = markdown[start:end]
        if not text.strip():
            continue
        tokens = estimate(text)
        whole = tokens <= max_tokens
        spans = [Span(start, end, tokens)] if whole else _windows(markdown, start, end, max_tokens, overlap_tokens)
        for j, s in enumerate(spans):
            out.append({"chunk_id": f"c{k}" if whole else f"c{k}.{j}", "heading_path": path, "content": markdown[s.start : s.end], "start": s.start, "end": s.end, "char_count": s.end - s.start, "token_count": s.tokens})
    return out


def chunks(markdown: Column, max_chars: int = MAX_CHARS, max_tokens: int = MAX_TOKENS, overlap_tokens: int = OVERLAP_TOKENS) -> Column:
    """The chunks of a Markdown column as an array of structs; null has none.

    A batch's chunks are held at once, so take documents of ``short_batches``.
    """

    @F.pandas_udf(CHUNK_TYPE)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunk(t, max_chars, max_tokens, overlap_tokens) if t is not None else [])

    return run(markdown)


def manifest(docs: DataFrame, doc_id: str = "url", markdown: str = "markdown", content_hash: str = "content_hash", **limits: int) -> DataFrame:
    """One row per chunk with its document, the document's hash and the chunk's own."""
    rows = short_batches(docs).select(F.col(doc_id).alias("doc_id"), F.col(content_hash).alias("content_hash"), F.explode(chunks(F.col(markdown), **limits)).alias("c"))
    return rows.select("doc_id", "content_hash", "c.chunk_id", "c.heading_path", "c.start", "c.end", "c.char_count", "c.token_count", F.sha2("c.content", 256).alias("chunk_sha256"))


def sections_table(docs: DataFrame, doc_id: str, markdown: str) -> DataFrame:
    """(doc_id, line, level, title): headings outside code fences, in SQL functions only."""
    lines = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(markdown, "\n")).alias("line", "raw"))
    fence = F.trim(F.col("raw")).rlike("^(```|~~~)")
    from pyspark.sql import Window

    before = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.withColumn("inside", F.sum(F.when(fence, 1).otherwise(0)).over(before) % 2 == 1)
    return marked.where(~F.col("inside") & F.col("raw").rlike(r"^#{1,6}\s+")).select("doc_id", "line", F.length(F.regexp_extract("raw", "^(#+)", 1)).alias("level"), F.trim(F.regexp_extract("raw", r"^#{1,6}\s+(.*)$", 1)).alias("title"))
