"""HTML to Markdown: boilerplate passes over the tree, then element rules."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from math import inf
from urllib.parse import urljoin

from .dom import HEADINGS, Element, Text, drop, parse
from .selectors import Index

CONTENT_CHARS = 200
LOW_CONTENT_CHARS = 150
LANGUAGES = frozenset("python javascript typescript java c cpp csharp go rust ruby php swift kotlin scala bash shell sql html css json yaml xml markdown".split())
PERMALINKS = frozenset("anchor heading-anchor headerlink permalink".split())


@dataclass(frozen=True)
class ConvertOptions:
    excluded_tags: tuple[str, ...] = tuple("script style noscript nav footer aside svg canvas iframe button input form select textarea meta link head template".split())
    content_selectors: tuple[str, ...] = tuple(".markdown-body .ak-renderer-document .wiki-content .docs-content .documentation main article [role=main] .prose .content #content #main".split())
    strip_classes: tuple[str, ...] = tuple("sidebar menu toc table-of-contents navigation breadcrumb pagination search header footer".split())
    strip_class_words: tuple[str, ...] = tuple("sidebar toc breadcrumb breadcrumbs pagination pager sourcelink headerlink prevnext cookie consent newsletter subscribe social share feedback badge".split())
    include_images: bool = True
    absolute_urls: bool = True


@dataclass
class Converted:
    markdown: str = ""
    retention_ratio: float = 1.0
    source_chars: int = 0
    kept_chars: int = 0
    markdown_chars: int = 0
    stripped_elements: int = 0

    @property
    def low_content(self) -> bool:
        return self.markdown_chars < LOW_CONTENT_CHARS


_BLANKS, _GAPS, _BREAKS, _WORD_ENDS = re.compile("[\t ]+"), re.compile("\n\n\n+"), re.compile(r"\s*\n\s*"), re.compile("[-_]")

_CODE, _HASHES = re.compile(r"```.*?```", re.DOTALL), re.compile(r"^#{1,6}\s*", re.MULTILINE)
_IMAGE, _LINK = re.compile(r"!\[[^\]]*[\]][(][^)]*[)]"), re.compile(r"[\[]([^\]]*)[\]][(][^)]*[)]")


def visible_text(markdown: str) -> str:
    """What a reader of the Markdown sees, white space collapsed."""
    if "```" in markdown:
        markdown = _CODE.sub(" ", markdown)
    if "](" in markdown:
        markdown = _LINK.sub(r"\1", _IMAGE.sub(" ", markdown))
    markdown = _HASHES.sub("", markdown)
    for mark in "*_`>~":
        markdown = markdown.replace(mark, "")
    return " ".join(markdown.replace("|", " ").split())


def tidy(markdown: str) -> str:
    """At most one blank line, no blanks at line ends, one line end at the end."""
    text = "\n".join(line.rstrip() for line in _GAPS.sub("\n\n", markdown).split("\n")).strip()
    return f"{text}\n" if text else text


class _Writer:
    def __init__(self, options: ConvertOptions, base: str | None) -> None:
        self.options, self.base = options, base
        self.rules = {h: self._heading for h in HEADINGS} | {
            "p": lambda e: self._block(self._inner(e)),
            "br": lambda e: "\n",
            "hr": lambda e: "\n\n---\n\n",
            "strong": lambda e: self._around(e, "**"),
            "b": lambda e: self._around(e, "**"),
            "em": lambda e: self._around(e, "*"),
            "i": lambda e: self._around(e, "*"),
            "code": self._code,
            "pre": self._pre,
            "a": self._link,
            "ul": lambda e: self._list(e, None),
            "ol": self._numbered,
            "table": self._table,
            "blockquote": lambda e: self._block("\n".join(f"> {x}" for x in t.split("\n")) if (t := self._inner(e)) else ""),
            "dl": self._definitions,
        }
        if options.include_images:
            self.rules["img"] = self._image

    def __call__(self, node: Element | Text) -> str:
        if isinstance(node, Text):
            return _BLANKS.sub(" ", node.value)
        rule = self.rules.get(node.tag)
        return rule(node) if rule else self._children(node)

    def _children(self, e: Element) -> str:
        return "".join(map(self, e.kids))

    def _inner(self, e: Element) -> str:
        return self._children(e).strip()

    @staticmethod
    def _block(text: str) -> str:
        return text and "\n\n".join(("", text, ""))

    def _around(self, e: Element, mark: str) -> str:
        text = self._inner(e)
        return f"{mark}{text}{mark}" if text else ""

    def _heading(self, e: Element) -> str:
        text = e.texts().strip()
        return self._block(f"{'#' * int(e.tag[1])} {text}") if text else ""

    def _code(self, e: Element) -> str:
        if e.up is None or e.up.tag == "pre":
            return self._children(e)
        text = e.texts()
        return f"`{text}`" if text else ""

    def _pre(self, e: Element) -> str:
        code = e.first("code")
        text = (code or e).texts()
        return self._block(f"```{self._language(code) if code else ''}\n{text.strip()}\n```") if text else ""

    @staticmethod
    def _language(code: Element) -> str:
        for name in code.classes():
            for prefix in ("language-", "lang-"):
                if name.startswith(prefix):
                    return name[len(prefix) :]
            if name in LANGUAGES:
                return name
        return ""

    def _absolute(self, url: str) -> str:
        if not (self.options.absolute_urls and self.base):
            return url
        try:
            return urljoin(self.base, url)
        except ValueError:
            return url

    def _link(self, e: Element) -> str:
        to = e.attrs.get("href") or "#"
        text = "" if to.startswith(("javascript:", "#")) else self._inner(e)
        return f"[{text}]({self._absolute(to)})" if text else self._children(e)

    def _image(self, e: Element) -> str:
        src = e.attrs.get("src", "")
        return f"![{e.attrs.get('alt', '')}]({self._absolute(src)})" if src and not src.startswith("data:") else ""

    def _numbered(self, e: Element) -> str:
        try:
            return self._list(e, int(e.attrs.get("start", 1)))
        except ValueError:
            return self._list(e, 1)

    def _list(self, e: Element, start: int | None) -> str:
        items = []
        for k, li in enumerate(e.own("li")):
            if text := self._inner(li):
                mark, indent = ("-", "  ") if start is None else (f"{start + k}.", "   ")
                head, *more = text.split("\n")
                items.append("\n".join([f"{mark} {head}", *(indent + x for x in more if x.strip())]))
        return self._block("\n".join(items))

    def _definitions(self, e: Element) -> str:
        lines = [f"**{t}**" if k.tag == "dt" else f": {t}" for k in e.own("dt", "dd") if (t := self._inner(k))]
        return self._block("\n".join(lines))

    def _cell(self, e: Element) -> str:
        return _BREAKS.sub("<br>", self._inner(e)).replace("|", "\\|").strip()

    def _table(self, e: Element) -> str:
        head, rows = e.first("thead"), []
        if head and (tr := head.first("tr")):
            rows.append([self._cell(c) for c in tr.all("th", "td")])
        for tr in (e.first("tbody") or e).own("tr"):
            row = [self._cell(c) for c in tr.all("th", "td")]
            if any(row):
                rows.append(row)
        if len(rows) > 1 and rows[0] == rows[1]:
            del rows[1]
        if not rows:
            return ""
        width = len(rows[0])
        rules = ["".ljust(max(len(title), 3), "-") for title in rows[0]]
        body = [(r + [""] * width)[:width] for r in rows[1:]]
        return self._block("\n".join(f"| {' | '.join(r)} |" for r in [rows[0], rules, *body]))


def _content(root: Element, options: ConvertOptions) -> list[Element]:
    index = Index(root.below())
    for selector in options.content_selectors:
        found = [e for e in index.select(selector) if len(e.texts().strip()) >= CONTENT_CHARS]
        if found:
            known = set(map(id, found))
            return [e for e in found if not any(id(u) in known for u in e.above())]
    return []


def _signature(table: Element) -> tuple[str, ...]:
    row = table.first("tr")
    return tuple(c.texts(strip=True) for c in row.all("th", "td")) if row else ()


def _drop_header_clones(root: Element) -> None:
    """One-row header tables in a sticky wrapper that repeat the first row of a real table."""
    tables = root.all("table")
    if len(tables) < 2:
        return
    real = {s for t in tables if len(t.all("tr")) > 1 and (s := _signature(t))}
    for t in tables:
        cells = t.all("th", "td")
        if len(t.all("tr")) == 1 and _signature(t) in real and cells and all(c.tag == "th" for c in cells):
            if any("sticky" in (u.attrs.get("class") or "").lower() for u in t.above()):
                t.remove()


def _strip(root: Element, rank: Callable[[Element], int | None]) -> int:
    """Drops the elements that have a rank, in the order of their ranks; how many there were.

    What is inside an element of a smaller rank goes with it and is not counted.
    """
    gone, counted = [], 0
    stack: list[tuple[Element, float]] = [(k, inf) for k in root.kids if k.__class__ is Element]
    while stack:
        e, least = stack.pop()
        own = rank(e)
        if own is not None:
            gone.append(e)
            counted += own <= least
            least = min(own, least)
        if e.kids:
            stack += [(k, least) for k in e.kids if k.__class__ is Element]
    if gone:
        drop(gone)
    return counted


def convert_tree(root: Element, base: str | None = None, options: ConvertOptions = ConvertOptions()) -> Converted:
    out = Converted()
    drop(root.all("script", "style", "noscript"))
    out.source_chars = len(" ".join(root.texts().split()))

    ranks = {tag: k for k, tag in reversed(list(enumerate(options.excluded_tags)))}
    out.stripped_elements += _strip(root, lambda e: ranks.get(e.tag))

    areas = _content(root, options)
    safe = {id(e) for a in areas for e in (a, *a.below())}
    body = root.first("body")
    areas = areas or [body or root]
    if areas == [body]:
        safe = set()

    order = {name: k for k, name in reversed(list(enumerate(options.strip_classes)))}
    words = {w.lower() for w in options.strip_class_words}

    def by_class(e: Element) -> int | None:
        return min((order[c] for c in e.classes() if c in order), default=None) if "class" in e.attrs and id(e) not in safe else None

    def by_word(e: Element) -> int | None:
        if "class" not in e.attrs or id(e) in safe or e.tag in ("html", "head", "body"):
            return None
        return 0 if any(w in words for c in e.classes() for w in _WORD_ENDS.split(c.lower())) else None

    out.stripped_elements += _strip(root, by_class)
    out.stripped_elements += _strip(root, by_word)

    for h in root.all(*HEADINGS):
        for a in h.all("a"):
            marked = {c.lower() for c in a.classes()} & PERMALINKS
            if marked or a.attrs.get("href", "").startswith("#") and a.texts().strip() in {"¶", "&para;", "#", ""}:
                out.stripped_elements += 1
                a.remove()
    _drop_header_clones(root)

    write = _Writer(options, base)
    raw = "\n\n".join(map(write, areas))
    out.markdown_chars, out.kept_chars = len(raw), len(visible_text(raw))
    out.retention_ratio = round(min(1.0, out.kept_chars / max(1, out.source_chars)), 4)
    out.markdown = tidy(raw)
    return out


def convert(html: str, base: str | None = None, options: ConvertOptions = ConvertOptions()) -> Converted:
    return convert_tree(parse(html), base, options)
