"""The part of CSS that content selectors use: compounds of tag, .class, #id and [attribute="value"], joined by blanks or >."""

from __future__ import annotations

import re
from functools import lru_cache

from .dom import Element

_STEP = re.compile(r"""\s*(>)?\s*((?:\*|[\w-]+|\.[\w-]+|\#[\w-]+|\[[^\]]*\])+)""")
_PART = re.compile(r"""(?P<tag>\*|^[\w-]+)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[\s*(?P<att>[\w:-]+)\s*(?:(?P<op>[~^$*|]?=)\s*["']?(?P<val>[^"'\]]*)["']?)?\s*\]""")


@lru_cache(maxsize=256)
def compiled(selector: str) -> list[list[tuple[bool, list[dict[str, str]]]]]:
    out = []
    for one in selector.split(","):
        steps, at = [], 0
        one = one.strip()
        while at < len(one):
            m = _STEP.match(one, at)
            if not m:
                raise ValueError(f"selector not understood: {selector!r}")
            steps.append((m[1] == ">", [p.groupdict() for p in _PART.finditer(m[2])]))
            at = m.end()
        out.append(steps)
    return out


def _fits(e: Element, parts: list[dict[str, str]]) -> bool:
    for p in parts:
        if p["tag"] and p["tag"] != "*" and e.tag != p["tag"].lower():
            return False
        if p["cls"] and p["cls"] not in e.classes():
            return False
        if p["id"] and e.attrs.get("id") != p["id"]:
            return False
        if p["att"]:
            have, want = e.attrs.get(p["att"].lower()), p["val"] or ""
            if have is None:
                return False
            tests = {None: True, "=": have == want, "~=": want in have.split(), "^=": have.startswith(want), "$=": have.endswith(want), "*=": want in have, "|=": have == want or have.startswith(f"{want}-")}
            if not tests[p["op"]]:
                return False
    return True


def _matches(e: Element, steps: list[tuple[bool, list[dict[str, str]]]]) -> bool:
    if not _fits(e, steps[-1][1]):
        return False
    if len(steps) == 1:
        return True
    ups = list(e.above())[: 1 if steps[-1][0] else None]
    return any(_matches(u, steps[:-1]) for u in ups)


def select(root: Element, selector: str) -> list[Element]:
    return Index(root.below()).select(selector)


class Index:
    """Elements in document order, found by tag and class without a look at the others."""

    def __init__(self, elements: list[Element]) -> None:
        self.elements = elements
        self.tags: dict[str, list[Element]] = {}
        self.named: dict[str, list[Element]] = {}
        for e in elements:
            self.tags.setdefault(e.tag, []).append(e)
            if "class" in e.attrs:
                for name in set(e.classes()):
                    self.named.setdefault(name, []).append(e)

    def select(self, selector: str) -> list[Element]:
        options = compiled(selector)
        near = self.elements
        if len(options) == 1:
            for p in options[0][-1][1]:
                if p["cls"]:
                    near = self.named.get(p["cls"], [])
                elif p["tag"] and p["tag"] != "*":
                    near = self.tags.get(p["tag"].lower(), [])
        return [e for e in near if any(_matches(e, steps) for steps in options)]
