"""Policy rules compiled to one Column: any deny rule beats all allow rules, the first that matches is named."""

from __future__ import annotations

import copy
import fnmatch
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import path as path_of

def _deny(rule: str, why: str, **terms: object) -> dict:
    return {"reason": why, "name": rule, "deny_if": terms}


_RESERVED = "All Rights Reserved"
_OPTED_OUT = [
    _deny("no-training-denied", "site prohibits AI training", ai_txt=dict(training="Deny")),
    _deny("no-data-denied", "site prohibits use of its content as data", ai_txt=dict(data="Deny")),
    _deny("no-disallow", "site disallows scraping", ai_txt=dict(disallow=True)),
    _deny("no-proprietary", "proprietary content", license=[_RESERVED]),
]
PROFILES: dict[str, list[dict]] = {
    "open-only": [_deny("open-licenses-only", "license is not permissive/open", license=[_RESERVED, *"proprietary by-nc by-nd".split()])],
    "strict-optout": _OPTED_OUT,
    "default": [],
}


def profile(name: str) -> list[dict]:
    """A copy of a named rule list."""
    try:
        return copy.deepcopy(PROFILES[name])
    except KeyError:
        raise ValueError(f"no profile {name!r}; there are {sorted(PROFILES)}") from None


def _several(value: object) -> list[str]:
    return [str(v) for v in value] if isinstance(value, (list, tuple)) else [str(value)]


def glob(text: Column, pattern: str) -> Column:
    """fnmatch: * crosses slashes, case counts."""
    regex = fnmatch.translate(pattern)
    return text.rlike("^" + (regex[: -len("\\Z")] + "\\z" if regex.endswith("\\Z") else regex))


def condition(terms: dict, url: Column, license: Column, ai_txt: Column) -> Column:
    """Whether any of the terms holds."""
    found: list[Column] = []
    if "license" in terms:
        held = F.lower(F.coalesce(license, F.lit("")))
        found += [held.contains(v.lower()) for v in _several(terms["license"])]
    if "path" in terms:
        found += [glob(path_of(url), v) for v in _several(terms["path"])]
    for key, value in (terms.get("ai_txt") or {}).items():
        have = F.coalesce(F.try_element_at(ai_txt, F.lit(key)), F.lit(""))
        if key == "disallow":
            found.append((have != "") & ((have == "/") | path_of(url).startswith(have)))
        else:
            found.append((have != "") & (F.lower(have) == str(value).lower()))
    return reduce(or_, (F.coalesce(c, F.lit(False)) for c in found), F.lit(False))


@dataclass(frozen=True)
class Policy:
    """Rules are dicts with name, deny_if or allow_if, and reason."""

    rules: list[dict] = field(default_factory=list)

    def __post_init__(self) -> None:
        for rule in self.rules:
            if not isinstance(rule, dict) or not (rule.get("deny_if") or rule.get("allow_if")):
                raise ValueError(f"a policy rule needs deny_if or allow_if: {rule!r}")

    def decide(self, url: Column, license: Column, ai_txt: Column) -> Column:
        """struct<allowed, rule, reason>; ai_txt is a map of directives."""

        def made(allowed: bool, rule: str, reason: str) -> Column:
            return F.struct(F.lit(allowed).alias("allowed"), F.lit(rule).alias("rule"), F.lit(reason).alias("reason"))

        choices = []
        for kind, allowed in (("deny_if", False), ("allow_if", True)):
            for rule in self.rules:
                if rule.get(kind):
                    name = rule.get("name") or ("allow" if allowed else "deny")
                    choices.append(F.when(condition(rule[kind], url, license, ai_txt), made(allowed, name, "" if allowed else rule.get("reason") or "blocked by policy")))
        return F.coalesce(*choices, made(True, "", ""))
