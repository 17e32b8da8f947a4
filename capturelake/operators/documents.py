"""Documents with YAML front matter: assembly, reading back, signing and verifying."""

from __future__ import annotations

import base64
import datetime as dt
import hashlib
import json

import pandas as pd
import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import utc_now, utc_text
from . import ed25519

SIGNATURE_KEYS = ("signature", "public_key", "manifest_sha256")
STAMP_KEYS = (*SIGNATURE_KEYS, "signed_at")


class _OneOfEach:
    """Refuses mappings that have a key twice."""

    def construct_mapping(self, *args, **options):  # noqa: ANN002, ANN003, ANN201
        node = args[0]
        keys = [self.construct_object(k, deep=True) for k, _ in node.value]
        for k in keys:
            if keys.count(k) > 1:
                raise yaml.constructor.ConstructorError(None, None, f"duplicate key: {k!r}", node.start_mark)
        return super().construct_mapping(*args, **options)


class _Loader(_OneOfEach, yaml.SafeLoader):
    pass


class _Quick(_OneOfEach, getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
    """libyaml where it is there; it takes some tabs and marks that the other refuses."""


def _loaded(block: str) -> object:
    return yaml.load(block, _Loader if "\t" in block or "\ufeff" in block else _Quick)


def _fence(lines: list[str]) -> int | None:
    return next((k for k in range(1, len(lines)) if lines[k].rstrip() == "---"), None)


def _parts(text: str) -> tuple[str, str] | None:
    """(text of the front matter, body), or None where no block of front matter is opened and closed."""
    lines = text.split("\n")
    end = _fence(lines) if text.startswith("---\n") else None
    if end is None:
        return None
    head, rest = lines[1:end], lines[end + 1 :]
    return "\n".join(head), "\n".join(rest).lstrip("\n")


def split(text: str) -> tuple[dict, str]:
    """(front matter, body); without a closed block of front matter all is body."""
    parts = _parts(text)
    found = (_loaded(parts[0]) or {}) if parts else None
    return (found, parts[1]) if parts and isinstance(found, dict) else ({}, text)


def body_of(text: str) -> str:
    """The body as read back from a stored file."""
    parts = _parts(text)
    return parts[1] if parts else text


def render(front: dict, body: str) -> str:
    block = yaml.safe_dump(front, sort_keys=False, allow_unicode=True)
    return "".join(("---\n", block, "---\n\n", body.rstrip(), "\n"))


def _plain(value: object) -> object:
    if isinstance(value, dt.datetime):
        return utc_text(value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc))
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)


def manifest(body: str, front: dict) -> str:
    """What is signed: all front matter but the signature itself, and the body's hash; sorted, compact, ASCII."""
    held = {str(k): _plain(v) for k, v in front.items() if k not in SIGNATURE_KEYS}
    held["body_sha256"] = hashlib.sha256(body.encode()).hexdigest()
    return json.dumps(held, separators=(",", ":"), sort_keys=True)


def stamp(body: str, front: dict, private_pem: str, at: str | None = None) -> dict[str, str]:
    seed = ed25519.from_pem(private_pem)
    at = at or utc_now()
    message = manifest(body, front | {"signed_at": at}).encode()
    return {
        "signature": base64.b64encode(ed25519.sign(seed, message)).decode(),
        "public_key": base64.b64encode(ed25519.public_of(seed)).decode(),
        "manifest_sha256": hashlib.sha256(message).hexdigest(),
        "signed_at": at,
    }


def sign(document: str, private_pem: str, at: str | None = None) -> str:
    """The document with a signature block; one that it has is replaced."""
    front, body = split(document)
    kept = {k: v for k, v in front.items() if k not in STAMP_KEYS}
    block = yaml.safe_dump(stamp(body, kept, private_pem, at), sort_keys=False)
    lines = document.split("\n")
    end = _fence(lines) if document.startswith("---\n") else None
    if end is None:
        return f"---\n{block}---\n\n{document}"
    head = [x for x in lines[:end] if not x.startswith(tuple(f"{k}:" for k in STAMP_KEYS))]
    return "\n".join([*head, block.rstrip("\n"), *lines[end:]])


def signature_holds(body: str, front: dict, signature: str, public_key: str) -> bool:
    try:
        message = manifest(body, front).encode()
        stored, declared = front.get("manifest_sha256"), front.get("content_hash")
        if stored and stored != hashlib.sha256(message).hexdigest() or declared and declared != hashlib.sha256(body.encode()).hexdigest():
            return False
        return ed25519.verify(base64.b64decode(public_key), message, base64.b64decode(signature))
    except (ValueError, TypeError):
        return False


def verify(document: str, expected_key: str | None = None):  # noqa: ANN201
    """(whether it is signed by the expected key, why); a valid signature without an expected key is not enough."""
    try:
        front, body = split(document)
    except (yaml.YAMLError, ValueError) as error:
        return False, f"signature INVALID: malformed front matter: {error}"
    signature, key = front.get("signature"), front.get("public_key")
    if not (signature and key):
        return False, "document is not signed (missing signature or public_key)"
    if expected_key and key != expected_key:
        return False, "public key mismatch: not signed by the expected producer"
    if not signature_holds(body, front, signature, key):
        return False, "signature INVALID: body or provenance was modified after signing"
    return (True, "signature valid (identity pinned)") if expected_key else (False, "signature valid but identity not pinned: give the expected public key")


def signed(document: Column, private_pem: str, at: str | None = None) -> Column:
    """The signed document; it is made once, however many columns are derived from it."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sign(t, private_pem, at), na_action="ignore")

    return run.asNondeterministic()(document)


def verified(document: Column, expected_key: str | None = None) -> Column:
    @F.pandas_udf("ok boolean, reason string")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([verify(t or "", expected_key) for t in texts], columns=["ok", "reason"])

    return run(document)


def rendered(front: Column, body: Column) -> Column:
    """Front matter (a struct or map; null, empty and false fields left out, but for a ratio of 0) and body as a document."""

    @F.pandas_udf("string")
    def run(fronts: pd.Series, bodies: pd.Series) -> pd.Series:
        out = []
        for raw, text in zip(fronts, bodies):
            held = json.loads(raw or "{}")
            out.append(render({k: v for k, v in held.items() if v or k in ("title", "status_code", "retention_ratio") and v is not None}, text or ""))
        return pd.Series(out, dtype=object)

    return run(F.to_json(front), body)
