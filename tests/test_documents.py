import base64
import datetime as dt

import pytest
from pyspark.sql import functions as F

from capturelake.operators import documents as d
from capturelake.operators import ed25519

SEED = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
PEM = ed25519.to_pem(SEED)
KEY = base64.b64encode(ed25519.public_of(SEED)).decode()
DOC = "---\ntitle: Hello\nnote: |\n  signature: inner\nday: 2026-01-02\n---\n\n# Hello\n\nBody.\n"

# RFC 8032, 7.1: secret, public, message, signature
VECTORS = [
    ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
    ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
]


@pytest.mark.parametrize("secret,public,message,signature", VECTORS)
def test_ed25519(secret, public, message, signature):
    secret, public, message, signature = map(bytes.fromhex, (secret, public, message, signature))
    assert ed25519.public_of(secret) == public and ed25519.sign(secret, message) == signature
    assert ed25519.verify(public, message, signature)
    assert not ed25519.verify(public, message + b"x", signature) and not ed25519.verify(public, message, signature[:-1] + b"\x7f")
    assert ed25519.from_pem(ed25519.to_pem(secret)) == secret


def test_signature_agrees_with_the_jvm(spark):
    jvm = spark._jvm
    key = jvm.java.security.KeyFactory.getInstance("Ed25519").generatePrivate(jvm.java.security.spec.PKCS8EncodedKeySpec(bytearray(ed25519._PKCS8 + SEED)))
    signer = jvm.java.security.Signature.getInstance("Ed25519")
    signer.initSign(key)
    signer.update(bytearray(b"message"))
    assert bytes(signer.sign()) == ed25519.sign(SEED, b"message")


def test_split_and_render():
    front, body = d.split(DOC)
    assert front["title"] == "Hello" and front["day"] == dt.date(2026, 1, 2) and body == "# Hello\n\nBody.\n" == d.body_of(DOC)
    assert d.split("no front matter") == ({}, "no front matter") and d.split("---\nopen: 1\n") == ({}, "---\nopen: 1\n")
    assert d.split("---\n- a\n---\nb")[0] == {}
    assert d.split(d.render({"a": "ä: b"}, "x\n\n")) == ({"a": "ä: b"}, "x\n")
    with pytest.raises(Exception, match="duplicate"):
        d.split("---\na: 1\na: 2\n---\n")


def test_sign_and_verify():
    signed = d.sign(DOC, PEM)
    assert d.verify(signed, KEY) == (True, "signature valid (identity pinned)")
    assert d.verify(signed)[0] is False and "not pinned" in d.verify(signed)[1]
    assert "  signature: inner" in signed
    twice = d.sign(signed, PEM)
    assert twice.count("\nsignature:") == 1 and d.verify(twice, KEY)[0]
    assert d.verify(d.sign("bare body\n", PEM), KEY)[0]


@pytest.mark.parametrize("change,word", [(lambda s: s.replace("Body", "body"), "INVALID"), (lambda s: s.replace("title: Hello", "title: Hi"), "INVALID"), (lambda s: s.replace("\n---\n\n", "\nextra: 1\n---\n\n"), "INVALID"), (lambda s: s.replace("title:", "title: a\ntitle:"), "malformed"), (lambda s: DOC, "not signed")])
def test_tampering(change, word):
    good, why = d.verify(change(d.sign(DOC, PEM)), KEY)
    assert not good and word in why


def test_wrong_key():
    other = base64.b64encode(ed25519.public_of(bytes(32))).decode()
    assert "mismatch" in d.verify(d.sign(DOC, PEM), other)[1]


def test_manifest_values():
    text = d.manifest("b", {"t": dt.datetime(2026, 1, 1, 2, tzinfo=dt.timezone(dt.timedelta(hours=2))), "d": dt.date(2026, 1, 1), "ü": [1, None], "body_sha256": "x", "signature": "y"})
    assert text.startswith('{"body_sha256":"3e23') and '"d":"2026-01-01","t":"2026-01-01T00:00:00Z","\\u00fc":[1,null]' in text


def test_columns(spark):
    df = spark.createDataFrame([(DOC,), (None,)], "doc string").withColumn("s", d.signed(F.col("doc"), PEM, "2026-01-01T00:00:00Z"))
    got = df.select("s", d.verified(F.col("s"), KEY).alias("v")).collect()
    assert got[0].v.ok and got[1].s is None and not got[1].v.ok


def test_known_keys_are_not_doubled_again(monkeypatch):
    """A key that comes a second time is laid in as multiples; from then on a signature costs additions only."""
    doubled = []
    twice = ed25519._twice
    monkeypatch.setattr(ed25519, "_twice", lambda p: doubled.append(p) or twice(p))
    key, signature = ed25519.public_of(SEED), ed25519.sign(SEED, b"m")
    assert all(ed25519.verify(key, b"m", signature) for _ in range(2))
    doubled.clear()
    assert ed25519.verify(key, b"m", signature) and not ed25519.verify(key, b"n", signature) and not doubled


def test_blocks_are_read_alike_by_both_parsers():
    import yaml

    for text in ("a: 1\nb: [x, 2026-01-01]\nc: {d: 'e', f: 1_000}\n", "t: \U0001f600 é\nu: 0o17\nv: yes\n", "a: 1\na: 2\n", "a: [\n", "~: 2﻿!\t`0\\\n", "k: é\t&|x\n"):
        made = []
        for loader in (d._Loader, None):
            try:
                made.append(yaml.load(text, loader) if loader else d._loaded(text))
            except yaml.YAMLError:
                made.append("refused")
        assert made[0] == made[1]


def test_documents_are_signed_once(spark):
    rows = spark.createDataFrame([("---\na: 1\n---\n\nb\n",)], "t string").withColumn("d", d.signed(F.col("t"), PEM))
    made = rows.select(*(d.verified(c, KEY)["ok"].alias(n) for n, c in (("good", F.col("d")), ("same", F.col("d")), ("changed", F.concat("d", F.lit("x"))))))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "run(run(" not in plan
    assert tuple(made.first()) == (True, True, False)
