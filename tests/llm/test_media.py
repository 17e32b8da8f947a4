import gzip
import hashlib
import io
import struct
import time
import wave
import zipfile
import zlib

import pytest

from capturelake.llm import media


def chunk(name, body):
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


PNG = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"\x21\xf9\x04\0\0\0\0\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02D\x01\0" + b"\x3b"
JPEG = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0" + b"\xff\xda" + struct.pack(">H", 8) + b"\x01\x01\0\0\x3f\0" + b"\x12\xff\0\x34\xff\xd0\x56" + b"\xff\xd9"
PDF = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\n9\n%%EOF"
FLAC = b"fLaC" + b"\x80" + (34).to_bytes(3, "big") + bytes(34) + b"\xff\xf8\0\0"
OGG = b"OggS\0\x06" + bytes(20) + b"\x01\x03abc"


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


SAMPLES = {"image/png": PNG, "image/gif": GIF, "image/jpeg": JPEG, "application/pdf": PDF, "audio/flac": FLAC, "audio/ogg": OGG, "application/gzip": gzip.compress(b"x" * 1000, mtime=0), "application/zip": zipped(), "audio/wav": media.to_wav(b"\x80" * 64)}


@pytest.mark.parametrize("kind", SAMPLES)
def test_validators(kind):
    raw = SAMPLES[kind]
    assert media.parts(raw)[0] == (0, len(raw), kind)
    assert not [p for p in media.parts(raw[: len(raw) - 3]) if p[0] == 0 and kind not in ("audio/flac",)]


def test_pdf_of_several_ends():
    saved = PDF + b"\n2 0 obj\nendobj\nstartxref\n42\n%%EOF"
    linearized = b"%PDF-1.4\n1 0 obj\nendobj\nstartxref\r\n0\r\n%%EOF\r\n2 0 obj\nendobj\nstartxref\r\n99\r\n%%EOF"
    for raw in (saved, linearized):
        assert media.parts(raw) == [(0, len(raw), "application/pdf")]
        assert media.parts(b"--" + raw + b"\n" + PDF + b" %%EOF") == [(2, len(raw), "application/pdf"), (len(raw) + 3, len(PDF), "application/pdf")]
        assert media.parts(b"--" + raw + PNG) == [(2, len(raw), "application/pdf"), (len(raw) + 2, len(PNG), "image/png")]


def test_media_behind_flac():
    raw = b"--" + FLAC + b"frames" + PNG + FLAC + GIF
    assert [(s, t) for s, _, t in media.parts(raw)] == [(2, "audio/flac"), (2 + len(FLAC) + 6, "image/png"), (8 + len(FLAC) + len(PNG), "audio/flac"), (8 + 2 * len(FLAC) + len(PNG), "image/gif")]
    # a picture in the metadata belongs to the embedded FLAC
    art = FLAC[:4] + b"\0" + FLAC[5:42] + b"\x86" + len(PNG).to_bytes(3, "big") + PNG + FLAC[42:]
    assert [t for _, _, t in media.parts(b"--" + art)] == ["audio/flac"]


def test_corrected_types_and_carved_media(spark):
    noise = b"GIF89a no image, RIFF no sound, PK\x03\x04 "
    rows = [(1, PNG, "image/jpeg"), (2, noise + PNG + b"--" + GIF, "text/plain"), (3, None, "image/png"), (4, b"", None), (5, media.to_wav(PNG + b"\0" * 3), "application/octet-stream"), (6, PNG + b"tail", "image/png")]
    df = spark.createDataFrame([(*r, "mine") for r in rows], "id int, content binary, declared_type string, valid string")
    got = {r.id: r for r in media.sniff(df).collect()}
    assert (got[1].sniffed_type, got[1].valid, got[1].length) == ("image/png", True, len(PNG))
    assert (got[2].sniffed_type, got[2].valid) == ("text/plain", False)
    assert [tuple(e) for e in got[2].embedded] == [(len(noise), len(PNG), "image/png"), (len(noise) + len(PNG) + 2, len(GIF), "image/gif")]
    assert (got[3].sniffed_type, got[3].valid, got[3].length) == ("image/png", False, None)
    assert (got[4].sniffed_type, got[4].embedded) == (None, [])
    assert got[5].sniffed_type == "audio/wav" and [e.type for e in got[5].embedded] == ["image/png"]
    assert got[6].length == len(PNG)


def test_stored_texts(spark, documents, corpus):
    got = {r.doc_id: r for r in media.digests(documents).collect()}
    full = {r.doc_id: r for r in media.store_texts(documents).collect()}
    assert len(got) == len(corpus)
    for i, text in corpus:
        raw = (text or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        with wave.open(io.BytesIO(full[i].media)) as w:
            assert (w.getsampwidth(), w.getnchannels()) == (1, 1) and w.readframes(w.getnframes()) == payload
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        assert (r.media_bytes, r.media_sha256) == (len(full[i].media), hashlib.sha256(full[i].media).hexdigest())
        assert r.feature == full[i].feature == media.feature(payload)


def test_texts_that_look_like_media(spark, no_documents):
    df = spark.createDataFrame([(1, "RIFF\x24\x00\x00\x00WAVE data GIF89a"), (2, "RIFF\x24\x00\x00\x00WAVE data GIF89a")], "doc_id long, text string")
    a, b = media.digests(df).collect()
    assert a.asDict() | {"doc_id": 0} == b.asDict() | {"doc_id": 0}
    assert media.digests(no_documents).count() == 0


@pytest.mark.parametrize("unit", [b"PK\x03\x04 PK\x05\x06", b"%PDF-1", b"%PDF-1 startxref %%EO", b"GIF89a       !!", b"OggS\0", b"\x89PNG\r\n\x1a\n\0\0\0\x0dIHDR", b"\xff\xd8\xff\xda\0\x04  ", b"fLaC\0\0\0\x22", b"RIFF\0\0\x10\0WAVE"])
def test_values_full_of_magic_bytes(unit):
    """Ten times the bytes take about ten times as long, not a hundred times."""

    def seconds(n):
        raw = unit * (n // len(unit))
        began = time.process_time()
        media.parts(raw)
        return time.process_time() - began

    assert seconds(2_000_000) < 30 * max(seconds(200_000), 0.02)


def test_archives_and_documents_among_headers():
    z, noise = zipped(), b"PK\x03\x04 PK\x05\x06" * 50
    assert media.parts(b"-" + noise + z + noise + z)[0] == (1 + len(noise), len(z), "application/zip")
    assert [s for s, _, t in media.parts(noise + z + noise + z) if t == "application/zip"] == [len(noise), 2 * len(noise) + len(z)]
    assert [p[2] for p in media.parts(b"--%PDF-1 %PDF-2 " + PDF)] == ["application/pdf"]
