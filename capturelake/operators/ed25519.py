"""Ed25519 signatures (RFC 8032) on Python integers, and the PEM form of private keys."""

from __future__ import annotations

import base64
import hashlib
import os
from functools import lru_cache

P = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, P - 2, P) % P
ROOT = pow(2, (P - 1) // 4, P)
_PKCS8 = bytes.fromhex("302e020100300506032b657004220420")

Point = tuple[int, int, int, int]
NEUTRAL: Point = (0, 1, 1, 0)


def _x_of(y: int, odd: int) -> int | None:
    square = (y * y - 1) * pow(D * y * y + 1, P - 2, P) % P
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * ROOT % P
    if y >= P or (x * x - square) % P or not x and odd:
        return None
    return P - x if x & 1 != odd else x


_BY = 4 * pow(5, P - 2, P) % P
_BX = _x_of(_BY, 0)
BASE: Point = (_BX, _BY, 1, _BX * _BY % P)


def _add(p: Point, q: Point) -> Point:
    a, b = (p[1] - p[0]) * (q[1] - q[0]) % P, (p[1] + p[0]) * (q[1] + q[0]) % P
    c, d = 2 * p[3] * q[3] * D % P, 2 * p[2] * q[2] % P
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % P, g * h % P, f * g % P, e * h % P


def _twice(p: Point) -> Point:
    a, b = p[0] * p[0] % P, p[1] * p[1] % P
    c, h = 2 * p[2] * p[2] % P, a + b
    e = (h - (p[0] + p[1]) ** 2) % P
    g = a - b
    f = c + g
    return e * f % P, g * h % P, f * g % P, e * h % P


def _times(n: int, p: Point) -> Point:
    """n * p by windows of four bits."""
    table = [NEUTRAL, p]
    for _ in range(14):
        table.append(_add(table[-1], p))
    total = NEUTRAL
    for shift in range((n.bit_length() + 3) // 4 * 4 - 4, -1, -4):
        total = _twice(_twice(_twice(_twice(total))))
        if digit := n >> shift & 15:
            total = _add(total, table[digit])
    return total


def _multiples(p: Point) -> list[list[Point]]:
    """Multiples 0 to 15 of 16^k times a point."""
    rows = []
    for _ in range(64):
        row = [NEUTRAL]
        for _ in range(15):
            row.append(_add(row[-1], p))
        rows.append(row)
        p = _add(row[-1], p)
    return rows


def _times_known(n: int, rows: list[list[Point]]) -> Point:
    total = NEUTRAL
    for k, row in enumerate(rows):
        if digit := n >> 4 * k & 15:
            total = _add(total, row[digit])
    return total


@lru_cache(maxsize=1)
def _base_table() -> list[list[Point]]:
    return _multiples(BASE)


def _times_base(n: int) -> Point:
    return _times_known(n, _base_table())


class _Key:
    """A public key as it is met: multiples of its point, negated, are laid in when it comes a second time."""

    def __init__(self, public: bytes) -> None:
        p = _unpack(public)
        self.point = p and (P - p[0], p[1], 1, P - p[3])
        self.met, self.rows = False, None

    def times(self, n: int) -> Point:
        if self.met and self.rows is None:
            self.rows = _multiples(self.point)
        self.met = True
        return _times_known(n, self.rows) if self.rows else _times(n, self.point)


_key = lru_cache(maxsize=64)(_Key)


def _pack(p: Point) -> bytes:
    z = pow(p[2], -1, P)
    return (p[1] * z % P | (p[0] * z % P & 1) << 255).to_bytes(32, "little")


def _unpack(raw: bytes) -> Point | None:
    n = int.from_bytes(raw, "little")
    y = n & ((1 << 255) - 1)
    x = _x_of(y, n >> 255)
    return None if x is None else (x, y, 1, x * y % P)


def _number(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % ORDER


@lru_cache(maxsize=64)
def _expand(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    return int.from_bytes(h[:32], "little") & ((1 << 254) - 8) | 1 << 254, h[32:]


@lru_cache(maxsize=64)
def public_of(seed: bytes) -> bytes:
    return _pack(_times_base(_expand(seed)[0]))


def sign(seed: bytes, message: bytes) -> bytes:
    secret, prefix = _expand(seed)
    public = public_of(seed)
    nonce = _number(prefix, message)
    point = _pack(_times_base(nonce))
    return point + ((nonce + _number(point, public, message) * secret) % ORDER).to_bytes(32, "little")


def verify(public: bytes, message: bytes, signature: bytes) -> bool:
    if len(public) != 32 or len(signature) != 64:
        return False
    key, s = _key(public), int.from_bytes(signature[32:], "little")
    if key.point is None or s >= ORDER:
        return False
    # a point has one encoding, so the first half need not be decoded
    return _pack(_add(_times_base(s), key.times(_number(signature[:32], public, message)))) == signature[:32]


def to_pem(seed: bytes) -> str:
    return f"-----BEGIN PRIVATE KEY-----\n{base64.b64encode(_PKCS8 + seed).decode()}\n-----END PRIVATE KEY-----\n"


def from_pem(pem: str) -> bytes:
    body = "".join(line for line in pem.strip().splitlines() if not line.startswith("-----"))
    raw = base64.b64decode(body)
    if len(raw) != 48 or not raw.startswith(_PKCS8):
        raise ValueError("not an Ed25519 private key")
    return raw[16:]


def new_keypair() -> tuple[str, str]:
    """(private key as PEM, public key in base64)."""
    seed = os.urandom(32)
    return to_pem(seed), base64.b64encode(public_of(seed)).decode()
