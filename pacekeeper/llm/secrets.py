"""Secret scanning with structural confirmation.

Base patterns find assignments, access keys and long hex runs. Beside them, base64 and hex
candidates are decoded and reported only if what they hold parses: private keys in DER whose
nested lengths fit exactly, key containers of length-prefixed strings, and signed tokens whose
header and claims are JSON objects with an algorithm. Base spans stay as they are.

Edge cases: null and empty texts have no spans; offsets are code points, end exclusive; long
candidates are decoded whole, in time linear in their length; nesting is followed to
``MOST_DEPTH`` levels. Empty tables give an empty result. Input columns other than key and
text are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pacekeeper.llm.base import arrow_map

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "der", "hexder", "jwt")
MOST_DEPTH = 16
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
_HEXES = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")
_JWT = re.compile(r"(?<![A-Za-z0-9_-])(ey[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
_SSH_MAGIC = b"openssh-key-v1\0"
_INTEGER, _BITS, _OCTETS, _OID, _SEQUENCE = 2, 3, 4, 6, 0x30


def der_items(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill data[at:end] exactly; None if lengths do not fit."""
    out = []
    while at < end:
        if end - at < 2:
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or at + k > end:
                return None
            n = int.from_bytes(data[at : at + k], "big")
            at += k
            if n < 0x80:
                return None  # DER takes the short form
        if at + n > end:
            return None
        out.append((tag, at, at + n))
        at += n
    return out


def _nested(data: bytes, items: list[tuple[int, int, int]], depth: int = 0) -> bool:
    """Whether every constructed value is filled by well-formed values."""
    if depth > MOST_DEPTH:
        return False
    for tag, a, b in items:
        if tag & 0x20:
            inner = der_items(data, a, b)
            if inner is None or not _nested(data, inner, depth + 1):
                return False
    return True


def is_key(data: bytes) -> bool:
    """Whether ``data`` is exactly one private key: RSA, EC, PKCS#8 (also encrypted), or an SSH container."""
    if data.startswith(_SSH_MAGIC):
        return _ssh(data)
    top = der_items(data, 0, len(data)) if data[:1] == b"\x30" else None
    if not top or len(top) != 1 or top[0][0] != _SEQUENCE:
        return False
    inner = der_items(data, top[0][1], top[0][2])
    if not inner or not _nested(data, inner):
        return False
    tags = [t for t, _, _ in inner]
    if tags[:9] == [_INTEGER] * 9 and len(tags) in (9, 10):  # RSA: version, modulus, ..., coefficient
        return all(b > a for _, a, b in inner[:9])
    version = data[inner[0][1] : inner[0][2]] if tags[0] == _INTEGER else b""
    if version == b"\x01" and tags[1:2] == [_OCTETS] and all(t in (0xA0, 0xA1) for t in tags[2:]):  # EC
        return inner[1][2] - inner[1][1] >= 16
    if version in (b"\0", b"\x01") and tags[1:3] == [_SEQUENCE, _OCTETS]:  # PKCS#8
        algorithm = der_items(data, inner[1][1], inner[1][2])
        return bool(algorithm) and algorithm[0][0] == _OID
    if tags == [_SEQUENCE, _OCTETS]:  # encrypted PKCS#8
        algorithm = der_items(data, inner[0][1], inner[0][2])
        return bool(algorithm) and algorithm[0][0] == _OID and inner[1][2] - inner[1][1] >= 16
    return False


def _ssh(data: bytes) -> bool:
    at = len(_SSH_MAGIC)

    def string() -> bytes | None:
        nonlocal at
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    if any(string() is None for _ in range(3)):  # cipher, key derivation, its options
        return False
    count = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= count <= 1000 or any(string() is None for _ in range(count + 1)):
        return False
    return at <= len(data) and not data[at:].strip(b"\0")


def unbase64(text: str) -> bytes | None:
    """Decoded plain or URL-safe base64, padded or not; None if it is neither."""
    flat = "".join(text.split()).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(flat + "=" * (-len(flat) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _object(part: str) -> dict | None:
    data = unbase64(part)
    try:
        found = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def is_signed_token(header: str, claims: str, signature: str) -> bool:
    head = _object(header)
    if head is None or not isinstance(head.get("alg"), str) or _object(claims) is None:
        return False
    return bool(signature) or head["alg"].lower() == "none"


def base_spans(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 12:
            yield m.start(), m.end(), "assign"
    for kind, pattern in (("access", _ACCESS), ("hex", _HEX)):
        for m in pattern.finditer(text):
            yield m.start(), m.end(), kind


def confirmed_spans(text: str) -> Iterator[tuple[int, int, str]]:
    for m in _PEM.finditer(text) if "PRIVATE KEY-----" in text else ():
        data = unbase64(m[2])
        if data and is_key(data):
            yield m.start(), m.end(), "pem"
    for m in _BASE64.finditer(text):
        data = unbase64(m[0])
        if data and is_key(data):
            yield m.start(), m.end(), "der"
    for m in _HEXES.finditer(text):
        if is_key(bytes.fromhex(m[0])):
            yield m.start(), m.end(), "hexder"
    for m in _JWT.finditer(text) if "ey" in text else ():
        if is_signed_token(m[1], m[2], m[3]):
            yield m.start(), m.end(), "jwt"


def _joined(spans: list[tuple[int, int, str]]) -> str:
    order = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in order)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed for every row."""

    def run(batch: pa.RecordBatch):
        texts = [t or "" for t in batch.column(1).to_pylist()]
        base = [list(base_spans(t)) for t in texts]
        more = [list(confirmed_spans(t)) for t in texts]
        counts = {f"n_{k}": pa.array([sum(s[2] == k for s in b) for b in base], pa.int64()) for k in BASE_KINDS}
        yield {
            "doc_id": batch.column(0), **counts,
            "base_sha256": pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b in base], pa.string()),
            "spans": pa.array([_joined(b + m) for b, m in zip(base, more)], pa.string()),
            "n_confirmed": pa.array([len(m) for m in more], pa.int64()),
        }

    plain = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return arrow_map(plain, run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long", 512)
