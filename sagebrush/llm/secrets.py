"""Secret scans with structural confirmation.

Three plain patterns find assignments, access keys and long hex runs.  Beside them, candidates that may hold an encoded key
or a signed token are decoded and parsed, and reported only where their structure is whole:

* base64 (lines joined, also at an escaped line break) and hex runs whose bytes begin as a key encoding does are decoded as far as the
  outer length says and parsed with all nested lengths: DER private keys (PKCS#1 RSA and DSA, SEC1 EC, PKCS#8 plain and encrypted),
  OpenSSH private keys (a chain of length-prefixed strings), and OpenPGP secret-key packets;
* three or five base64url segments joined by dots: the header must be a JSON object with a known algorithm, a signed token's
  payload and the length of its signature must fit it (an unsigned one is no secret), an encrypted token needs its
  initialisation vector and tag.

A line of a run is a possible beginning, so text that stands before a key on a line of its own does not shift it; within a line a key must
stand at the beginning of its run of base64 or hex characters.  Keys are parsed up to ``KEY_BYTES``, which no such encoding exceeds, so
the work grows with the text.  Everything happens inside the row: no shuffle.

Defined results: a null or empty text has no spans; texts of any length are scanned whole; repeated rows and ids are rows like others; an
empty table gives no rows.  Offsets are code points, the end exclusive.  Letters of the patterns are ASCII ones in either case where
the pattern says so.  ``scan`` keeps all columns of its input and adds one, under the name the caller gives.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY_BYTES = 1 << 16

# fixed values: the base patterns and the lengths that a match must have
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 8, 16, 32
# kinds in the order of a report: the base ones, then those of this method
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "private_key", "openssh_key", "pgp_key", "signed_token", "encrypted_token")

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
# a run is matched to its end, so a least length says the same as dropping the shorter matches
_ACCESS = re.compile(f"AKIA[A-Z0-9]{{{ACCESS_CHARS - 4},}}")
_HEX = re.compile(f"(?<![0-9a-f])[0-9a-f]{{{HEX_CHARS},}}")

# every match of the first pattern holds one of these
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
RUN_CHARS = 24
_OTHER = np.ones(256, bool)
_OTHER[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_", np.uint8)] = False

_BREAK = r"(?:\r?\n[\x20\t]*|\\r\\n|\\n)"
_BASE64_RUN = re.compile(rf"(?:(?<=\\[nr])|(?<![A-Za-z0-9+/\\]))[A-Za-z0-9+/]{{{RUN_CHARS},}}={{0,2}}(?:{_BREAK}[A-Za-z0-9+/]+={{0,2}})*")
_HEX_RUN = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{48,}")
_BREAKS = re.compile(_BREAK)
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{12,}+(?:\.[A-Za-z0-9_-]*){2,4}")

# fixed values: object identifiers of private keys' algorithms, and of password-based encryption
_KEY_ALGORITHMS = {bytes.fromhex(x) for x in (
    "2a864886f70d010101",    # RSA
    "2a864886f70d01010a",    # RSASSA-PSS
    "2a8648ce380401",        # DSA
    "2a8648ce3d0201",        # EC
    "2a864886f70d010301",    # DH
    "2b656e", "2b656f",      # X25519, X448
    "2b6570", "2b6571",      # Ed25519, Ed448
)}
_ENCRYPTION = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))    # PKCS#5 and PKCS#12
_OPENSSH = b"openssh-key-v1\0"
_FIRST = "Mblx"     # base64 characters that the keys' first bytes begin with
# fixed values: bytes of the signature by algorithm; RSA signatures are as long as the modulus, DER never
_SIGNATURE = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES256K": 64, "ES384": 96, "ES512": 132, "EdDSA": (64, 114), "Ed25519": 64,
              "Ed448": 114, **{f"{kind}{bits}": (128, 256, 384, 512, 1024, 2048) for kind in ("RS", "PS") for bits in (256, 384, 512)}}
_ENCRYPTED = {"A128GCM": (12, 16), "A192GCM": (12, 16), "A256GCM": (12, 16), "A128CBC-HS256": (16, 16), "A192CBC-HS384": (16, 24), "A256CBC-HS512": (16, 32)}


# --- DER ------------------------------------------------------------------------------


def _header(data: bytes, at: int) -> tuple[int, int, int] | None:
    """(tag, begin of the content, its length) of the element at a place, the length in its shortest form."""
    if at + 2 > len(data):
        return None
    tag, size = data[at], data[at + 1]
    if size < 0x80:
        return tag, at + 2, size
    n = size & 0x7F
    if not 1 <= n <= 4 or at + 2 + n > len(data):
        return None
    size = int.from_bytes(data[at + 2:at + 2 + n], "big")
    return (tag, at + 2 + n, size) if size >= 0x80 and (n == 1 or size >> 8 * (n - 1)) else None


def _elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """The elements that fill ``data`` exactly."""
    out, at = [], 0
    while at < len(data):
        head = _header(data, at)
        if head is None or head[1] + head[2] > len(data):
            return None
        out.append((head[0], data[head[1]:head[1] + head[2]]))
        at = head[1] + head[2]
    return out


def _is_number(element: tuple[int, bytes], positive: bool = True) -> bool:
    tag, body = element
    return tag == 2 and len(body) > 0 and not (len(body) > 1 and body[0] == 0 and body[1] < 0x80) and (not positive or body[0] < 0x80)


def _is_private_key(body: bytes) -> bool:
    """``body``: the content of the outer sequence."""
    parts = _elements(body)
    if not parts or len(parts) < 2:
        return False
    tags = [t for t, _ in parts]
    if tags[0] == 2 and parts[0][1] in (b"\0", b"\1"):
        version = parts[0][1]
        if len(parts) >= 6 and all(t == 2 for t in tags[1:9]) and all(_is_number(x) for x in parts):
            numbers = [int.from_bytes(b, "big") for _, b in parts]
            if len(parts) == 9 and version == b"\0":            # RSA: n, e, d, p, q, d mod p-1, d mod q-1, 1/q mod p
                return numbers[1] == numbers[4] * numbers[5] and numbers[1] > 1
            return len(parts) == 6 and version == b"\0" and 1 < numbers[2] < numbers[1] and numbers[5] < numbers[2]     # DSA: p, q, g, y, x
        if version == b"\1" and tags[1] == 4:                   # EC: key, [0] curve, [1] point
            return 14 <= len(parts[1][1]) <= 72 and all(t in (0xA0, 0xA1) and _elements(b) for t, b in parts[2:]) and len(parts) > 2
        if len(parts) >= 3 and tags[1] == 0x30 and tags[2] == 4 and all(t in (0xA0, 0xA1, 0x81) for t in tags[3:]):
            algorithm = _elements(parts[1][1])                  # PKCS#8
            return bool(algorithm) and algorithm[0][0] == 6 and algorithm[0][1] in _KEY_ALGORITHMS and bool(_elements(parts[2][1]))
        return False
    if tags == [0x30, 4]:                                       # encrypted PKCS#8
        algorithm = _elements(parts[0][1])
        return bool(algorithm) and len(algorithm) == 2 and algorithm[0][0] == 6 and algorithm[0][1].startswith(_ENCRYPTION) and \
            algorithm[1][0] == 0x30 and bool(_elements(algorithm[1][1])) and len(parts[1][1]) >= 8
    return False


# --- OpenSSH and OpenPGP ----------------------------------------------------------------


def _string(data: bytes, at: int) -> tuple[bytes, int] | None:
    if at + 4 > len(data):
        return None
    end = at + 4 + int.from_bytes(data[at:at + 4], "big")
    return (data[at + 4:end], end) if end <= len(data) else None


def _openssh_size(data: bytes) -> int | None:
    """Bytes of an OpenSSH private key at the beginning of ``data``: cipher, derivation, its options, public keys, private part."""
    at, cipher = len(_OPENSSH), b""
    for k in range(3):
        got = _string(data, at)
        if got is None or k < 2 and not re.fullmatch(rb"[a-z0-9@.-]{1,64}", got[0]):
            return None
        cipher, at = (got[0] if k == 0 else cipher), got[1]
    if at + 4 > len(data):
        return None
    n, at = int.from_bytes(data[at:at + 4], "big"), at + 4
    if not 1 <= n <= 16:
        return None
    for _ in range(n):
        got = _string(data, at)
        name = got and _string(got[0], 0)
        if not name or not re.fullmatch(rb"[a-z0-9@.-]{1,64}", name[0]):
            return None
        at = got[1]
    private = _string(data, at)
    if private is None or len(private[0]) < 16 or len(private[0]) % 8:
        return None
    # an open private part begins with the same check number twice
    return private[1] if cipher != b"none" or private[0][:4] == private[0][4:8] else None


def _pgp_size(data: bytes) -> int | None:
    """Bytes of the OpenPGP secret-key packet at the beginning of ``data``."""
    tag, at = data[0], 1
    if tag & 0xC0 == 0xC0:
        if len(data) < 3 or tag & 0x3F != 5:
            return None
        first = data[1]
        if first < 192:
            size, at = first, 2
        elif first < 224:
            size, at = (first - 192 << 8) + data[2] + 192, 3
        elif first == 255 and len(data) >= 6:
            size, at = int.from_bytes(data[2:6], "big"), 6
        else:
            return None
    else:
        if tag & 0x3C != 5 << 2 or tag & 3 == 3:
            return None
        n = 1 << (tag & 3)
        size, at = int.from_bytes(data[1:1 + n], "big"), 1 + n
    body = data[at:at + size]
    if len(body) < size or size < 24 or body[0] not in (4, 5, 6):
        return None
    algorithm, place = body[5], 6 + 4 * (body[0] > 4)
    if algorithm in (1, 2, 3, 16, 17):          # public numbers, each with its length in bits: RSA n e, Elgamal p g y, DSA p q g y
        for _ in range({16: 3, 17: 4}.get(algorithm, 2)):
            bits = int.from_bytes(body[place:place + 2], "big")
            end = place + 2 + (bits + 7) // 8
            if not bits or end >= size or body[place + 2].bit_length() != (bits - 1) % 8 + 1:
                return None
            place = end
        return at + size
    if algorithm in (18, 19, 22) and place < size and body[place + 1:place + 1 + body[place]].startswith((b"\x2a\x86\x48", b"\x2b")):
        return at + size                        # a curve's identifier, then its point and the secret
    return at + size if algorithm in (25, 26, 27, 28) and size - place > 32 else None


def _key_at(head: bytes, whole) -> tuple[str, int] | None:
    """(kind, bytes) of the key whose first bytes are ``head``; ``whole(n)`` decodes up to n bytes."""
    if head[:1] == b"\x30":
        outer = _header(head, 0)
        if outer is None or not 16 <= outer[2] <= KEY_BYTES or head[outer[1]:outer[1] + 1] not in (b"\x02", b"\x30"):
            return None
        end = outer[1] + outer[2]
        data = whole(end)
        return ("private_key", end) if len(data) >= end and _is_private_key(data[outer[1]:end]) else None
    if head.startswith(_OPENSSH):
        size = _openssh_size(whole(KEY_BYTES))
        return ("openssh_key", size) if size else None
    if head[:1] and head[0] in (0x94, 0x95, 0x96, 0xC5) and (size := _pgp_size(whole(KEY_BYTES))):
        return "pgp_key", size
    return None


# --- candidates -------------------------------------------------------------------------


def _base64_keys(text: str) -> Iterator[tuple[str, int, int]]:
    for run in _BASE64_RUN.finditer(text):
        breaks = [m.span() for m in _BREAKS.finditer(text, *run.span())]
        lines = list(zip([run.start(), *(b for _, b in breaks)], [*(a for a, _ in breaks), run.end()], strict=True))
        taken = 0
        for k, (begin, end) in enumerate(lines):
            if begin < taken or text[begin] not in _FIRST:
                continue
            head = _decoded(text[begin:min(end, begin + 24)])
            if not head:
                continue

            def whole(n, k=k):
                chars, size = [], 0
                for a, b in lines[k:]:
                    chars.append(text[a:b])
                    size += b - a
                    if size * 3 // 4 >= n or chars[-1].endswith("="):
                        break
                return _decoded("".join(chars))

            found = _key_at(head, whole)
            if found:
                left = -(-found[1] // 3) * 4            # characters of the encoding, with its padding
                for a, b in lines[k:]:
                    if left <= b - a or (a, b) == lines[-1]:
                        taken = a + min(left, b - a)
                        break
                    left -= b - a
                yield found[0], begin, taken


def _decoded(chars: str) -> bytes:
    chars = chars.partition("=")[0]
    try:
        return base64.b64decode(chars[:len(chars) - (len(chars) % 4 == 1)] + "=" * (-len(chars) % 4 % 3))
    except binascii.Error:
        return b""


def _hex_keys(text: str) -> Iterator[tuple[str, int, int]]:
    for run in _HEX_RUN.finditer(text):
        begin, end = run.span()
        found = _key_at(bytes.fromhex(text[begin:begin + 48]), lambda n: bytes.fromhex(text[begin:min(begin + 2 * n, end - (end - begin) % 2)]))  # noqa: B023
        if found:
            yield found[0], begin, begin + 2 * found[1]


def _segment(chars: str) -> bytes | None:
    try:
        return None if len(chars) % 4 == 1 else base64.urlsafe_b64decode(chars + "=" * (-len(chars) % 4))
    except binascii.Error:
        return None


def _object(data: bytes | None) -> dict | None:
    try:
        found = json.loads(data.decode("utf-8")) if data and data.lstrip()[:1] == b"{" else None
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _tokens(text: str) -> Iterator[tuple[str, int, int]]:
    for run in _TOKEN.finditer(text):
        parts = run[0].split(".")
        header = _object(_segment(parts[0]))
        if header is None or not isinstance(header.get("alg"), str):
            continue
        if "enc" in header:
            sizes = _ENCRYPTED.get(header["enc"]) if isinstance(header["enc"], str) else None
            if sizes and len(parts) == 5:
                fields = [_segment(p) for p in parts[1:]]
                if None not in fields and (len(fields[1]), len(fields[3])) == sizes and fields[2]:
                    yield "encrypted_token", *run.span()
            continue
        size, signature = _SIGNATURE.get(header["alg"]), _segment(parts[2])
        if size and signature and len(signature) in (size if isinstance(size, tuple) else (size,)):
            payload = _segment(parts[1])
            if payload and (header.get("b64") is False or _object(payload) is not None or "cty" in header):
                yield "signed_token", run.start(), run.start() + sum(map(len, parts[:3])) + 2


def _has_run(data: bytes, n: int) -> bool:
    """Whether n characters in a row are of the base64 and base64url alphabets: no hex run, key or signed token does without."""
    others = np.flatnonzero(_OTHER[np.frombuffer(data, np.uint8)])
    return bool(np.diff(others, prepend=-1, append=len(data)).max(initial=0) > n)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the three plain patterns."""
    data = text.encode("utf-8")
    low, out = data.lower(), []
    if any(word in low for word in _ASSIGN_WORDS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    if b"AKIA" in data:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    if _has_run(data, HEX_CHARS):
        out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


def confirmed_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of encoded keys and tokens whose structure is whole."""
    if not _has_run(text.encode("utf-8"), RUN_CHARS):
        return []
    return [*_base64_keys(text), *_hex_keys(text), *_tokens(text)]


def _in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))


def scan(df: DataFrame, text: str = "text", out: str = "secrets") -> DataFrame:
    """``df`` with ``out``: the secrets of a text column as an array of (kind, start, stop), by start, then kind."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    @F.arrow_udf(_SPANS)
    def found(texts: pa.Array) -> pa.Array:
        rows = [_in_order(base_spans(t) + confirmed_spans(t)) if t else [] for t in texts.to_pylist()]
        return pa.array([[{"kind": k, "start": a, "stop": b} for k, a, b in row] for row in rows], kind)

    return df.withColumn(out, found(F.col(text).cast("string")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op12_secrets(docs: DataFrame) -> DataFrame:
    def of(*kinds: str) -> Column:
        return F.filter("secrets", lambda s: s["kind"].isin(*kinds))

    found = scan(docs.select("doc_id", "text"))
    count = [F.size(of(kind)).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select("doc_id", *count, F.sha2(_joined(of(*BASE_KINDS)), 256).alias("base_sha256"), _joined(F.col("secrets")).alias("spans"))
