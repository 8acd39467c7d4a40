"""Golomb-Rice coding of sorted unsigned 64-bit integers, whole arrays at a time.

Gaps are split at ``k`` bits: the quotients are written in unary in one bit stream, the remainders with k bits
each in a second one, so that both directions are numpy operations without a loop over values.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QQBQ")  # number of values, first value, k, bytes of the unary stream


def encode(values: np.ndarray) -> bytes:
    """Code of a non-empty or empty array of ascending uint64 values."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    if n < 2:
        return _HEAD.pack(n, int(values[0]) if n else 0, 0, 0)
    gaps = values[1:] - values[:-1]
    mean = max(1.0, float(values[-1] - values[0]) / (n - 1))
    k = max(0, min(63, int(np.log2(mean * 0.69314718))) if mean > 2 else 0)
    quotient = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotient + 1)
    unary = np.ones(int(ends[-1]), np.uint8)
    unary[ends - 1] = 0
    head = np.packbits(unary).tobytes()
    rest = b""
    if k:
        low = gaps & np.uint64((1 << k) - 1)
        bits = (low[:, None] >> np.arange(k - 1, -1, -1, dtype=np.uint64)[None, :]).astype(np.uint8) & 1
        rest = np.packbits(bits.ravel()).tobytes()
    return _HEAD.pack(n, int(values[0]), k, len(head)) + head + rest


def decode(code: bytes) -> np.ndarray:
    """The values of a code."""
    n, first, k, size = _HEAD.unpack_from(code)
    if n < 2:
        return np.full(n, first, np.uint64)
    body = np.frombuffer(code, np.uint8, offset=_HEAD.size)
    ends = np.flatnonzero(np.unpackbits(body[:size]) == 0)[: n - 1]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64)
    if k:
        bits = np.unpackbits(body[size:])[: (n - 1) * k].reshape(n - 1, k)
        low = np.zeros(n - 1, np.uint64)
        for column in bits.T:
            low = (low << np.uint64(1)) | column
        gaps = (gaps << np.uint64(k)) | low
    out = np.empty(n, np.uint64)
    out[0] = first
    out[1:] = np.uint64(first) + np.cumsum(gaps, dtype=np.uint64)
    return out
