"""MurmurHash3 x86_128 of 8-byte little-endian keys, vectorised; seed 0. Its low 64 bits place keys in shards."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_C = [np.uint32(c) for c in (0x239B961B, 0xAB0E9789, 0x38B34AE5, 0xA1E38B93)]


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint32(r)) | (x >> np.uint32(32 - r))


def _final(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint32(16))
    h = h * np.uint32(0x85EBCA6B)
    h = h ^ (h >> np.uint32(13))
    h = h * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def murmur3_low64(keys: np.ndarray) -> np.ndarray:
    """The low 64 bits for uint64 keys. Eight bytes are all tail: they enter the first two lanes."""
    keys = keys.astype(np.uint64)
    low, high = (keys & np.uint64(0xFFFFFFFF)).astype(np.uint32), (keys >> np.uint64(32)).astype(np.uint32)
    h1 = _rot(low * _C[0], 15) * _C[1]
    h2 = _rot(high * _C[1], 16) * _C[2]
    n = np.uint32(8)
    h1, h2, h3, h4 = h1 ^ n, h2 ^ n, np.full_like(h1, n), np.full_like(h1, n)
    h1 = h1 + h2 + h3 + h4
    h2, h3, h4 = h2 + h1, h3 + h1, h4 + h1
    h1, h2, h3, h4 = (_final(h) for h in (h1, h2, h3, h4))
    h1 = h1 + h2 + h3 + h4
    h2 = h2 + h1
    return h1.astype(np.uint64) | (h2.astype(np.uint64) << np.uint64(32))


def murmur3_x86_128(body: bytes, seed: int = 0) -> int:
    """The 128 bits for bytes of any length, as a number whose lowest 32 bits are the first lane."""
    mask = 0xFFFFFFFF
    rot = lambda x, r: ((x << r) | (x >> (32 - r))) & mask
    c, h = [int(k) for k in _C], [seed & mask] * 4
    turn, after, add = (15, 16, 17, 18), (19, 17, 15, 13), (0x561CCD1B, 0x0BCAA747, 0x96CD1C35, 0x32AC3B17)
    scramble = lambda k, i: rot(k * c[i] & mask, turn[i]) * c[(i + 1) % 4] & mask
    whole = len(body) // 16 * 16
    for at in range(0, whole, 16):
        for i in range(4):
            h[i] ^= scramble(int.from_bytes(body[at + 4 * i : at + 4 * i + 4], "little"), i)
            h[i] = (rot(h[i], after[i]) + h[(i + 1) % 4]) * 5 + add[i] & mask
    for i in range(3, -1, -1):
        if part := body[whole + 4 * i : whole + 4 * i + 4]:
            h[i] ^= scramble(int.from_bytes(part, "little"), i)
    h = [x ^ len(body) for x in h]
    for final in (True, False):
        h[0] = sum(h) & mask
        h = [h[0], *((x + h[0]) & mask for x in h[1:])]
        if final:
            h = [int(x) for x in _final(np.array(h, np.uint32))]
    return h[0] | h[1] << 32 | h[2] << 64 | h[3] << 96


def murmur3_x86_128_low(column: str) -> Column:
    """As a BIGINT bit pattern."""

    @F.arrow_udf("long")
    def hashed(keys: pa.Array) -> pa.Array:
        return pa.array(murmur3_low64(keys.to_numpy(zero_copy_only=False).view(np.uint64)).view(np.int64))

    return hashed(F.col(column).cast("long"))
