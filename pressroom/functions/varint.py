"""Runs of non-negative integers as variable-length bytes (7 bits a byte, low bits first), whole arrays at a time."""

from __future__ import annotations

import numpy as np


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bytes taken by each value)."""
    v = np.asarray(values).astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for shift in range(7, 64, 7):
        more = v >= (np.uint64(1) << np.uint64(shift))
        if not more.any():
            break
        size += more
    starts = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for j in range(int(size.max(initial=0))):
        has = size > j
        part = (v[has] >> np.uint64(7 * j)).astype(np.uint64) & np.uint64(127)
        out[starts[has] + j] = part.astype(np.uint8) | np.where(size[has] > j + 1, 128, 0).astype(np.uint8)
    return out, size


def decode(data: bytes | np.ndarray) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8) if isinstance(data, (bytes, bytearray, memoryview)) else data
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    out = np.zeros(len(ends), np.int64)
    for j in range(int((ends - starts).max(initial=-1)) + 1):
        has = starts + j <= ends
        out[has] |= (raw[starts[has] + j] & 127).astype(np.int64) << (7 * j)
    return out
