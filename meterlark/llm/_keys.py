"""Sorted sets of numbers as compact bytes, split by range into buckets."""

from __future__ import annotations

import numpy as np
import zstandard

#: Shorter payloads aren't worth a compressor.
PLAIN = 512


def squeezed(raw: bytes) -> bytes:
    return b"\x01" + zstandard.ZstdCompressor(level=1).compress(raw) if len(raw) >= PLAIN else b"\x00" + raw


def unsqueezed(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw[1:]) if raw[:1] == b"\x01" else raw[1:]


def planes(x: np.ndarray) -> bytes:
    """Unsigned 64-bit numbers byte plane by byte plane, as many planes as the largest needs."""
    if not len(x):
        return b"\x00"
    width = max(1, (int(x.max()).bit_length() + 7) // 8)
    return bytes([width]) + squeezed(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())


def unplaned(raw: bytes) -> np.ndarray:
    width = raw[0]
    if not width:
        return np.zeros(0, np.uint64)
    got = np.frombuffer(unsqueezed(raw[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((got.shape[1], 8), np.uint8)
    out[:, :width] = got.T
    return out.view("<u8").reshape(-1)


def packed(keys: np.ndarray) -> bytes:
    """Ascending numbers as differences."""
    return planes(np.diff(keys, prepend=keys[:1] * 0)) if len(keys) else planes(keys)


def unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(unplaned(raw), dtype=np.uint64)


def bits(flags: np.ndarray) -> bytes:
    return squeezed(np.packbits(flags).tobytes())


def unbits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(unsqueezed(raw), np.uint8), count=n).astype(bool)


def cuts(keys: np.ndarray, buckets: int, width: int) -> np.ndarray:
    """Where each of so many equal ranges of width-bit numbers begins in ascending keys, and the end."""
    edges = [np.uint64((i << width) // buckets) for i in range(1, buckets)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(edges, np.uint64)), [len(keys)]]).astype(np.int64)
