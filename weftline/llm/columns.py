"""Columns of whole numbers as compressed bytes, for rows that carry many numbers through a shuffle."""

from __future__ import annotations

import numpy as np
import zstandard


def pack_numbers(*columns: np.ndarray) -> bytes:
    """64-bit numbers of each column, the first bytes of all together, then the second ones, and so on, compressed."""
    head = np.array([len(columns), *map(len, columns)], "<u8").tobytes()
    body = []
    for x in columns:
        x = x.astype(np.uint64)
        used = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
        body += [(x >> np.uint64(8 * k)).astype(np.uint8).tobytes() for k in range(used)]
        body.append(bytes(len(x) * (8 - used)))
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head, *body]))


def unpack_numbers(raw: bytes) -> list[np.ndarray]:
    """The columns of ``pack_numbers``, as unsigned numbers."""
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    at, found = 8 * (n + 1), []
    for size in np.frombuffer(raw, "<u8", n, 8).tolist():
        planes = np.frombuffer(raw, np.uint8, 8 * size, at).reshape(8, size)
        found.append(np.ascontiguousarray(planes.T).view("<u8").ravel())
        at += 8 * size
    return found


def steps(values: np.ndarray) -> np.ndarray:
    """The first number and the difference of each other one from the one before, modulo 2**64."""
    values = values.astype(np.uint64)
    return np.diff(values, prepend=np.zeros(1, np.uint64))


def from_steps(differences: np.ndarray) -> np.ndarray:
    return np.cumsum(differences, dtype=np.uint64)
