"""Byte n-grams of many texts at once, as numbers."""

from __future__ import annotations

import numpy as np

PAD = 8


def padded(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with PAD line feeds before each and after the last; offsets of the texts' first bytes in it, and its end."""
    view, gap = memoryview(np.ascontiguousarray(data)), b"\n" * PAD
    parts = [gap]
    for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
        parts += (view[a:b], gap)
    return np.frombuffer(b"".join(parts), np.uint8), off + PAD * np.arange(1, len(off) + 1)


def grams(buffer: np.ndarray, size: int) -> np.ndarray:
    """At each byte the number made of the `size` bytes that end there, the last one lowest; size at most 7."""
    out = buffer.astype(np.int64)
    for k in range(1, size):
        out[k:] |= buffer[:-k].astype(np.int64) << (8 * k)
    return out


def slots(keys: np.ndarray, bits: int) -> np.ndarray:
    """Multiplicative hash of the keys to 0 .. 2^bits - 1."""
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def text_sums(values: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sum of values at the bytes of each text; 0 for an empty text."""
    total = np.r_[0.0, np.cumsum(values, dtype=np.float64)]
    return total[at[:-1] + size] - total[at[:-1]]
