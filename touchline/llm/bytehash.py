"""Hashes over all positions of a text at once, with numpy.

A byte maps to a fixed random 64-bit number T; the hash of a span is the sum of T[byte] * R**i,
i counted from its start, modulo 2**64 (R odd). Prefix sums give the hash of any span.
"""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20240229)
T = _RANDOM.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INV = np.uint64(pow(int(R), -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 to base**(n - 1)."""
    out = np.ones(max(n, 1), np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(int(base), done, 1 << 64))
        done += step
    return out


#: Powers by size, made once in a task. (functools.cache would travel by name and need the package on executors.)
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if size not in _TABLES:
        _TABLES[size] = powers(R, size), powers(_R_INV, size + 1)
    return _TABLES[size]


class Spans:
    """Hashes of spans of one byte array."""

    def __init__(self, data: np.ndarray):
        forth, self.back = _tables(1 << max(16, len(data).bit_length()))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(T[data] * forth[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.back[start]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose high bits depend on all bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def windows_of(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the `width` bytes from every position on where as many follow; width is a power of two."""
    h = T[data]
    done = 1
    while done < width:
        h = h[:-done] + h[done:] * np.uint64(pow(int(R), done, 1 << 64)) if len(h) > done else h[:0]
        done *= 2
    return mix(h)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one string of bytes."""
    return b"".join([np.array([len(a) for a in arrays], "<i8").tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    at, out = 8 * len(kinds), []
    for n, kind in zip(np.frombuffer(blob, "<i8", len(kinds)), kinds, strict=True):
        out.append(np.frombuffer(blob, kind, n, at))
        at += out[-1].nbytes
    return out


def starts_of(*sorted_keys: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before in any key."""
    new = np.ones(len(sorted_keys[0]), bool)
    if len(new):
        new[1:] = False
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return new
