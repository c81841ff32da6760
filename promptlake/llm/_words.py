"""Vectorised word splitting and hashing over UTF-8 buffers (numpy inside Spark tasks).

A batch of texts is one flat byte buffer. Words are the maximal runs of bytes other than
``[\\x20\\x09-\\x0D]`` (those bytes never occur inside a multi-byte UTF-8 sequence). Word and
window hashes are 64-bit and depend on nothing but the bytes, so every task and every retry
computes the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20  # text bytes handled at once; bounds the memory of the temporaries

_U = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_P = 0x9E3779B97F4A7C15  # odd, 5 mod 8
_PINV = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64, grown on demand and kept per process."""
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        p = np.full(size, base, dtype=np.uint64)
        p[0] = 1
        have = _powers[key] = np.cumprod(p, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (bijective)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x = x * _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


class Words:
    """Words of a run of texts: byte bounds, hash and text number of each; word bounds of each text."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lower: bool = False):
        buf = _LOWER[buf] if lower else buf
        n = len(buf)
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        solid = ~_SPACE[buf]
        before = np.empty(n, dtype=bool)
        before[:1] = False
        before[1:] = solid[:-1]
        self.starts = np.flatnonzero(solid & (~before | edge[:-1]))
        after = np.empty(n, dtype=bool)
        after[-1:] = False
        after[:-1] = solid[1:]
        self.ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[buf] * _power(_P, n), out=sums[1:])
        h = (sums[self.ends] - sums[self.starts]) * _power(_PINV, n + 1)[self.starts]
        self.hash = mix(h)
        self.bounds = np.searchsorted(self.starts, offsets)
        self.buf = buf

    def windows(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; defined for all but the last k-1 words of the run.

        A window that crosses the end of a text is meaningless; callers use ``bounds``.
        """
        return window_hash(self.hash, k)


def window_hash(h: np.ndarray, k: int) -> np.ndarray:
    n = max(len(h) - k + 1, 0)
    out = np.full(n, _U(k))
    for j in range(k):
        out *= _U(0xD6E8FEB86659FD93)
        out += h[j : j + n]
        out ^= out >> _U(32)
    return mix(out)


def shingles(w: Words, k: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct k-word shingle hashes; a shorter text is one shingle; no words: none."""
    g = w.windows(k)
    for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True):
        if b - a >= k:
            yield np.unique(g[a : b - k + 1])
        elif b > a:
            yield window_hash(w.hash[a:b], int(b - a))
        else:
            yield np.empty(0, dtype=np.uint64)


def chunks(text: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string array into runs of whole texts of about ``size`` bytes: (first, end, buffer, offsets).

    Nulls count as empty texts."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if text.null_count:
        text = text.fill_null("")
    if not pa.types.is_large_string(text.type):
        text = text.cast(pa.large_string())
    n = len(text)
    if n == 0:
        return
    _, offs, data = text.buffers()
    off = np.frombuffer(offs, dtype=np.int64)[text.offset : text.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, side="right")) - 1)
        yield a, b, raw[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b
