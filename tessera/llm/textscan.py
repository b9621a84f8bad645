"""Vectorised word scanning over Arrow string columns.

A word is a maximal run of bytes of one class. All texts of a chunk are scanned
at once in numpy: word bounds from a byte table, 64-bit word hashes from one
prefix sum of ``T[byte] * P**i`` whose difference over a word, divided by
``P**start``, does not depend on where the word stands. Whole texts only; chunks
bound the working memory at some tens of bytes per byte of the larger of
``CHUNK_BYTES`` and the longest text.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_P = 0x9E3779B97F4A7C13  # 3 mod 8: powers differ in low bits too
_MASK = (1 << 64) - 1


def _inverse(p: int) -> int:
    return pow(p, -1, 1 << 64)


def byte_class(name: str) -> np.ndarray:
    """``space``: everything but ASCII white space; ``alnum``: ASCII letters and digits and all non-ASCII."""
    t = np.ones(256, dtype=bool)
    if name == "space":
        t[[0x20, *range(0x09, 0x0E)]] = False
    elif name == "alnum":
        t[:0x80] = False
        for a, b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
            t[a:b] = True
    else:
        raise ValueError(name)
    return t


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of the 64-bit murmur hash, in place on a copy."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _byte_values(lower: bool) -> np.ndarray:
    t = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    if lower:
        t[0x41:0x5B] = t[0x61:0x7B]
    return t


class Words(NamedTuple):
    """Words of consecutive texts: ``first[i]:first[i+1]`` are those of text i."""

    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    data: np.ndarray


class Scanner:
    """Scans texts for words of a byte class; ``lower`` folds A-Z into a-z."""

    def __init__(self, kind: str, lower: bool = True):
        self.table, self.values = byte_class(kind), _byte_values(lower)
        self.pw = self.ipw = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.pw) <= n:
            m = max(CHUNK_BYTES + 1, n + 1)
            for name, p in (("pw", _P), ("ipw", _inverse(_P))):
                a = np.full(m, p, dtype=np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))

    def bounds(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        w = self.table[data]
        prev = np.empty(n, dtype=bool)
        prev[1:], prev[:1] = w[:-1], False
        nxt = np.empty(n, dtype=bool)
        nxt[:-1], nxt[-1:] = w[1:], False
        inner = offs[(offs > 0) & (offs < n)]
        prev[inner] = False
        nxt[inner - 1] = False
        return np.flatnonzero(w & ~prev), np.flatnonzero(w & ~nxt) + 1

    def scan(self, data: np.ndarray, offs: np.ndarray) -> Words:
        """``offs``: bounds of the texts in ``data``, from 0 to its length."""
        start, end = self.bounds(data, offs)
        self._powers(len(data))
        c = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.values[data] * self.pw[: len(data)], out=c[1:])
        h = mix64((c[end] - c[start]) * self.ipw[start] + (end - start).astype(np.uint64))
        return Words(np.searchsorted(start, offs), start, end, h, data)

    def counts(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        start, _ = self.bounds(data, offs)
        return np.diff(np.searchsorted(start, offs))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    a = column.cast(pa.large_binary())
    if a.null_count:
        a = a.fill_null(b"")
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset : a.offset + len(a) + 1]
    buf = a.buffers()[2]
    data = np.frombuffer(buf, dtype=np.uint8) if buf is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(column, size: int = CHUNK_BYTES):
    """(first row, last row + 1, bytes, offsets) of slices of about ``size`` bytes, whole texts each."""
    data, offs = utf8(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, side="right")) - 1)
        j = min(n, j)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


_MULT = [0xA24BAED4963EE407 | 1, 0x9FB21C651E98DF25, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7, 0xAEF17502108EF2D9, 0xDB4F0B9175AE2165]


def ngrams(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of n word hashes; ``len(h) - n + 1`` of them. Runs may cross texts: the caller drops those."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    x = np.full(m, (seed * 0x2545F4914F6CDD1D + n) & _MASK, dtype=np.uint64)
    p = 1
    for j in range(n):
        p = p * _MULT[j % len(_MULT)] & _MASK
        x += h[j : j + m] * np.uint64(p)
    return mix64(x)
