"""Terms of texts as dictionary codes: maximal runs of one byte class, A-Z folded into a-z, compared by their bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .textscan import byte_class

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def term_class(kind: str) -> np.ndarray:
    """``alnum``: ASCII letters and digits and all non-ASCII; ``letter``: the same without digits."""
    t = byte_class("alnum").copy()
    if kind == "letter":
        t[0x30:0x3A] = False
    elif kind != "alnum":
        raise ValueError(kind)
    return t


def coded(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Terms before each text's bound, the code of each term, and the distinct terms that codes point to."""
    n = len(data)
    w = table[data]
    prev = np.zeros(n, dtype=bool)
    prev[1:] = w[:-1]
    prev[offs[(offs > 0) & (offs < n)]] = False
    start = np.flatnonzero(w & ~prev)
    before = np.concatenate([[0], np.cumsum(w)])  # term bytes before each byte
    packed = _LOWER[data[w]]
    ends = np.append(before[start], len(packed)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(packed))])
    d = words.dictionary_encode()
    return np.searchsorted(start, offs), d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def coded_column(column) -> tuple[np.ndarray, pa.Array]:
    """Codes of a string column without nulls, and the distinct strings."""
    d = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def sums(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys and the exact 64-bit sums of each value over them."""
    if not len(key):
        return (key, *values)
    o = np.argsort(key, kind="stable")
    k = key[o]
    cut = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    return (k[cut], *(np.add.reduceat(v[o], cut) for v in values))
