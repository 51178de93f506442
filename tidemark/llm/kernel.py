"""Vectorised text kernels over Arrow string buffers: words, 64-bit word hashes, byte-bounded slices.

All of them work on the concatenated UTF-8 bytes of many texts, so no Python object is made per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
# Freed buffers go back to the system: a worker that waits for its next task holds no memory of the last one.
pa.set_memory_pool(pa.system_memory_pool())
#: Bytes of text handled at once; bounds the temporaries of every kernel (a longer text is a slice of its own).
SLICE = 1 << 20

WS = np.zeros(256, bool)
WS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_P, _PI = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


with np.errstate(over="ignore"):
    _BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_pow: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n + 1:
        m = max(n + 1, SLICE + 1)
        for k, p in enumerate((_P, _PI)):
            x = np.full(m, p, U)
            x[0] = 1
            _pow[k] = np.multiply.accumulate(x)
    return _pow[0], _pow[1]


def strings(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    off = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8)[off[0] : off[-1]] if buf is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def trim() -> None:
    """Gives the heap's free pages back, at the end of a task."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = j


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = ~WS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte ranges of the words, runs of the bytes ``inside``, and for each text the index of its first word
    (one more at the end)."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    w = inside[data]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, w[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after[-1], after[:-1] = False, w[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range that depends on its bytes alone."""
    p, inv = _powers(len(data))
    with np.errstate(over="ignore"):
        h = np.empty(len(data) + 1, U)
        h[0] = 0
        np.cumsum(_BYTE[data] * p[: len(data)], out=h[1:])
        return mix((h[ends] - h[starts]) * inv[starts] + U(1))


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of the runs of ``k`` words of each text; a shorter text is one run, an empty one none."""
    out, off = [], np.zeros(len(first), np.int64)
    counts = np.diff(first)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    off[1:] = np.cumsum(n)
    with np.errstate(over="ignore"):
        mul = mix(np.arange(1, k + 1, dtype=U) * U(0xD1342543DE82EF95)) | U(1)
        run = np.zeros(len(h), U)
        m = len(h) - k + 1
        if m > 0:
            for j in range(k):
                run[:m] += h[j : j + m] * mul[j]
        take = np.repeat(first[:-1] - off[:-1], n) + np.arange(off[-1])
        out = run[take]
        for i in np.flatnonzero((counts > 0) & (counts < k)):
            w = h[first[i] : first[i + 1]]
            out[off[i]] = (w * mul[: len(w)]).sum(dtype=U) + U(0x632BE59BD9B4E019) * U(len(w))
        return mix(out), off
