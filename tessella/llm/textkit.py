"""Vectorised text kernels: blocks of texts as bytes, word hashes, n-gram hashes, sliding minima.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.  All kernels work on numpy arrays over blocks of about
a quarter megabyte (one text at least), so memory is bounded by the longest text and not by the Arrow batch.
A 64-bit hash stands for a word or an n-gram.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

U = np.uint64
_RNG = np.random.default_rng(20240229)
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_FOLDED = _TABLE[LOWER]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
CHUNK = 1 << 19
_UP, _DOWN = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(CHUNK - 1, U(x))]), dtype=np.uint64) for x in (_BASE, _INVERSE))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def blocks(texts: pa.Array, target: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) for runs of rows of about ``target`` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if len(texts) == 0:
        return
    raw = texts.buffers()
    offs = np.frombuffer(raw[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + target, "right")) - 1)
        hi = min(hi, len(texts))
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of every word, its end, index of each text's first word with the total appended)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs, "left")


def word_hashes(data: np.ndarray, offs: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, index of each text's first word with the total appended)."""
    starts, ends, at = word_bounds(data, offs)
    return hashed(data, starts, ends, fold), at


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """The hash of each run of bytes; runs are in order and do not overlap."""
    # Running sums by chunk: nothing but the runs themselves grows with a long text.
    at_start, at_end, shift = np.empty(len(starts), U), np.empty(len(starts), U), np.empty(len(starts), U)
    before, values = U(0), _FOLDED if fold else _TABLE
    for lo in range(0, len(data), CHUNK):
        part = data[lo : lo + CHUNK]
        scale, back = U(pow(_BASE, lo, 2**64)), U(pow(_INVERSE, lo, 2**64))
        total = np.empty(len(part) + 1, U)
        total[0] = before
        np.cumsum(values[part] * _UP[: len(part)] * scale, out=total[1:])
        total[1:] += before
        a, z = np.searchsorted(starts, [lo, lo + len(part)])
        at_start[a:z] = total[starts[a:z] - lo]
        shift[a:z] = _DOWN[starts[a:z] - lo] * back
        a, z = np.searchsorted(ends, [lo + 1, lo + len(part) + 1])
        at_end[a:z] = total[ends[a:z] - lo]
        before = total[-1]
    return mix((at_end - at_start) * shift + (ends - starts).astype(U))


def ngrams(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Hashes of all runs of ``n`` words; with fewer words, one hash of the whole sequence; without words, none."""
    if len(words) == 0:
        return words
    n = min(n, len(words))
    m = len(words) - n + 1
    out = np.full(m, U(n))
    for i in range(n):
        out = out * U(0xD6E8FEB86659FD93) + words[i : i + m]
    return mix(out)


def shingles_of(texts: pa.Array, n: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-gram hashes of its text) for every row."""
    for lo, hi, data, offs in blocks(texts):
        words, at = word_hashes(data, offs)
        for i in range(hi - lo):
            yield lo + i, np.unique(ngrams(words[at[i] : at[i + 1]], n))


def sliding(x: np.ndarray, w: int, f: np.ufunc) -> np.ndarray:
    """f over every window of ``w`` values, by doubling."""
    size = 1
    while size * 2 <= w:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[: len(x) - (w - size)], x[w - size :]) if size < w else x


def packed(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A list column from numpy arrays."""
    offs = np.zeros(len(arrays) + 1, np.int64)
    np.cumsum([len(a) for a in arrays], out=offs[1:])
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(flat, kind))


def release() -> None:
    """Give freed memory back to the system: Python workers are used again by later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def freeing(f: Callable) -> Callable:
    """A batch function that releases memory when its partition ends."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            release()

    return run


def freeing_group(f: Callable) -> Callable:
    """The same for a function of one group."""

    def run(group):
        try:
            return f(group)
        finally:
            release()

    return run


def freeing_cogroup(f: Callable) -> Callable:
    """The same for a function of two groups."""

    def run(left, right):
        try:
            return f(left, right)
        finally:
            release()

    return run


def row_digest(*columns: str) -> Column:
    """128 bits that tell rows apart by these columns alone; null differs from any value."""
    return F.unhex(F.md5(F.to_json(F.struct(*columns)).cast("binary")))
