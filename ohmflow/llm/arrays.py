"""Words of Arrow text columns as numpy arrays.

A column is cut into slices of whole rows of about ``SLICE_BYTES`` (a longer
text is a slice of its own), so memory inside a task is bounded by the longest
text. Each word gets a 64-bit polynomial hash over randomised bytes, taken
from prefix sums for all words of a slice at once. Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64 (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbered(seed: int, n: int) -> np.ndarray:
    """n reproducible pseudo-random uint64 values."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * _STEP)


_BYTE = numbered(7, 256)
_BITS = 14
_BLOCK = 1 << _BITS


def _powers(base: int, n: int) -> np.ndarray:
    """The first n powers of ``base``, modulo 2^64."""
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.cumprod(p, dtype=np.uint64)


#: powers below the block size; a greater one is a product of two, so that a worker
#: keeps no table as long as its longest slice
_LOW, _LOW_INVERSE = _powers(_BASE, _BLOCK), _powers(_INVERSE, _BLOCK)
_JUMP, _JUMP_INVERSE = pow(_BASE, _BLOCK, 1 << 64), pow(_INVERSE, _BLOCK, 1 << 64)


def _prefix_sums(data: np.ndarray) -> np.ndarray:
    """Running sums of byte value times power of its place, block by block in place."""
    sums = np.zeros(len(data) + 1, np.uint64)
    jumps = _powers(_JUMP, len(data) // _BLOCK + 1)
    for k, lo in enumerate(range(0, len(data), _BLOCK)):
        part = _BYTE[data[lo:lo + _BLOCK]]
        part *= _LOW[:len(part)]
        part *= jumps[k]
        part[:1] += sums[lo]
        np.cumsum(part, out=sums[lo + 1:lo + 1 + len(part)])
    return sums


def _table(separators: list[tuple[int, int]]) -> np.ndarray:
    t = np.ones(256, bool)
    for lo, hi in separators:
        t[lo:hi + 1] = False
    return t


#: words ``[^\x20\x09-\x0D]+``
SPACED = _table([(0x20, 0x20), (0x09, 0x0D)])
#: words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of text lower-cased in A-Z
ALNUM = _table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words(NamedTuple):
    data: np.ndarray    # bytes of the slice (lower-cased in A-Z if asked for)
    off: np.ndarray     # byte offset of each text, one more than texts
    first: np.ndarray   # index of each text's first word, one more than texts
    start: np.ndarray   # byte range of each word
    end: np.ndarray
    hash: np.ndarray    # uint64 of each word
    sums: np.ndarray    # prefix sums behind the hashes


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``max_bytes`` of text, at least one row each."""
    sizes = np.asarray(pc.binary_length(column).fill_null(0))
    lo, size = 0, 0
    for i, s in enumerate(sizes):
        if i > lo and size + s > max_bytes:
            yield lo, i
            lo, size = i, 0
        size += int(s)
    if lo < len(sizes):
        yield lo, len(sizes)


def span_hash(w_sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans of a slice."""
    jumps = _powers(_JUMP_INVERSE, len(w_sums) // _BLOCK + 1)
    h = w_sums[end] - w_sums[start]
    h *= _LOW_INVERSE[start & (_BLOCK - 1)]
    h *= jumps[start >> _BITS]
    return mix(h + (end - start).astype(np.uint64) * _STEP)


def words(texts: pa.Array, table: np.ndarray, lower: bool = False) -> Words:
    """Words of every text of a slice (runs of bytes that ``table`` marks)."""
    texts = texts.fill_null("").cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0]:off[-1]] if raw is not None and off[-1] > off[0] \
        else np.zeros(0, np.uint8)
    off = off - off[0]
    if lower:
        data = _LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
    end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
    sums = _prefix_sums(data)
    first = np.searchsorted(start, off)
    return Words(data, off, first, start, end, span_hash(sums, start, end), sums)


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(_BASE) + h[k:k + n]
    return mix(out + np.uint64(size))


def ragged(values: np.ndarray, first: np.ndarray, type_=None) -> pa.Array:
    """List column from flat values and row bounds."""
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, type=type_))
