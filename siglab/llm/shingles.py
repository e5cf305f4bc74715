"""Word shingles of whole texts as hashes, computed for many documents at once in numpy.

A word is a maximal run of bytes above 0x20 of the UTF-8 text. A shingle is ``width`` consecutive words; a text
with fewer words (but at least one) has one shingle of all of them; a text without words has none. Nulls count
as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WIDTH = 5
THRESHOLD = 0.8
#: Bytes of text that are hashed together; a longer text makes a block of its own.
BLOCK_BYTES = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_LOW = 1 << 16
_POWERS = np.cumprod(np.concatenate([[np.uint64(1)], np.full(_LOW, _BASE)]))


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and where each value begins and the last ends."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, where, data = column.buffers()
    bounds = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1] if where else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data and len(bounds) else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def blocks(bounds: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive values that hold about ``limit`` bytes."""
    first, n = 0, len(bounds) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = last


def words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word, and for each value the place of its first word (and the number of words last)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(bounds), np.int64)
    inside = raw > 32
    edge = np.zeros(len(raw) + 1, bool)
    edge[bounds] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, bounds)


def word_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = stops - starts
    total = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(total[-1]) - np.repeat(total[:-1] - starts, size)
    inner = at - np.repeat(starts, size)
    if size.max() <= _LOW:
        power = _POWERS[inner]
    else:
        high = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(size.max() >> 16) + 1, _POWERS[_LOW])]))
        power = _POWERS[inner & (_LOW - 1)] * high[inner >> 16]
    summed = np.add.reduceat((raw[at].astype(np.uint64) + np.uint64(1)) * power, total[:-1])
    return mix(summed ^ (size.astype(np.uint64) << np.uint64(40)))


def shingle_hashes(raw: np.ndarray, bounds: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each shingle in text order (repeats included), and where each value's shingles begin."""
    starts, stops, first = words(raw, bounds)
    hashed = word_hashes(raw, starts, stops)
    count = np.diff(first)
    n = np.where(count > 0, np.maximum(count - width + 1, 1), 0)
    begin = np.concatenate([[0], np.cumsum(n)])
    if not begin[-1]:
        return np.zeros(0, np.uint64), begin
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], n)
    short = bool((count[count > 0] < width).any()) if len(count) else False
    end = np.repeat(first[1:], n) if short else None
    out, padded = hashed[at], np.concatenate([hashed, np.zeros(width, np.uint64)])
    power = np.cumprod(np.full(width, _STEP))
    for k in range(1, width):
        term = padded[at + k] * power[k - 1]
        if short:
            term[at + k >= end] = 0
        out = out + term
    return mix(out), begin


def distinct(hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each value's distinct hashes in ascending order, where they begin, and how often each occurs."""
    owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.lexsort((hashes, owner)) if len(hashes) else np.zeros(0, np.int64)
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return hashes[at], np.searchsorted(owner[at], np.arange(len(begin))), np.diff(np.append(at, len(hashes)))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two ascending arrays of distinct values; two empty ones are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)
