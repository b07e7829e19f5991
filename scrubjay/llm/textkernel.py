"""Vectorised word and shingle hashing over Arrow string batches.

A word is a maximal run of UTF-8 bytes other than space and 0x09-0x0D; because the
delimiters and A-Z are ASCII, working on bytes equals working on characters.  Words get
64-bit polynomial hashes from prefix sums, so a batch costs a few numpy passes and no
per-word Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES, SLICE_DOCS = 1 << 20, 1024
HASH_BITS = 54  # of a shingle; the other bits hold its document's place in a slice

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64))
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64.  Tables beyond a slice's
    usual size (one very long text) are made for that text and not kept."""
    global _powers
    if len(_powers[0]) < n:
        up, down = np.full(n, _BASE, U64), np.full(n, _INVERSE, U64)
        up[0] = down[0] = 1
        made = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
        if n > 4 * SLICE_BYTES:
            return made
        _powers = made
    return _powers


@dataclass
class Words:
    """Words of a slice of documents: byte ranges, hashes, and where each document's
    words begin (``bounds`` has one more entry than there are documents)."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, bytes, offsets) over runs of rows; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return
    _, raw_offsets, raw = column.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, "right")) - 1
        hi = min(max(hi, lo + 1), lo + SLICE_DOCS, len(column))
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    n = len(data)
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    before[:1] = True
    after[-1:] = True
    before[1:] = space[:-1]
    after[:-1] = space[1:]
    inside = ~space
    starts = np.flatnonzero(inside & (before | edge[:n]))
    ends = np.flatnonzero(inside & (after | edge[1:])) + 1
    up, down = _power_tables(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(_BYTE[data] * up[:n], dtype=U64, out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    return Words(data, offsets, starts, ends, hashes, np.searchsorted(starts, offsets))


def grams(w: Words, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position on (whether or not a document ends
    within them; callers mask positions by ``bounds``)."""
    h = w.hashes
    n = max(len(h) - k + 1, 0)
    out = np.zeros(n, U64)
    for j in range(k):
        out = out * U64(0xD1342543DE82EF95) + h[j:j + n]
    return mix(out)


def shingle_sets(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document place, 54-bit hash) of each distinct ``k``-word shingle, sorted; a
    document of fewer than ``k`` words has its whole word sequence as one shingle."""
    counts = w.counts
    shift = U64(HASH_BITS)
    doc = np.repeat(np.arange(len(counts)), counts)
    g = grams(w, k)
    fits = np.arange(len(g)) + k <= w.bounds[1:][doc[:len(g)]]
    keys = [(doc[:len(g)][fits].astype(U64) << shift) | (g[fits] >> U64(64 - HASH_BITS))]
    for m in range(1, k):
        short = np.flatnonzero(counts == m)
        if len(short):
            at = w.bounds[short]
            out = np.full(len(short), m, U64)
            for j in range(m):
                out = out * U64(0xD1342543DE82EF95) + w.hashes[at + j]
            keys.append((short.astype(U64) << shift) | (mix(out) >> U64(64 - HASH_BITS)))
    key = np.sort(np.concatenate(keys))
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return (key >> shift).astype(np.int64), key & U64((1 << HASH_BITS) - 1)
