"""Periodic runs of words by block convolution (operator 12).

A run is a stretch of words with smallest period q (words q apart are equal), at least
max(12, 2q) long, that no neighbouring word extends.  Where a run has period q, the words
i and i + q are equal over a stretch of length - q >= q words.  So for every q there is a
dyadic block size B with 2B - 1 <= q <= 4B - 2 (1 to 6 for B = 2, where length - q >= 6), and the
stretch holds a whole aligned block of B words that occurs again at distance q.

For each B the blocks are correlated with the windows that follow them: the sums of squared
differences of word codes at all distances come from one number-theoretic transform per
block and window, in exact integers modulo a prime.  A sum that is zero is an occurrence
(a non-zero sum may vanish modulo the prime; the extension then finds unequal words).  The
distances seed extensions: adjacent blocks with the same distance are one seed, which
grows to both sides by comparing prefix hashes, and is then compared word by word.

Left out before the transform, without loss: blocks with a pair of neighbouring words that
does not come again within the window, and blocks whose window lies in a run found already
with a smaller period, since all their occurrences are multiples of it there.

The documents of a slice are one sequence (codes differ between documents), so numpy works
on some 10^5 words at a time; a slice is one task's and holds a megabyte of text, or one
longer text.  Rows are not shuffled, so no key can be hot.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

U64 = np.uint64
PRIME = 15 * (1 << 27) + 1  # with 31 as a primitive root: transforms of up to 2**27 words
ROOT = 31
LEAST = 12
SLICE_BYTES = 1 << 20
CHUNK = 1 << 19  # words of one batch of transforms

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_twiddles: dict[tuple[int, bool], np.ndarray] = {}


def _roots(n: int, inverse: bool) -> np.ndarray:
    """The first n / 2 powers of an n-th root of unity."""
    key = (n, inverse)
    if key not in _twiddles:
        w = pow(ROOT, (PRIME - 1) // n, PRIME)
        w = pow(w, -1, PRIME) if inverse else w
        out = np.ones(max(n // 2, 1), U64)
        filled = 1
        while filled < len(out):  # w**filled moves the powers known so far
            out[filled:2 * filled] = out[:filled] * U64(pow(w, filled, PRIME)) % U64(PRIME)
            filled *= 2
        if n > CHUNK:
            return out
        _twiddles[key] = out
    return _twiddles[key]


def transform(rows: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Number-theoretic transform of each row (Stockham order, so no bit reversal).  Row
    length is a power of two; the inverse is not divided by it."""
    m, n = rows.shape
    p, x = U64(PRIME), rows.astype(U64)
    half, stride = n // 2, 1
    w = _roots(n, inverse)
    while half >= 1:
        x = x.reshape(m, 2, half, stride)
        a, b = x[:, 0], x[:, 1]
        y = np.empty((m, half, 2, stride), U64)
        total = a + b
        y[:, :, 0] = np.where(total >= p, total - p, total)
        y[:, :, 1] = (a + (p - b)) % p * w[::stride][:half, None] % p
        x = y.reshape(m, n)
        half, stride = half // 2, stride * 2
    return x


def mismatches(codes: np.ndarray, starts: np.ndarray, size: int, low: int, high: int) -> np.ndarray:
    """For blocks ``codes[s:s+size]``: the sums of squared differences from the stretch at
    each distance ``low`` to ``high``, modulo PRIME, a row per block.  Beyond the end of
    ``codes`` the words are 0."""
    p, n, width = U64(PRIME), 4 * size, high - low + size
    at = starts[:, None] + low + np.arange(width)
    inside = at < len(codes)
    windows = np.zeros((len(starts), n), U64)
    windows[:, :width] = np.where(inside, codes[np.where(inside, at, 0)], 0)
    blocks = np.zeros((len(starts), n), U64)
    block = codes[starts[:, None] + np.arange(size)].astype(U64)
    blocks[:, 0] = block[:, 0]
    blocks[:, n - np.arange(1, size)] = block[:, 1:]  # reversed: the product is a correlation
    product = transform(transform(windows) * transform(blocks) % p, inverse=True)
    cross = product[:, :high - low + 1] * U64(pow(n, -1, PRIME)) % p
    squares = np.zeros((len(starts), width + 1), U64)
    np.cumsum(windows[:, :width] * windows[:, :width] % p, axis=1, out=squares[:, 1:])
    moving = squares[:, size:size + high - low + 1] - squares[:, :high - low + 1]
    own = (block * block % p).sum(axis=1, dtype=U64)[:, None]
    return (own + moving + U64(2) * (p - cross)) % p


class _Prefix:
    """Prefix hashes of a sequence of codes, to extend many seeds at once."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        up, down = np.full(n + 1, _BASE, U64), np.full(n + 1, _INVERSE, U64)
        up[0] = down[0] = 1
        self.codes, self.down = codes, np.cumprod(down, dtype=U64)
        x = codes.astype(U64) + U64(1)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum((x ^ (x >> U64(31))) * np.cumprod(up, dtype=U64)[:n], dtype=U64, out=self.sums[1:])

    def equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        s, d = self.sums, self.down
        return (s[a + length] - s[a]) * d[a] == (s[b + length] - s[b]) * d[b]

    def reach(self, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
        """Longest equal stretches from ``a`` and ``b`` on (or, ``back``, up to them), by
        bisection on the prefix hashes, at most ``most``."""
        low, high = np.zeros_like(a), most.copy()
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.equal(a - mid, b - mid, mid) if back else self.equal(a, b, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def _prime_factors(n: int) -> list[int]:
    out, f = [], 2
    while f * f <= n:
        if n % f == 0:
            out.append(f)
            while n % f == 0:
                n //= f
        f += 1
    return out + [n] if n > 1 else out


def _walk(codes: np.ndarray, first: int, end: int, d: int) -> tuple[int, int]:
    """Bounds of the stretch around [first, end) in which words are equal at distance d,
    word by word; empty if they are not equal in [first, end) itself."""
    if not np.array_equal(codes[first:end], codes[first + d:end + d]):
        return first, first
    while first > 0 and codes[first - 1] == codes[first - 1 + d]:
        first -= 1
    while end + d < len(codes) and codes[end] == codes[end + d]:
        end += 1
    return first, end


def runs(codes: np.ndarray, longest: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``codes``, sorted.  ``longest`` is the
    length of the longest part that a run may lie in."""
    n = len(codes)
    found: set[tuple[int, int, int]] = set()
    if n < LEAST:
        return []
    prefix = _Prefix(codes)
    # distance to the next place with the same two words
    again = np.full(n, n, np.int64)
    pairs = codes[:-1] * (int(codes.max()) + 1) + codes[1:]
    order = np.argsort(pairs, kind="stable")
    same = pairs[order[1:]] == pairs[order[:-1]]
    again[order[:-1][same]] = np.diff(order)[same]
    # of the runs found that hold a place, the end of the one that goes furthest, and its period
    reach, period = np.zeros(n, np.int64), np.ones(n, np.int64)
    size = 2
    while True:
        low, high = (1, 6) if size == 2 else (2 * size - 1, 4 * size - 2)
        if low > longest // 2 or n < size:
            return sorted(found)
        whole = n // size * size
        starts = np.arange(0, whole, size)
        coming = again[:whole].reshape(-1, size)[:, :size - 1].max(axis=1)
        known = (reach[starts] >= np.minimum(starts + high + size, n)) & (period[starts] <= size)
        starts = starts[(coming <= high) & ~known]
        seeds = [(np.zeros(0, np.int64),) * 2]
        per = max(1, CHUNK // (4 * size))
        for lo in range(0, len(starts), per):
            some = starts[lo:lo + per]
            row, gap = np.nonzero(mismatches(codes, some, size, low, high) == 0)
            s, d = some[row], gap + low
            keep = s + d + size <= n
            keep &= ~((reach[s] >= s + d + size) & (d % period[s] == 0))
            seeds.append((s[keep], d[keep]))
        s, d = (np.concatenate(x) for x in zip(*seeds))
        for run in _grown(codes, prefix, s, d, size):
            if run not in found:
                found.add(run)
                start, length, q = run
                part = slice(start, start + length)
                further = reach[part] < start + length
                reach[part][further], period[part][further] = start + length, q
        size *= 2


def _grown(codes, prefix: _Prefix, s: np.ndarray, d: np.ndarray, size: int) -> list[tuple[int, int, int]]:
    """Runs that grow from occurrences of the blocks at ``s`` again at distance ``d``."""
    if not len(s):
        return []
    n = len(codes)
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    chain = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (s[1:] != s[:-1] + size))))
    first, last, d = s[chain], s[np.append(chain[1:], len(s)) - 1] + size, d[chain]
    left = prefix.reach(first, first + d, first, back=True)
    right = prefix.reach(first, first + d, n - d - first, back=False)
    out, seen = [], set()
    for a, b, end, q in zip((first - left).tolist(), (first + right).tolist(), last.tolist(), d.tolist()):
        if (a, b, q) in seen:
            continue
        seen.add((a, b, q))
        if b < end or not np.array_equal(codes[a:b], codes[a + q:b + q]):  # a false zero, or hashes that met
            a, b = _walk(codes, end - size, end, q)
        length = b - a + q
        if length < max(LEAST, 2 * q):
            continue
        if any(np.array_equal(codes[a:a + length - q // f], codes[a + q // f:a + length]) for f in _prime_factors(q)):
            continue
        out.append((a, length, q))
    return out


def kept_words(found: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Which of n words stay when each run is cut to its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, q in found:
        change[start + q] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def _planted(words: list[bytes], doc_id) -> list[bytes]:
    """The query's planted repeats: for a tenth of the ids the end of a text repeats with a
    period that follows from the id."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (-(-(n - a) // p)))[:n - a]


def _slices(ids: list, texts: list[str | None], planted: bool) -> Iterator[tuple[list, list[list[bytes]]]]:
    some_ids, some, size = [], [], 0
    for doc_id, text in zip(ids, texts):
        raw = (text or "").encode()
        if some and size + len(raw) > SLICE_BYTES:
            yield some_ids, some
            some_ids, some, size = [], [], 0
        words = raw.split()  # on runs of space and 0x09-0x0D
        some_ids.append(doc_id)
        some.append(_planted(words, doc_id) if planted else words)
        size += len(raw)
    if some:
        yield some_ids, some


def _document_runs(docs: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Runs of each document of a slice, by word number in the document."""
    book: dict[bytes, int] = {}
    parts = []
    for words in docs:
        book.clear()  # codes are the documents' own, and follow those of the one before
        parts.append(np.array([book.setdefault(w, len(book)) for w in words], np.int64))
    sizes = np.array([int(p.max()) + 1 if len(p) else 0 for p in parts])
    bases = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    bounds = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    codes = np.concatenate([p + b for p, b in zip(parts, bases)])
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    found = runs(codes, int(np.diff(bounds).max()))
    owner = np.searchsorted(bounds, [r[0] for r in found], "right") - 1
    for (start, length, q), doc in zip(found, owner.tolist()):
        out[doc].append((start - int(bounds[doc]), length, q))
    return out


_FIELDS = [("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
           ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())]
_DIGESTS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def _digest_rows(planted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, docs in _slices(batch.column(0).to_pylist(), batch.column(1).to_pylist(), planted):
                rows = []
                for doc_id, words, found in zip(ids, docs, _document_runs(docs)):
                    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
                    milli = best[1] * 1000 // best[2] if found else None
                    if found:
                        words = [words[i] for i in np.flatnonzero(kept_words(found, len(words))).tolist()]
                    lines = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(found, key=lambda r: (r[0], r[2])))
                    rows.append((doc_id, len(found), *best, milli, _sha(lines.encode()), _sha(b" ".join(words))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _FIELDS)], [k for k, _ in _FIELDS])
    return run


def run_digests(docs: DataFrame, planted: bool = True) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the number of runs, the longest one (ties: smallest
    start, then period; null without runs), and digests of all runs and of the text whose
    runs are cut to one period.  ``planted`` first makes the texts of a tenth of the ids
    repeat.  Null and empty texts have no words and no runs; a null id plants nothing;
    repeated rows give equal rows; other columns are not read."""
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_digest_rows(planted), _DIGESTS)


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in batches:
        for ids, docs in _slices(batch.column(0).to_pylist(), batch.column(1).to_pylist(), False):
            found = _document_runs(docs)
            texts = [b" ".join([w for w, k in zip(words, kept_words(f, len(words)).tolist()) if k]).decode() for words, f in zip(docs, found)]
            listed = [[{"start": s, "length": n, "period": q} for s, n, q in sorted(f, key=lambda r: (r[0], r[2]))] for f in found]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(listed, kind), pa.array(texts, pa.string())],
                                             ["doc_id", "runs", "collapsed"])


def find_runs(docs: DataFrame) -> DataFrame:
    """doc_id, every run (word number, length, period) and the collapsed text of each row of
    ``docs``: words that a run holds after its first period are left out, the rest joined
    by single spaces.  Edge cases as in :func:`run_digests`."""
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(
        _run_rows, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
