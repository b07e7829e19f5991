"""Levenshtein distances and sequence ratios of many pairs of texts at once, by arrays.

Near copies differ in few places, so both are found from runs of equal characters:

* the distance by furthest-reaching points (Ukkonen 1985, Myers 1986): after ``e`` edits each
  diagonal is known by the farthest point reached on it, which costs d * d points for a
  distance d, whatever the length of the texts;
* the ratio by difflib's rule, the longest run inside each rectangle, for all rectangles of all
  pairs at the same depth together.

Runs are measured eight bytes at a time on packed characters; the texts of both sides end in
different marks, so that no run passes an end.  Values equal those of
:func:`.similarity.levenshtein_distance` and :func:`.similarity.sequence_ratio`.
"""

from __future__ import annotations

import numpy as np

from ..config import Weights
from .similarity import RUN_PAIRS, levenshtein_distance, sequence_ratio_py

#: Points of a step that a batch of pairs should have, and characters of its texts at most.
STEP_POINTS, BATCH_CHARS = 60_000, 1_000_000
#: Pairs of equal characters of a batch of ratios (one pair may have more).
BATCH_RUNS = 1_000_000
#: Nanoseconds of a furthest-reaching point, and of a character and a thousand pairs of
#: characters by bit-vectors: beyond what they cost, a distance is computed by those.
POINT_NS, CHAR_NS, CELLS_NS = 25.0, 900.0, 270.0


class _Side:
    """Texts of one side of the pairs behind each other, each with an end mark after it."""

    def __init__(self, texts: list[str], code: np.ndarray, kind, mark: int):
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.per = 8 // np.dtype(kind).itemsize
        gap = self.per
        starts = np.cumsum(lengths + gap) - lengths
        size = int(starts[-1] + lengths[-1]) + gap
        self.mark, self.codes = mark, np.full(size, mark, kind)
        flat = code[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        at = np.arange(len(flat)) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
        self.codes[at] = flat
        self.start, self.length = starts, lengths

    def words(self, backward: bool = False) -> np.ndarray:
        """At each place the eight bytes from it on, or (``backward``) those before it, nearest first."""
        pad = np.full(self.per, self.mark, self.codes.dtype)
        codes = np.concatenate([self.codes[::-1] if backward else self.codes, pad])
        words = np.ndarray((len(self.codes) + 1,), np.uint64, codes.data, strides=(codes.itemsize,))
        return (words[::-1] if backward else words).copy()


def _encoded(pairs: list[tuple[str, str]]):
    """Both sides of the pairs, in the smallest codes that fit their characters."""
    seen = np.zeros(0x110000, bool)
    for t in {t for p in pairs for t in p}:
        seen[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)] = True
    used = np.flatnonzero(seen)
    kind = next(k for k in (np.uint8, np.uint16, np.uint32) if len(used) < np.iinfo(k).max - 2)
    code = np.zeros(0x110000, kind)
    code[used] = np.arange(len(used))
    top = int(np.iinfo(kind).max)
    return _Side([a for a, _ in pairs], code, kind, top - 1), _Side([b for _, b in pairs], code, kind, top), len(used)


def _equal_words(z: np.ndarray, shift: int) -> np.ndarray:
    """Leading equal characters of words with the difference ``z``."""
    return (np.bitwise_count((z & (~z + np.uint64(1))) - np.uint64(1)) >> shift).astype(np.int64)


def _runs(xw: np.ndarray, yw: np.ndarray, i: np.ndarray, j: np.ndarray, per: int, step: int = 1) -> np.ndarray:
    """Length of the run of equal characters that begins at (i, j), for one-dimensional i, j."""
    shift = {8: 3, 4: 4, 2: 5}[per]
    count = 8
    if len(i) > 64:  # most end in their first word
        run = _equal_words(xw.take(i, mode="clip") ^ yw.take(j, mode="clip"), shift)
        at = np.flatnonzero(run == per)
    else:
        run, at = np.zeros(len(i), np.int64), np.arange(len(i))
    while len(at):
        more, wide = run[at], step * per * np.arange(count)
        a, b = (step * more + i[at])[:, None] + wide, (step * more + j[at])[:, None] + wide
        got = _equal_words(xw.take(a, mode="clip") ^ yw.take(b, mode="clip"), shift)
        whole = got == per
        full = np.where(whole.all(1), count, np.argmin(whole, 1))
        last = np.where(full < count, got[np.arange(len(at)), np.minimum(full, count - 1)], 0)
        run[at] = more + full * per + last
        at, count = at[full == count], min(4 * count, 512)
    return run


def _batches(order: np.ndarray, points: np.ndarray, chars: np.ndarray):
    """Slices of ``order`` that begin a new batch where one grows too large."""
    first, room, size = 0, 0, 0
    for at, k in enumerate(order.tolist()):
        if at > first and (max(size, points[k]) * (at - first + 1) > STEP_POINTS or room + chars[k] > BATCH_CHARS):
            yield order[first:at]
            first, room, size = at, 0, 0
        room, size = room + int(chars[k]), max(size, int(points[k]))
    if first < len(order):
        yield order[first:]


def _furthest(pairs: list[tuple[str, str]], most: np.ndarray) -> np.ndarray:
    """Distances up to ``most`` of each pair; -1 for larger ones, -2 where the first edits
    tell that it may be larger."""
    x, y, _ = _encoded(pairs)
    xw, yw, per = x.words(), y.words(), x.per
    n, m, x0, y0 = x.length, y.length, x.start, y.start
    out = np.full(len(pairs), -1, np.int64)
    here, delta, most = np.arange(len(pairs)), n - m, most.copy()
    shift, room, e = {8: 3, 4: 4, 2: 5}[per], 32, 0
    far = np.full((len(pairs), 2 * room + 3), -(1 << 40), np.int64)
    far[:, room + 1] = 0

    def bases():
        k = np.arange(-room - 1, room + 2)
        return np.minimum(n[here, None], m[here, None] + k), y0[here, None] - k, k

    limit, ybase, ks = bases()
    while True:
        c = room + 1
        lo, hi = c - e, c + e + 1
        if e == 0:
            t = far[:, lo:hi].copy()
        else:
            t = np.maximum(far[:, lo - 1:hi - 1], far[:, lo:hi])
            t += 1
            np.maximum(t, far[:, lo + 1:hi + 1], out=t)
            np.minimum(t, limit[:, lo:hi], out=t)
        i, j = t + x0[here, None], t + ybase[:, lo:hi]
        z = xw.take(i, mode="clip")
        z ^= yw.take(j, mode="clip")
        low = ~z
        low += np.uint64(1)
        low &= z
        low -= np.uint64(1)
        got = np.bitwise_count(low)
        got >>= shift
        t += got
        whole = np.flatnonzero(z.ravel() == 0)
        if len(whole):
            flat = t.ravel()
            flat[whole] += _runs(xw, yw, i.ravel()[whole] + per, j.ravel()[whole] + per, per)
        far[:, lo:hi] = t
        at = np.clip(delta[here], -e, e) + e
        done = (np.abs(delta[here]) <= e) & (t[np.arange(len(here)), at] >= n[here])
        out[here[done & (out[here] == -1)]] = e
        gone = done | (most[here] <= e)
        if e >= 16 and e & (e - 1) == 0:  # where the edits made reach too little of the text
            slow = ~gone & (e * (n[here] + m[here]) > 2 * most[here] * (2 * t - ks[lo:hi]).max(1))
            out[here[slow]] = -2
            most[here[slow]] = -1
            gone |= slow
        if gone.all():
            return out
        if gone.mean() > 0.15:
            here, far, limit, ybase = here[~gone], far[~gone], limit[~gone], ybase[~gone]
        e += 1
        if e >= room:
            grown = np.full((len(here), 4 * room + 3), -(1 << 40), np.int64)
            grown[:, room:room + far.shape[1]] = far
            room, far = 2 * room, grown
            limit, ybase, ks = bases()


def levenshtein_many(pairs: list[tuple[str, str]], most: np.ndarray | None = None) -> np.ndarray:
    """Edit distances; of pairs beyond ``most`` edits, the distance or -1."""
    n, m = (np.array([len(p[s]) for p in pairs], np.int64) for s in (0, 1))
    big, small = np.maximum(n, m), np.minimum(n, m)
    out = np.full(len(pairs), -1, np.int64)
    worth = np.sqrt(big * (CHAR_NS + CELLS_NS * small / 1000) / POINT_NS).astype(np.int64)
    cap = big if most is None else np.minimum(most, big)
    near = np.flatnonzero((cap >= big - small) & (worth >= big - small) & (small > 0))
    # texts of a batch should end after about as many edits: those of like size
    order = near[np.argsort(big[near], kind="stable")]
    for some in _batches(order, np.minimum(np.minimum(worth, cap), big // 8 + 8)[:] * 2, n + m):
        out[some] = _furthest([pairs[k] for k in some.tolist()], np.minimum(worth, cap)[some])
    rest = np.ones(len(pairs), bool)
    rest[near] = (cap[near] > worth[near]) | (out[near] == -2)
    for k in np.flatnonzero(rest & (out < 0) & (cap >= big - small)).tolist():
        out[k] = levenshtein_distance(*pairs[k])
    return out


def _equal_pairs(x: _Side, y: _Side, size: int, k: int, autojunk: bool):
    """Characters of both texts of pair ``k`` and how many partners each one of the first has."""
    a = x.codes[x.start[k]:x.start[k] + x.length[k]]
    b = y.codes[y.start[k]:y.start[k] + y.length[k]]
    counts = np.bincount(b, minlength=size)
    if autojunk and len(b) >= 200:
        counts = np.where(counts > len(b) // 100 + 1, 0, counts)
    return a, b, counts


def _run_table(a: np.ndarray, b: np.ndarray, counts: np.ndarray):
    """(i, j, length) of the maximal diagonal runs of equal characters with a count."""
    own, theirs = (np.flatnonzero(counts[t]).astype(np.int32) for t in (a, b))
    order = theirs[np.argsort(b[theirs], kind="stable")]
    first = np.cumsum(counts) - counts
    per = counts[a[own]]
    total = int(per.sum())
    i = np.repeat(own, per)
    j = order[np.repeat(first[a[own]] - (np.cumsum(per) - per), per) + np.arange(total)]
    diagonal = np.argsort((j.astype(np.int64) - i + len(a)) * (len(a) + 1) + i)
    i, j = i[diagonal], j[diagonal]
    begin = np.flatnonzero(np.concatenate(([True], (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1)))) if total else np.zeros(0, np.int64)
    return i[begin], j[begin], np.diff(np.append(begin, total))


def _sweep(sides, keys: np.ndarray, rects: np.ndarray, to: np.ndarray):
    """Blocks (rectangle, i, j, length) taken in each of ``rects`` (alo, ahi, blo, bhi) from its
    longest runs, which begin at ``keys`` (i and j, sorted): the first one, extended over equal
    characters, then the first one behind that, and so on."""
    xw, yw, xb, yb, per = sides
    mask = (1 << 32) - 1
    i, j, here = rects[0].copy(), rects[2].copy(), np.arange(rects.shape[1])
    seek, found = (i << 32) | j, []
    while len(here):
        c = np.searchsorted(keys, seek)
        inside = c < to[here]
        here, i, j, c = here[inside], i[inside], j[inside], c[inside]
        p, q = keys[c] >> 32, keys[c] & mask
        seek = (p << 32) | j
        good = np.flatnonzero(q >= j)
        if not len(good):
            continue
        p, q, r = p[good], q[good], here[good]
        back = np.minimum(_runs(xb, yb, p, q, per, -1), np.minimum(p - i[good], q - j[good]))
        p, q = p - back, q - back
        size = np.minimum(_runs(xw, yw, p, q, per), np.minimum(rects[1][r] - p, rects[3][r] - q))
        found.append(np.stack((r, p, q, size)))
        i[good], j[good] = p + size, q + size
        seek[good] = (p + size << 32) | (q + size)
    return np.concatenate(found, axis=1)


def _matched(x: _Side, y: _Side, which: np.ndarray, tables: list) -> np.ndarray:
    """Characters in matching blocks of the pairs ``which``, whose runs are ``tables``.

    Rectangles follow each other in both texts, and a run lies in the first one that ends
    behind its begin.  Of the longest runs of a rectangle the first is a block; the next
    block beyond it is the first of them that lies there, since none there is longer."""
    sides = x.words(), y.words(), x.words(True), y.words(True), x.per
    matched = np.zeros(len(which), np.int64)
    pair = np.arange(len(which))
    rects = np.stack((x.start[which], x.start[which] + x.length[which], y.start[which], y.start[which] + y.length[which]))
    rect = np.repeat(pair, [len(t[0]) for t in tables])
    i, j, n = (np.concatenate([t[s] for t in tables]).astype(np.int32) for s in range(3))
    i, j = i + rects[0].astype(np.int32)[rect], j + rects[2].astype(np.int32)[rect]
    while rects.shape[1]:
        rect = np.searchsorted(rects[1], i, side="right").astype(np.int32)
        held = np.flatnonzero(rect < rects.shape[1])
        rect, i, j, n = rect[held], i[held], j[held], n[held]
        edge = [c.astype(np.int32)[rect] for c in rects]
        skip = np.maximum(edge[0] - i, edge[2] - j)
        np.maximum(skip, 0, out=skip)
        n = np.minimum(np.minimum(n, edge[1] - i), edge[3] - j) - skip
        held = np.flatnonzero(n > 0)
        rect, i, j, n = rect[held], i[held] + skip[held], j[held] + skip[held], n[held]
        most = np.zeros(rects.shape[1], np.int32)
        np.maximum.at(most, rect, n)
        bare = np.flatnonzero(most == 0)
        if len(bare):  # only equal popular characters at the begin
            alo, ahi, blo, bhi = rects[:, bare]
            size = np.minimum(_runs(*sides[:2], alo, blo, x.per), np.minimum(ahi - alo, bhi - blo))
            matched += np.bincount(pair[bare], size, len(matched)).astype(np.int64)
        if len(bare) == rects.shape[1]:
            return matched
        longest = np.flatnonzero(n == most[rect])
        keys = np.sort((i[longest].astype(np.int64) << 32) | j[longest])
        full = most > 0
        rects, pair = rects[:, full], pair[full]
        r, p, q, size = _sweep(sides, keys, rects, np.searchsorted(keys, rects[1] << 32))
        matched += np.bincount(pair[r], size, len(matched)).astype(np.int64)
        # what is left between the blocks
        own = np.arange(rects.shape[1])
        of, p, q, pa, qa = (np.concatenate(c) for c in ((r, own), (p, rects[1]), (q, rects[3]), (p + size, rects[1]), (q + size, rects[3])))
        order = np.lexsort((p, of))
        of, p, q, pa, qa = (c[order] for c in (of, p, q, pa, qa))
        first = np.concatenate(([True], of[1:] != of[:-1]))
        alo = np.where(first, rects[0][of], np.concatenate(([0], pa[:-1])))
        blo = np.where(first, rects[2][of], np.concatenate(([0], qa[:-1])))
        open_ = (alo < p) & (blo < q)
        rects, pair = np.stack((alo, p, blo, q))[:, open_], pair[of[open_]]
    return matched


def ratios_many(pairs: list[tuple[str, str]], autojunk: bool = True) -> np.ndarray:
    """``SequenceMatcher(None, a, b, autojunk=autojunk).ratio()`` of each pair."""
    out = np.zeros(len(pairs))
    n, m = (np.array([len(p[s]) for p in pairs], np.int64) for s in (0, 1))
    out[(n == 0) & (m == 0)] = 1.0
    order = np.argsort(n + m, kind="stable")
    order = order[(n[order] > 0) & (m[order] > 0)]
    for some in _batches(order, np.ones(len(pairs), np.int64), n + m):
        x, y, size = _encoded([pairs[k] for k in some.tolist()])
        held, tables, room = [], [], 0

        def flush():
            which = np.array(held)
            out[some[which]] = 2.0 * _matched(x, y, which, tables) / (n + m)[some[which]]

        for at, k in enumerate(some.tolist()):
            a, b, counts = _equal_pairs(x, y, size, at, autojunk)
            total = int(counts[a].sum())
            if total > RUN_PAIRS:
                out[k] = sequence_ratio_py(*pairs[k], autojunk)
                continue
            if held and room + total > BATCH_RUNS:
                flush()
                held, tables, room = [], [], 0
            held.append(at)
            tables.append(_run_table(a, b, counts))
            room += total
        if held:
            flush()
    return out


def scores_many(weights: Weights, threshold: float, autojunk: bool = True):
    """``(pairs, jaccard, shared) -> (lev, seq)`` on arrays, by the bounds of
    :func:`.similarity.pair_scores`; ``seq`` is nan where the pair cannot reach ``threshold``."""
    s, l, j = weights.sequence_similarity, weights.levenshtein_similarity, weights.jaccard_similarity
    floor = threshold - 1e-9

    def scores(pairs: list[tuple[str, str]], jac: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, m = (np.array([len(p[k]) for p in pairs], np.int64) for k in (0, 1))
        big, both = np.maximum(np.maximum(n, m), 1), np.maximum(n + m, 1)
        lev, seq = np.full(len(pairs), np.nan), np.full(len(pairs), np.nan)
        some = np.flatnonzero((s * (2.0 * shared / both) + l * (shared / big) + j * jac >= floor) | (n + m == 0))
        if not len(some):
            return lev, seq
        # beyond so many edits the second bound fails too (one more, for rounding)
        cost = s / both[some] + l / big[some]
        room = np.maximum(s + l + j * jac[some] - floor, 0.0) / np.maximum(cost, 1e-12)
        d = levenshtein_many([pairs[k] for k in some.tolist()], np.minimum(room + 1, big[some]).astype(np.int64))
        known = d >= 0
        some, d = some[known], d[known]
        lev[some] = 1.0 - d / big[some]
        bound = np.minimum(np.where(n[some] + m[some] == 0, 1.0, 2.0 * shared[some] / both[some]), 1.0 - d / both[some])
        some = some[s * bound + l * lev[some] + j * jac[some] >= floor]
        seq[some] = ratios_many([pairs[k] for k in some.tolist()], autojunk)
        return lev, seq

    return scores
