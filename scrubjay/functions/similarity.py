"""The four similarity components and their weighted sum.

Exact match and word Jaccard are native Column expressions.  Levenshtein and the
Ratcliff-Obershelp sequence ratio run in one Arrow-batched UDF that only ever sees
candidate pairs that survived the native bounds: Spark's built-in ``levenshtein`` is a
full O(n*m) table even with a threshold, while the bit-parallel form below costs
O(n * m / 64) word operations, and ``difflib`` is the definition of the ratio.
"""

from __future__ import annotations

import os.path
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from ..config import Weights


def exact_match(a, b) -> Column:
    return F.when(a == b, F.lit(1.0)).otherwise(F.lit(0.0))


def jaccard(words_a, words_b) -> Column:
    """|A n B| / |A u B| over word sets; both empty 1.0, one empty 0.0."""
    na, nb = F.size(words_a), F.size(words_b)
    inter = F.size(F.array_intersect(words_a, words_b))
    return (F.when((na == 0) & (nb == 0), F.lit(1.0))
             .when((na == 0) | (nb == 0), F.lit(0.0))
             .otherwise(inter / (na + nb - inter)))


#: Characters with a place of their own in a histogram; all others share the last place.
HISTOGRAM = "abcdefghijklmnopqrstuvwxyz0123456789_ "


def histogram(norm) -> Column:
    """Character counts of a normalized text, in ``len(HISTOGRAM) + 1`` places."""
    own = [F.length(norm) - F.length(F.replace(norm, F.lit(c), F.lit(""))) for c in HISTOGRAM]
    others = F.length(F.translate(norm, HISTOGRAM, ""))
    return F.array(*own, others)


def shared_characters(hist_a, hist_b) -> Column:
    """Sum of the smaller counts: at least the size of the shared character multiset."""
    return F.aggregate(F.zip_with(hist_a, hist_b, lambda x, y: F.least(x, y)), F.lit(0), lambda acc, n: acc + n)


def levenshtein_distance(a: str, b: str) -> int:
    """Edit distance (unit costs, code points) by the bit-vector recurrence of Myers
    (1999) in Hyyro's formulation: one pass over the longer text, the shorter one held
    as a bit-vector in a Python int."""
    if len(a) < len(b):
        a, b = b, a
    # what both begin and end with costs nothing
    same = len(os.path.commonprefix((a, b)))
    a, b = a[same:], b[same:]
    same = len(os.path.commonprefix((a[::-1], b[::-1])))
    a, b = a[:len(a) - same], b[:len(b) - same]
    m = len(b)
    if m == 0:
        return len(a)
    peq: dict = {}
    for i, ch in enumerate(b):
        peq[ch] = peq.get(ch, 0) | (1 << i)
    mask = (1 << m) - 1
    hibit = 1 << (m - 1)
    pv, mv, score = mask, 0, m
    for ch in a:
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv)
        mh = pv & xh
        if ph & hibit:
            score += 1
        elif mh & hibit:
            score -= 1
        ph = (ph << 1) | 1
        mh = mh << 1
        pv = (mh | ~(xv | ph)) & mask
        mv = ph & xv & mask
    return score


def sequence_ratio_py(a: str, b: str, autojunk: bool = True) -> float:
    """``SequenceMatcher(None, a, b).ratio()``; a is the newer (seed-side) text."""
    return SequenceMatcher(None, a, b, autojunk=autojunk).ratio()


#: Pairs of equal characters that the run table may hold; beyond, difflib itself runs.
RUN_PAIRS = 4_000_000


def _match_runs(x: np.ndarray, y: np.ndarray, autojunk: bool):
    """(i, j, length) of all maximal diagonal runs of equal characters that are not popular
    in ``y`` (difflib: more than 1 % of a text of 200 characters or more); None if there are
    too many pairs."""
    values, inverse, counts = np.unique(y, return_inverse=True, return_counts=True)
    if autojunk and len(y) >= 200:
        counts = np.where(counts > len(y) // 100 + 1, 0, counts)
    at = np.minimum(np.searchsorted(values, x), len(values) - 1)
    per = np.where(values[at] == x, counts[at], 0)  # partners of each character of x
    total = int(per.sum())
    if total > RUN_PAIRS:
        return None
    order = np.argsort(inverse, kind="stable")
    first = np.searchsorted(inverse[order], np.arange(len(values)))
    i = np.repeat(np.arange(len(x)), per)
    j = order[np.repeat(first[at], per) + np.arange(total) - np.repeat(np.cumsum(per) - per, per)]
    diagonal = np.lexsort((i, j - i))
    i, j = i[diagonal], j[diagonal]
    begin = np.flatnonzero(np.concatenate(([True], (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1)))) if total else np.zeros(0, np.int64)
    return i[begin], j[begin], np.diff(np.append(begin, total))


def _leading(equal: np.ndarray) -> int:
    return int(np.argmin(equal)) if len(equal) and not equal.all() else len(equal)


def sequence_ratio(a: str, b: str, autojunk: bool = True) -> float:
    """The ratio of :func:`sequence_ratio_py`, from arrays: runs of equal characters are
    listed once, and each step takes the longest run inside its rectangle (ties: first in
    a, then in b), extends it over equal popular characters, and goes on at both sides."""
    if not a or not b:
        return 1.0 if not a and not b else 0.0
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    runs = _match_runs(x, y, autojunk)
    if runs is None:
        return sequence_ratio_py(a, b, autojunk)
    matched, todo = 0, [(0, len(x), 0, len(y), *runs)]
    while todo:
        alo, ahi, blo, bhi, i, j, n = todo.pop()
        skip = np.maximum(np.maximum(alo - i, blo - j), 0)
        length = np.minimum(np.minimum(n, ahi - i), bhi - j) - skip
        inside = np.flatnonzero(length > 0)
        i, j, n, skip, length = i[inside], j[inside], n[inside], skip[inside], length[inside]
        p, q, size = alo, blo, 0
        if len(length):
            size = int(length.max())
            best = np.flatnonzero(length == size)
            p, q = min(zip((i[best] + skip[best]).tolist(), (j[best] + skip[best]).tolist()))
        step = 64
        while True:  # back over equal characters
            m = min(step, p - alo, q - blo)
            grown = _leading((x[p - m:p] == y[q - m:q])[::-1]) if m else 0
            p, q, size, step = p - grown, q - grown, size + grown, 4 * step
            if not m or grown < m:
                break
        step = 64
        while True:  # and on
            m = min(step, ahi - p - size, bhi - q - size)
            grown = _leading(x[p + size:p + size + m] == y[q + size:q + size + m]) if m else 0
            size, step = size + grown, 4 * step
            if not m or grown < m:
                break
        if size:
            matched += size
            if alo < p and blo < q:
                todo.append((alo, p, blo, q, i, j, n))
            if p + size < ahi and q + size < bhi:
                todo.append((p + size, ahi, q + size, bhi, i, j, n))
    return 2.0 * matched / (len(x) + len(y))


PAIR_SCORES = T.StructType([T.StructField("lev", T.DoubleType()), T.StructField("seq", T.DoubleType())])


def pair_scores(weights: Weights, threshold: float, autojunk: bool = True):
    """``(a, b, jaccard, shared) -> (lev, seq)`` of two texts, None for ``seq`` when the pair
    cannot reach ``threshold``; ``shared`` is the size of the shared character multiset, or
    more, counted here if not given.  Exact upper bounds are tried before each expensive step:

    * I = ``shared``: ratio <= 2I/(n+m) (difflib's ``quick_ratio``) and Levenshtein
      similarity <= I/max(n, m), before any alignment;
    * with the edit distance d known, the matching blocks form a common subsequence; one
      of length c leaves n + m - 2c deletions and insertions, which are at least d, so
      ratio <= 1 - d/(n+m) before ``SequenceMatcher`` runs.
    """
    s, l, j = weights.sequence_similarity, weights.levenshtein_similarity, weights.jaccard_similarity
    floor = threshold - 1e-9

    def scores(x: str, y: str, jv: float, shared: int | None = None) -> tuple[float | None, float | None]:
        n, m = len(x), len(y)
        big = max(n, m)
        if big == 0:
            return 1.0, 1.0
        if shared is None:
            shared = sum((Counter(x) & Counter(y)).values())
        if s * (2.0 * shared / (n + m)) + l * (shared / big) + j * jv < floor:
            return None, None
        d = levenshtein_distance(x, y)
        lv = 1.0 - (d / big)
        s_bound = min(2.0 * shared / (n + m), 1.0 - d / (n + m))
        return lv, sequence_ratio(x, y, autojunk) if s * s_bound + l * lv + j * jv >= floor else None

    return scores


def pair_scores_udf(weights: Weights, threshold: float, autojunk: bool = True):
    """Arrow UDF ``(a, b, jaccard) -> struct<lev, seq>`` of :func:`pair_scores`."""
    of_pair = pair_scores(weights, threshold, autojunk)

    @F.pandas_udf(PAIR_SCORES)
    def scores(a: pd.Series, b: pd.Series, jac: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([of_pair(*row) for row in zip(a, b, jac)], columns=["lev", "seq"], dtype=float)

    return scores


def composite(weights: Weights, exact: Column, seq: Column, lev: Column, jac: Column) -> Column:
    """Weighted sum in the reference's term order (keeps float results identical)."""
    return (exact * F.lit(weights.exact_match) + seq * F.lit(weights.sequence_similarity)
            + lev * F.lit(weights.levenshtein_similarity) + jac * F.lit(weights.jaccard_similarity))
