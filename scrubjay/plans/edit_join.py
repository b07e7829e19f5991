"""Lossless candidates by edit distance: a partition join with position and length bounds.

A pair with edit distance d <= k = x * M (M the longer length) leaves at least one of any k + 1
disjoint segments of the longer text unedited, so that segment stands in the shorter text
as well (Li et al., Pass-Join, 2011).  The longer text is cut into segments of
q = floor(M / (k + 1)) characters; the shorter one offers all its substrings of that length.
If the segment starts at p in the longer text and at r in the shorter one (length m),
then |p - r| edits at least lie before it and |(M - p) - (m - r)| after it, which together
are at most k.

Both bounds are part of the equi-join key as well, so that a segment many texts hold does
not bring them all together: lengths fall into geometric bands (a partner is in the same
band or the next lower one) and positions into steps of the band's largest k (a partner
is in the same step or beside it).  The shorter side has one row per substring and q, the
longer side six per segment.  Both are sorted and merged, never broadcast: a few MB of
short texts make hundreds of MB of rows.  Keys are 64-bit hashes; a collision only adds a candidate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

EPS = 1e-9


def edits(length: Column, share: float) -> Column:
    """Largest number of edits of a text of ``length`` characters."""
    return F.floor(length * F.lit(share) + F.lit(EPS)).cast("int")


def segment_length(length: Column, share: float) -> Column:
    return F.floor(length / (edits(length, share) + 1)).cast("int")


def _band(length: Column, share: float) -> Column:
    """Geometric length band: two lengths m >= M - k are in the same or neighbouring bands."""
    return F.floor(F.log(length.cast("double")) / F.lit(-math.log1p(-share)) + F.lit(EPS)).cast("int")


def _step(band: Column, share: float) -> Column:
    """More than the largest number of edits of any text in a band or the next higher one,
    where the longer partner may be."""
    longest = F.exp((band + 2) * F.lit(-math.log1p(-share)))
    return (F.floor(longest * F.lit(share)) + 2).cast("int")


def _key(q: Column, gram: Column, band: Column, place: Column) -> Column:
    return F.xxhash64(q, gram, band, place)


def _offers(texts: DataFrame, share: float) -> DataFrame:
    """A row per substring of the lengths q that a longer partner may use."""
    longest = F.floor(F.col("nc") / F.lit(1.0 - share) + F.lit(1.0)).cast("int")
    sizes = F.array_distinct(F.transform(F.sequence(F.col("nc"), longest), lambda n: segment_length(n, share)))
    rows = texts.select("v", "nc", "norm", _band(F.col("nc"), share).alias("band"), F.explode(sizes).alias("q")).where("q <= nc")
    grams = rows.select("v", "nc", "band", "q", F.posexplode(F.expr(_grams_sql("nc - q", 1))).alias("at", "gram"))
    # a partner is in this band or the next one, and looks in both; so one row is enough
    return grams.select("v", "nc", "at", _key(F.col("q"), F.col("gram"), F.col("band"),
                                              F.floor(F.col("at") / _step(F.col("band"), share)).cast("int")).alias("k"))


def _grams_sql(last: str, stride: int | str) -> str:
    """Substrings of ``q`` characters from every ``stride``-th place to ``last``, cut in two
    levels (pieces of 256 places first), so that a long text costs no quadratic scan."""
    return (f"flatten(transform(sequence(0, cast(({last}) as int), 256 * {stride}), lo -> "
            f"transform(array(substring(norm, lo + 1, 256 * {stride} + q)), part -> "
            f"transform(sequence(0, cast(least(({last}) - lo, 255 * {stride}) as int), {stride}), i -> substring(part, i + 1, q)))[0]))")


def _asks(texts: DataFrame, share: float) -> DataFrame:
    """Six rows per segment of a text as the longer one: its own length band and the next
    lower, its own position step and those beside it."""
    band, q = _band(F.col("nc"), share), segment_length(F.col("nc"), share)
    rows = texts.select("v", "nc", "norm", band.alias("own"), q.alias("q"), edits(F.col("nc"), share).alias("edits"))
    # exactly edits + 1 segments are needed
    cut = rows.select("v", "nc", "own", "q", F.posexplode(F.expr(_grams_sql("edits * q", "q"))).alias("i", "gram"))
    cut = cut.select("v", "nc", "q", "gram", (F.col("i") * F.col("q")).alias("at"),
                     F.explode(F.array(F.col("own"), F.col("own") - 1)).alias("band"))
    place = F.floor(F.col("at") / _step(F.col("band"), share)).cast("int")
    cut = cut.select("v", "nc", "q", "gram", "at", "band", F.explode(F.array(place - 1, place, place + 1)).alias("place"))
    return cut.select("v", "nc", "at", _key(F.col("q"), F.col("gram"), F.col("band"), F.col("place")).alias("k"))


def edit_candidates(texts: DataFrame, share: float) -> DataFrame:
    """(u, v), u before v, of every pair of ``texts`` (v, norm, nc = length > 0) whose edit
    distance is at most ``share`` of the longer length (and some more pairs)."""
    if not 0 <= share < 0.5:
        raise ValueError("share must be at least 0 and below 0.5")
    share = max(share, 1e-6)
    long = _asks(texts, share).select(F.col("v").alias("a"), F.col("nc").alias("na"), F.col("at").alias("pa"), "k")
    short = _offers(texts, share).select(F.col("v").alias("b"), F.col("nc").alias("nb"), F.col("at").alias("pb"),
                                         F.col("k").alias("k2"))
    shift = F.abs(F.col("pa") - F.col("pb")) + F.abs((F.col("na") - F.col("pa")) - (F.col("nb") - F.col("pb")))
    longer = (F.col("na") > F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    # many rows come from few bytes of text, which Spark would take for a table to broadcast
    hits = long.hint("merge").join(short.hint("merge"), (F.col("k") == F.col("k2")) & longer & (shift <= edits(F.col("na"), share)))
    return hits.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
