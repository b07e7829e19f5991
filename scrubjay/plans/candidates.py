"""Threshold-aware, lossless candidate generation for the similarity self-join.

For two unequal normalized texts the exact-match term is 0 and the sequence and
Levenshtein terms are each below 1, so a pair can reach threshold ``t`` only if its
word Jaccard is at least ``tau = (t - s - l) / j``.  That turns the all-pairs loop into an
exact set-similarity join (:mod:`.set_join`): sets of words, ordered from rare to frequent,
that reach ``tau`` share several of their first words.  Shared words are counted in posting
lists within a task, and only pairs with enough of them become rows, so no row exists for
texts that share a word by chance.

The join also applies the length bound: with m <= M the two text lengths,
ratio <= 2m/(m+M), Levenshtein similarity <= m/M and Jaccard <= min/max word count, so
``s*2m/(m+M) + l*m/M + j*min/max < t`` rules a pair out before any text is compared.
Where that floor is low or negative, pairs are split by their Jaccard: those with a quarter
or more come from the set join, the others must be near in edit distance and come
from a partition join (:mod:`.edit_join`).

Candidates are verified by their texts (:mod:`.text_cells`): the exact Jaccard, a bound from
character counts, then Levenshtein and ratio.  Texts stay where they were written; only those
on a candidate pair are shuffled, to the cells that hold their pairs and not once a pair.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..config import DedupConfig
from ..functions.similarity import composite
from ..functions.text import word_set
from ..session import cut_lineage
from .edit_join import edit_candidates
from .set_join import set_candidates
from .text_cells import scored_in_cells

EPS = 1e-9
#: Texts on candidate pairs up to this number (eight bytes each) are picked by a broadcast.
BROADCAST_KEYS = 500_000


def jaccard_floor(cfg: DedupConfig) -> float:
    w, t = cfg.weights, cfg.similarity_threshold
    if w.jaccard_similarity <= 0:
        return 0.0
    return (t - w.sequence_similarity - w.levenshtein_similarity) / w.jaccard_similarity


#: Jaccard values at which the pairs are split between the two filters, tried in order.
SPLITS = (0.25, 0.1)
#: Up to this share of edits the partition join has segments of four characters or more.
GOOD_SHARE = 0.2


def filters(cfg: DedupConfig) -> tuple[float | None, float | None]:
    """(Jaccard floor, share of edits): every unequal pair that reaches the threshold has at
    least that word Jaccard, or at most that share of the longer length as edit distance.
    None stands for a filter that is not needed.

    With d edits and lengths m <= M, Levenshtein similarity is 1 - d/M and the ratio at most
    1 - d/(m+M) <= 1 - d/2M.  A pair with a Jaccard below ``a`` therefore reaches t only if
    ``s*(1 - x/2) + l*(1 - x) + j*a >= t`` for its share x = d/M."""
    w, t = cfg.weights, cfg.similarity_threshold
    s, l, j = w.sequence_similarity, w.levenshtein_similarity, w.jaccard_similarity
    tau = jaccard_floor(cfg)
    if j > 0 and (tau >= SPLITS[0] or (tau > 0 and s + l <= 0)):
        return tau, None
    share = None
    if s + l > 0:
        for a in SPLITS if j > 0 else (0.0,):
            share = max(0.0, (s + l + j * a - t) / (s / 2 + l))
            if share <= GOOD_SHARE:
                break
    if t <= 0 or share is None or share >= 0.5:
        raise ValueError(
            f"threshold {t} with weights {w} admits pairs that share neither words nor passages; "
            "no lossless candidate filter exists, and an all-pairs comparison is not offered. "
            "Raise the threshold.")
    return (max(a, tau) if j > 0 else None), share + EPS


def _length_bound(cfg: DedupConfig, tau: float):
    """Whether two texts of these lengths and numbers of words can reach the threshold, on
    numbers or arrays: ratio <= 2m/(m+M), Levenshtein similarity <= m/M, Jaccard <= min/max (or
    the given ``jac``)."""
    w, t = cfg.weights, cfg.similarity_threshold
    s, l, j = w.sequence_similarity, w.levenshtein_similarity, w.jaccard_similarity

    def bound(ma, mb, wa, wb, jac=None):
        m, big = np.minimum(ma, mb), np.maximum(ma, mb)
        words = np.minimum(wa, wb) / np.maximum(wa, wb) if jac is None else jac
        return (words >= tau - EPS) & (s * (2 * m / (m + big)) + l * (m / big) + j * words >= t - EPS)
    return bound


def _edit_pairs(texts: DataFrame, share: float) -> DataFrame:
    ids = texts.select(F.struct("v", F.col("key").alias("k")).alias("v"), "norm", "nc")
    found = edit_candidates(ids, share)
    return found.select(F.col("u.v").alias("u"), F.col("v.v").alias("v"), F.col("u.k").alias("uk"), F.col("v.k").alias("vk"))


def candidate_pairs(texts: DataFrame, cfg: DedupConfig) -> DataFrame:
    """(u, v, uk, vk), u earlier in scan order and uk, vk their keys, of the texts (key, v,
    norm, nc) that share enough rare words and have lengths that fit, or share a segment
    where the edit distance allows (:func:`filters`)."""
    tau, share = filters(cfg)
    found = [] if tau is None else [set_candidates(texts, tau, _length_bound(cfg, tau))]
    if share is not None:
        found.append(_edit_pairs(texts, share))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1]).distinct()


def _involved(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """key, norm and nc of the texts on a pair, once each; up to ``BROADCAST_KEYS`` of them
    are picked where the texts lie, so that no other is shuffled."""
    keys = pairs.select(F.xxhash64("uk").alias("_h")).unionByName(pairs.select(F.xxhash64("vk").alias("_h"))).distinct()
    keys = cut_lineage(keys)
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    own = texts.join(keys, F.xxhash64("key") == F.col("_h"), "left_semi").groupBy("key").agg(F.first("norm").alias("norm"), F.first("nc").alias("nc"))
    return cut_lineage(own, "zstd")


def scored_edges(texts: DataFrame, cfg: DedupConfig) -> DataFrame:
    """Verified similarity edges ``(u, v, exact_match, sequence_similarity,
    levenshtein_similarity, jaccard_similarity, composite_similarity)``, u earlier, of the
    distinct ``texts`` (key, v, norm, nc; several filters read them, so they should be
    written)."""
    w, t = cfg.weights, cfg.similarity_threshold
    if filters(cfg)[1] is not None:  # segments take each text once
        texts = cut_lineage(texts.groupBy("key").agg(F.min("v").alias("v"), F.first("norm").alias("norm"), F.first("nc").alias("nc")))
    cand = cut_lineage(candidate_pairs(texts, cfg))
    # written once: a filter on the scores would otherwise be pushed below their making
    p = cut_lineage(scored_in_cells(cand, _involved(texts, cand), 0.0, w, t, cfg.autojunk))
    exact = F.lit(0.0)
    comp = composite(w, exact, F.col("seq"), F.col("lev"), F.col("jaccard"))
    return (p.select("u", "v", exact.alias("exact_match"), F.col("seq").alias("sequence_similarity"),
                     F.col("lev").alias("levenshtein_similarity"), F.col("jaccard").alias("jaccard_similarity"),
                     comp.alias("composite_similarity"))
             .filter(F.col("composite_similarity") >= F.lit(t)))


def texts_of(rows: DataFrame) -> DataFrame:
    """(key, v, norm, nc) of every row (key, sk, norm) with a text; copies stay, so that no
    text is shuffled to find them."""
    return rows.filter(F.length("norm") > 0).select("key", F.col("sk").alias("v"), "norm", F.length("norm").alias("nc"))


def representatives(rows: DataFrame) -> DataFrame:
    """One row per distinct non-empty normalized text: the first row in scan order
    (``v`` = its scan key), with word set, word count and length."""
    reps = (rows.filter(F.length("norm") > 0)
                .groupBy("key").agg(F.min("sk").alias("v"), F.min_by("norm", "sk").alias("norm")))
    return reps.select("key", "v", "norm", word_set(F.col("norm")).alias("words"),
                       F.length("norm").alias("nc")).withColumn("nw", F.size("words"))


def jaccard_pairs(rows: DataFrame, tau: float, edits: bool = False) -> DataFrame:
    """All pairs of distinct normalized texts with word Jaccard >= tau (counting join and
    verification): ``(u, v, jaccard)``, and with ``edits`` the exact and Levenshtein
    similarities ``exact`` and ``lev``."""
    if tau <= 0:
        raise ValueError("tau must be positive")
    texts = cut_lineage(texts_of(rows), "zstd")
    cand = cut_lineage(set_candidates(texts, tau))
    return scored_in_cells(cand, _involved(texts, cand), tau, edits=edits)


__all__ = ["candidate_pairs", "scored_edges", "representatives", "texts_of", "jaccard_pairs", "jaccard_floor",
           "filters"]
