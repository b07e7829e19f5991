"""Duplicate grouping: preparation, the exact path, group numbering and totals.

The reference scans newest first; an unclaimed record becomes a seed and claims every
later unclaimed record whose composite similarity *to the seed* reaches the threshold.
When the threshold can only be met by equal normalized texts (the default: 0.85 with
weights .3/.25/.25/.2, since unequal texts score below .25+.25+.2 = .7), that is exactly
"group by normalized text, seed = first in scan order": one hash aggregate with
map-side partial aggregation, so a hot text (even a third of the table) is combined
before the shuffle.  The fuzzy path lives in :mod:`scrubjay.plans.candidates` and
:mod:`scrubjay.plans.grouping` and feeds the same numbering.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..config import DedupConfig, Weights
from ..functions.text import normalize_text
from ..plans.ordering import dense_index, scan_key
from ..plans.skew import join_classes
from ..session import cut_lineage, spread
from ..sources.observations import filter_entity

GROUP_COLUMNS = ["group_id", "seed_id", "member_id", "rank_in_group", "is_seed", "group_size", "created_at",
                 "exact_match", "sequence_similarity", "levenshtein_similarity",
                 "jaccard_similarity", "composite_similarity"]


def norm_key(norm) -> F.Column:
    """128-bit grouping key of a normalized text: shuffles 16 bytes instead of the text."""
    return F.unhex(F.md5(norm))


def prepare(obs: DataFrame, entity: str | None = None, content_col: str = "content",
            partitions: int | None = None) -> DataFrame:
    """Scan (with the optional entity filter), scan key and normalized text, once per row;
    ``partitions`` deals the rows out first."""
    obs = spread(filter_entity(obs, entity).select("id", content_col, "created_at"), partitions)
    return obs.select(
        "id", F.col(content_col).alias("content"), "created_at",
        scan_key().alias("sk"),
        normalize_text(F.col(content_col)).alias("norm"),
    )


def number_groups(members: DataFrame) -> DataFrame:
    """members: ``(id, created_at, sk, seed_sk, ...)`` with the seed row included.

    Adds ``group_id`` (0.. in seed scan order), ``seed_id``, ``rank_in_group`` (0 = seed,
    then scan order) and ``is_seed``; no single-partition window is used."""
    ranked = cut_lineage(dense_index(members, [F.col("seed_sk"), F.col("sk")], "_gidx"))
    seeds = ranked.filter(F.col("sk") == F.col("seed_sk")).select(
        "seed_sk", F.col("id").alias("seed_id"), F.col("_gidx").alias("_start"))
    seeds = dense_index(seeds, [F.col("_start")], "group_id")
    sizes = ranked.groupBy("seed_sk").agg(F.count(F.lit(1)).alias("group_size"))
    starts = cut_lineage(seeds.join(sizes, "seed_sk"))
    total = starts.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    out = join_classes(ranked, starts, "seed_sk", "group_size", total)
    return (out.withColumn("rank_in_group", (F.col("_gidx") - F.col("_start")).cast("int"))
               .withColumn("is_seed", F.col("rank_in_group") == 0)
               .withColumnRenamed("id", "member_id")
               .drop("_gidx", "_start"))


def _exact_scores(weights: Weights):
    composite = (1.0 * weights.exact_match + 1.0 * weights.sequence_similarity
                 + 1.0 * weights.levenshtein_similarity + 1.0 * weights.jaccard_similarity)
    return {"exact_match": 1.0, "sequence_similarity": 1.0, "levenshtein_similarity": 1.0,
            "jaccard_similarity": 1.0, "composite_similarity": composite}


def with_scores(groups: DataFrame, scores: dict) -> DataFrame:
    for name, value in scores.items():
        groups = groups.withColumn(
            name, F.when(F.col("is_seed"), F.lit(None).cast("double")).otherwise(F.lit(float(value))))
    return groups


def exact_groups(prep: DataFrame, weights: Weights = Weights()) -> DataFrame:
    """Groups of equal normalized text with more than one member."""
    # slim rows (ids, times, 16-byte key) are read twice, by the class aggregate and
    # by the join back, so they are written once: the text is normalized once (a merely
    # persisted frame can be computed by two concurrent stages) and never shuffled.  The NULL
    # test is on the raw text: a predicate on ``norm`` would be pushed below the input
    # repartition and normalize every row twice.
    p = cut_lineage(prep.filter(F.col("content").isNotNull())
                        .select("id", "created_at", "sk", norm_key(F.col("norm")).alias("key")))
    # seed = first row in scan order = smallest (t, i) of the scan key.  Both steps are
    # hash aggregates over plain longs: the smallest t per text over all rows, then the
    # smallest i among the (duplicate) rows at that t; a struct min would need a
    # sort-based aggregate over every row.
    classes = cut_lineage(p.groupBy("key")
                           .agg(F.count(F.lit(1)).alias("n"), F.min(F.col("sk")["t"]).alias("tmin"))
                           .filter(F.col("n") > 1))
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    members = cut_lineage(join_classes(p, classes, "key", "n", total))
    seeds = (members.filter(F.col("sk")["t"] == F.col("tmin"))
                    .groupBy("key").agg(F.min(F.col("sk")["i"]).alias("imin"), F.max("n").alias("size")))
    members = (join_classes(members, cut_lineage(seeds), "key", "size", total)
               .withColumn("seed_sk", F.struct(F.col("tmin").alias("t"), F.col("imin").alias("i")))
               .drop("key", "tmin", "imin", "n", "size"))
    groups = number_groups(members)
    return with_scores(groups, _exact_scores(weights)).select(*GROUP_COLUMNS)


def is_exact_only(cfg: DedupConfig) -> bool:
    w = cfg.weights
    return cfg.similarity_threshold >= (w.sequence_similarity + w.levenshtein_similarity
                                        + w.jaccard_similarity) + 1e-9


def find_groups(obs: DataFrame, cfg: DedupConfig = DedupConfig(), entity: str | None = None,
                content_col: str = "content", partitions: int | None = None) -> DataFrame:
    """The duplicate groups of an observation table, long format (one row per member);
    ``partitions`` deals out an input of too few splits first."""
    prep = prepare(obs, entity, content_col, partitions)
    if cfg.similarity_threshold > cfg.weights.total + 1e-12:
        return exact_groups(prep.limit(0), cfg.weights)
    if is_exact_only(cfg):
        return exact_groups(prep, cfg.weights)
    from ..plans.grouping import fuzzy_groups
    return fuzzy_groups(prep, cfg)


def dedup_totals(obs: DataFrame, groups: DataFrame, entity: str | None = None) -> DataFrame:
    """total_records, duplicate_groups, duplicate_records (all members, kept one
    included) and duplicate_rate in percent (0 for an empty table)."""
    g = groups.agg(F.count(F.when(F.col("is_seed"), 1)).alias("g"),
                   F.count(F.lit(1)).alias("r"))
    base = filter_entity(obs, entity).agg(F.count(F.lit(1)).alias("total_records"))
    out = (base.withColumn("duplicate_groups", g.select("g").scalar())
               .withColumn("duplicate_records", g.select("r").scalar()))
    rate = F.when(F.col("total_records") > 0,
                  F.col("duplicate_records") / F.col("total_records") * 100).otherwise(F.lit(0.0))
    return out.withColumn("duplicate_rate", rate)


def summarize(obs: DataFrame, cfg: DedupConfig = DedupConfig(), entity: str | None = None,
              content_col: str = "content", partitions: int | None = None) -> DataFrame:
    """``dedup_totals`` for a table.  On the exact path the class aggregate alone gives
    the counts (groups = classes with more than one row, records = their rows), so no
    numbering, join or sort runs; otherwise the groups are built first."""
    if not is_exact_only(cfg) or cfg.similarity_threshold > cfg.weights.total + 1e-12:
        return dedup_totals(obs, find_groups(obs, cfg, entity, content_col, partitions), entity)
    prep = prepare(obs, entity, content_col, partitions)
    classes = (prep.filter(F.col("content").isNotNull())
                   .groupBy(norm_key(F.col("norm")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
                   .filter(F.col("n") > 1))
    g = classes.agg(F.count(F.lit(1)).alias("g"), F.coalesce(F.sum("n"), F.lit(0)).alias("r"))
    s = g.select(F.struct("g", "r")).scalar()
    base = filter_entity(obs, entity).agg(F.count(F.lit(1)).alias("total_records"))
    out = base.withColumn("duplicate_groups", s["g"]).withColumn("duplicate_records", s["r"])
    rate = F.when(F.col("total_records") > 0,
                  F.col("duplicate_records") / F.col("total_records") * 100).otherwise(F.lit(0.0))
    return out.withColumn("duplicate_rate", rate)
