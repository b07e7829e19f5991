"""Checkpoint filtering: detect machine-generated rows by pattern, group them under a
masked signature, and consolidate each group into one summary row.

Plan shape: one scan; ``is_checkpoint`` and ``signature`` columns; a two-level
aggregate (per signature, then global) with map-side partial aggregation, so a
signature holding a third of the table is combined before the shuffle.  In the default
``signature`` re-fetch mode the rows of a group are exactly the rows with that
signature, so the consolidation plan comes out of the same aggregate without a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import CheckpointConfig
from ..functions.pyfmt import py_fixed
from ..functions.text import CONSOLIDATED_MARKER, checkpoint_signature, is_checkpoint, ts_text
from ..plans.ordering import dense_index, scan_key
from ..plans.skew import join_classes, mark_classes
from ..session import cut_lineage, spread
from . import pattern_scan


SAMPLE_CHARS = 100   # of a text that group details show
PREFIX_CHARS = 50    # of a sample that the LIKE re-fetch searches for


def flagged(obs: DataFrame, cfg: CheckpointConfig = CheckpointConfig(), content_col: str = "content") -> DataFrame:
    """``id``, ``created_at``, flag and signature per row, straight from the scan."""
    c = F.col(content_col)
    flag = is_checkpoint(c, list(cfg.patterns))
    return (obs.select("id", "created_at", content_col)
               .withColumn("is_checkpoint", flag)
               .withColumn("signature", F.when(F.col("is_checkpoint"), checkpoint_signature(c))))


def annotate(obs: DataFrame, cfg: CheckpointConfig = CheckpointConfig(),
             content_col: str = "content", partitions: int | None = None) -> DataFrame:
    """Flag, signature, the first ``SAMPLE_CHARS`` characters and the length per row,
    computed once and written to the checkpoint folder; every later aggregate reads this
    slim table.  The whole text is kept only in ``prefix`` mode, whose LIKE re-fetch
    searches it.  ``partitions`` deals the rows out first."""
    c = F.col(content_col)
    ann = (flagged(spread(obs, partitions), cfg, content_col)
           .withColumn("sk", scan_key())
           .withColumn("sample", F.when(F.col("is_checkpoint"), F.substring(c, 1, SAMPLE_CHARS)))
           .withColumn("chars", F.length(c)))
    if cfg.refetch_mode != "prefix":
        ann = ann.drop(content_col)
    return cut_lineage(ann)


def _avg_interval_min(n: Column, first: Column, last: Column) -> Column:
    """Mean gap between consecutive rows in minutes: the consecutive gaps telescope to
    (last - first) / (n - 1), so no sort or window is needed."""
    span_us = F.unix_micros(last.cast("timestamp")) - F.unix_micros(first.cast("timestamp"))
    return F.when(n >= 2, span_us / 60000000.0 / (n - 1))


def frequency_text(avg: Column) -> Column:
    return F.when(avg.isNull(), F.lit("N/A")).otherwise(
        F.concat(F.lit("~"), py_fixed(avg, 1), F.lit(" min")))


def signature_stats(ann: DataFrame) -> DataFrame:
    """One row per signature with more than one row: count, first/last, newest row's
    sample, text length.  The newest row comes from two minima over plain longs (time,
    then id among the rows at that time), which hash aggregates can keep; a minimum
    over the text itself would sort every row."""
    c = ann.filter(F.col("is_checkpoint"))
    stats = cut_lineage(c.groupBy("signature").agg(
        F.count(F.lit(1)).alias("count"),
        F.min("created_at").alias("first_occurrence"),
        F.max("created_at").alias("last_occurrence"),
        F.min(F.col("sk")["t"]).alias("tmin"),
        F.sum("chars").alias("total_chars"),
    ).filter(F.col("count") > 1))
    total = stats.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    times = stats.select("signature", F.col("count").alias("n"), "tmin")
    newest = cut_lineage(join_classes(c.select("signature", "sk", "sample"), times, "signature", "n", total)
                         .filter(F.col("sk")["t"] == F.col("tmin"))
                         .select("signature", F.col("sk")["i"].alias("i"), "sample"))
    ids = newest.groupBy("signature").agg(F.min("i").alias("i"))
    one = newest.join(ids, ["signature", "i"]).dropDuplicates(["signature"])
    return stats.join(one, "signature").select(
        "signature", "count", "first_occurrence", "last_occurrence", F.col("sample").alias("newest_content"),
        F.struct(F.col("tmin").alias("t"), "i").alias("first_sk"), "total_chars")


def checkpoint_totals(ann: DataFrame) -> DataFrame:
    """total, checkpoint and regular rows, signature groups, redundant = sum(n - 1)."""
    per_sig = ann.filter(F.col("is_checkpoint")).groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
    sig = per_sig.agg(F.count(F.lit(1)).alias("g"),
                      F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("r"))
    s = sig.select(F.struct("g", "r")).scalar()
    base = ann.agg(F.count(F.lit(1)).alias("total_observations"),
                   F.count(F.when(F.col("is_checkpoint"), 1)).alias("checkpoint_observations"))
    return (base.withColumn("regular_observations",
                            F.col("total_observations") - F.col("checkpoint_observations"))
                .withColumn("checkpoint_groups", s["g"])
                .withColumn("redundant_checkpoints", s["r"]))


def checkpoint_rates(totals: DataFrame) -> DataFrame:
    """Checkpoint percentage and redundancy rate (unrounded; reports round to 1 decimal)."""
    t, c, r = F.col("total_observations"), F.col("checkpoint_observations"), F.col("redundant_checkpoints")
    return totals.select(
        "total_observations",
        F.when(t > 0, c / t * 100).otherwise(F.lit(0.0)).alias("checkpoint_percentage"),
        F.when(c > 0, r / c * 100).otherwise(F.lit(0.0)).alias("redundancy_rate"),
    )


def checkpoint_groups(ann: DataFrame) -> DataFrame:
    """Detail of every signature with more than one row."""
    s = signature_stats(ann)
    avg = _avg_interval_min(F.col("count"), F.col("first_occurrence"), F.col("last_occurrence"))
    return s.select(
        "signature", "count", "first_occurrence", "last_occurrence",
        F.concat("newest_content", F.lit("...")).alias("sample_content"),
        avg.alias("avg_interval_min"),
        frequency_text(avg).alias("frequency"),
        "first_sk", "total_chars",
    )


def summary_text(n: Column, first: Column, last: Column, freq: Column) -> Column:
    return F.concat(F.lit("SUMMARY: "), n.cast("string"), F.lit(" automatic checkpoints from "),
                    ts_text(first, False), F.lit(" to "), ts_text(last, False), F.lit(" - "), freq)


def _pg_like_pattern(prefix: Column) -> Column:
    """``'%' || prefix || '%'`` with PostgreSQL's reading of backslashes: a backslash
    that does not escape ``%``, ``_`` or another backslash is dropped (Spark would raise)."""
    cleaned = F.regexp_replace(prefix, r"\\([^%_\\])", "$1")
    return F.concat(F.lit("%"), cleaned, F.lit("%"))


def _anchors(pattern: Column) -> Column:
    """Words that every text matching the pattern must hold between two spaces: the inner
    words of its runs without wildcards or escapes."""
    words = F.split(pattern, " ")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    return F.array_distinct(F.filter(inner, lambda w: (F.length(w) > 0) & ~w.rlike(r"[%_\\]")))


def refetch_prefix(ann: DataFrame, groups: DataFrame, content_col: str = "content") -> DataFrame:
    """The reference's re-fetch: rows whose text contains the first ``PREFIX_CHARS``
    characters of the group's sample (LIKE, wildcards not escaped).

    One pass over the rows with an automaton of the patterns' plain parts finds the
    candidates (:mod:`.pattern_scan`), LIKE verifies.  Beyond ``PATTERNS`` groups only
    patterns without an inner word go that way, in several passes; a text that matches one
    of the others holds every inner word of it between spaces, so each of these groups
    looks its rows up by its rarest such word (an equi-join on words)."""
    g = cut_lineage(groups.select("signature", "first_sk", _pg_like_pattern(F.substring("sample_content", 1, PREFIX_CHARS)).alias("pattern"))
                    .withColumn("anchors", _anchors(F.col("pattern"))))
    rows = ann.select("id", F.col(content_col).alias("content"), "created_at")
    if g.count() <= pattern_scan.PATTERNS:
        return pattern_scan.matching_rows(rows, g.drop("anchors")).drop("pattern")
    bare = pattern_scan.matching_rows(rows, g.filter(F.size("anchors") == 0).drop("anchors"))
    return _by_anchor(rows, g.filter(F.size("anchors") > 0)).unionByName(bare).drop("pattern")


def _by_anchor(rows: DataFrame, g: DataFrame) -> DataFrame:
    """Rows that match a pattern of ``g``, looked up by its rarest anchor word."""
    wanted = g.select(F.explode("anchors").alias("word")).distinct()
    words = cut_lineage(rows.select("id", F.explode(F.array_distinct(F.split("content", " "))).alias("word"))
                        .join(wanted, "word", "left_semi"))
    df = cut_lineage(words.groupBy("word").agg(F.count(F.lit(1)).alias("df")))
    ranked = (g.select("signature", F.explode("anchors").alias("word")).join(df, "word", "left")
              .groupBy("signature").agg(F.min_by("word", F.coalesce("df", F.lit(0))).alias("word")))
    keyed = g.drop("anchors").join(ranked, "signature")
    # a word with more than a thousandth of the rows here is dealt to as many parts as hold
    # a thousandth each; there are a thousand such words at most, so they are broadcast
    share = max(1, -(-(df.agg(F.sum("df")).first()[0] or 0) // 1000))
    hot = F.broadcast(df.filter(F.col("df") > share).select("word", F.ceil(F.col("df") / share).cast("int").alias("salts")))
    left = words.join(hot, "word", "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    right = keyed.join(hot, "word", "left").withColumn("salt", F.explode(F.expr("sequence(0, coalesce(salts, 1) - 1)"))).drop("salts")
    hits = left.join(right, ["word", "salt"]).select("id", "signature", "first_sk", "pattern")
    return rows.join(hits, "id").filter(F.expr("content LIKE pattern"))


def _plan_from_stats(stats: DataFrame) -> DataFrame:
    avg = _avg_interval_min(F.col("count"), F.col("first_occurrence"), F.col("last_occurrence"))
    summary = summary_text(F.col("count"), F.col("first_occurrence"), F.col("last_occurrence"),
                           frequency_text(avg))
    return stats.select(
        F.lit("consolidate_group").alias("action"),
        F.col("signature").alias("group_signature"),
        F.col("count").alias("records_affected"),
        (F.col("total_chars") - F.length(summary)).alias("space_saved_chars"),
        summary.alias("consolidated_content"),
        "first_occurrence", "last_occurrence", "first_sk",
    )


def consolidation_plan(ann: DataFrame, cfg: CheckpointConfig = CheckpointConfig(),
                       content_col: str = "content") -> DataFrame:
    """Dry run: one action per group that would be consolidated.  Empty when the total
    of redundant rows is below ``consolidation_threshold`` (the reference's gate)."""
    groups = checkpoint_groups(ann)
    if cfg.refetch_mode == "prefix":
        hits = refetch_prefix(ann, groups, content_col)
        stats = (hits.groupBy("signature").agg(
            F.count(F.lit(1)).alias("count"),
            F.min("created_at").alias("first_occurrence"),
            F.max("created_at").alias("last_occurrence"),
            F.sum(F.length("content")).alias("total_chars"),
            F.min(F.col("first_sk")["t"]).alias("_t"), F.min(F.col("first_sk")["i"]).alias("_i"))
            .filter(F.col("count") > 1)
            .withColumn("first_sk", F.struct(F.col("_t").alias("t"), F.col("_i").alias("i"))).drop("_t", "_i"))
    else:
        stats = groups.select("signature", "count", "first_occurrence", "last_occurrence",
                              "total_chars", "first_sk")
    redundant = checkpoint_totals(ann).select("redundant_checkpoints").scalar()
    return _plan_from_stats(stats).filter(redundant >= F.lit(cfg.consolidation_threshold))


def prefix_hits(ann: DataFrame, plan: DataFrame, content_col: str = "content") -> DataFrame:
    """(id, times) in ``prefix`` mode, where several groups can hit a row: it is marked
    once per group, as in the reference."""
    hits = refetch_prefix(ann, checkpoint_groups(ann), content_col)
    hits = hits.join(plan.select(F.col("group_signature").alias("signature")), "signature", "left_semi")
    return hits.groupBy("id").agg(F.count(F.lit(1)).alias("times"))


def consolidate_apply(obs: DataFrame, cfg: CheckpointConfig = CheckpointConfig(),
                      content_col: str = "content", ann: DataFrame | None = None,
                      plan: DataFrame | None = None) -> DataFrame:
    """The table after consolidation: re-fetched rows get `` [CONSOLIDATED]`` and one
    summary row per group is added (id = max(id) + 1.. in group order, created_at =
    last occurrence).  All groups are scored against the input snapshot.  ``ann`` and
    ``plan`` may be passed in when the caller already computed them.

    In ``signature`` mode a row's mark follows from its own signature, so the table is
    not joined by id."""
    if ann is None:
        ann = annotate(obs, cfg, content_col)
    if plan is None:
        plan = cut_lineage(consolidation_plan(ann, cfg, content_col))
    c = F.col(content_col)
    if cfg.refetch_mode == "prefix":
        marked = (obs.join(prefix_hits(ann, plan, content_col), "id", "left")
                     .withColumn(content_col, F.when(F.col("times").isNull(), c)
                                 .otherwise(F.concat(c, F.expr(f"repeat('{CONSOLIDATED_MARKER}', times)"))))
                     .drop("times"))
    else:
        total = plan.agg(F.coalesce(F.sum("records_affected"), F.lit(0))).first()[0]
        signed = obs.withColumn("_signature", F.when(is_checkpoint(c, list(cfg.patterns)), checkpoint_signature(c)))
        acted = plan.select(F.col("group_signature").alias("_signature"), "records_affected")
        marked = (mark_classes(signed, acted, "_signature", "records_affected", total, "_acted")
                  .withColumn(content_col, F.when(F.col("_acted"), F.concat(c, F.lit(CONSOLIDATED_MARKER))).otherwise(c))
                  .select(*obs.columns))
    max_id = obs.agg(F.max("id")).scalar()
    summaries = dense_index(plan.select("consolidated_content", "last_occurrence", "first_sk"),
                            [F.col("first_sk")], "_gi")
    new_rows = summaries.select(
        (F.coalesce(max_id, F.lit(0)) + 1 + F.col("_gi")).alias("id"),
        F.col("consolidated_content").alias(content_col),
        F.col("last_occurrence").alias("created_at"),
    )
    for c in obs.columns:
        if c not in new_rows.columns:
            new_rows = new_rows.withColumn(c, F.lit(None).cast(obs.schema[c].dataType))
    return marked.unionByName(new_rows.select(*obs.columns))


def filter_summary(ann: DataFrame, cfg: CheckpointConfig = CheckpointConfig(),
                   content_col: str = "content", plan: DataFrame | None = None,
                   groups: DataFrame | None = None, applied: bool = False) -> DataFrame:
    """One row for the filtering report: totals, rates, groups with duplicates and the
    (gated) space the consolidation saves, or would save in a dry run."""
    totals = checkpoint_totals(ann)
    if plan is None:
        plan = consolidation_plan(ann, cfg, content_col)
    if groups is None:
        groups = checkpoint_groups(ann)
    n_groups = groups.agg(F.count(F.lit(1))).scalar()
    p = plan.agg(F.struct(F.coalesce(F.sum("space_saved_chars"), F.lit(0)).alias("saved"),
                          F.count(F.lit(1)).alias("acted"))).scalar()
    groups, saved, acted = n_groups, p["saved"], p["acted"]
    t, c, r = F.col("total_observations"), F.col("checkpoint_observations"), F.col("redundant_checkpoints")
    return totals.select(
        "*",
        F.when(t > 0, c / t * 100).otherwise(F.lit(0.0)).alias("checkpoint_percentage"),
        F.when(c > 0, r / c * 100).otherwise(F.lit(0.0)).alias("redundancy_rate"),
        groups.alias("groups_with_duplicates"),
        saved.cast("long").alias("space_saved_chars"),
        acted.alias("groups_consolidated"),
        F.when(r < cfg.consolidation_threshold, F.lit("no_action_needed"))
         .otherwise(F.lit("filtering_applied" if applied else "dry_run_completed")).alias("action"),
    )
