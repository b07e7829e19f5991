"""Resolution of duplicate groups: keep_latest, merge and flag_only.

Plans are long-format action tables (one row per affected record), never an id list
per group, so a group holding a third of the table is still spread over many tasks.
Applying a plan is a left join on ``id`` producing a new snapshot of the table; nothing
is updated in place and nothing is deleted.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, functions as F

from ..functions.text import group_marker, keep_latest_marker, merged_into_marker, ts_text

STRATEGIES = ("keep_latest", "merge", "flag_only")
# rows per partial string when building the merged "Original dates" text
_MERGE_BUCKET = 1024


def plan(groups: DataFrame, strategy: str = "keep_latest") -> DataFrame:
    """Actions: ``action, group_id, kept_id, affected_id, rank_in_group, group_size``.

    keep_latest and merge keep the seed (the newest record: first in scan order) and
    affect the others; flag_only affects every member, the seed included."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    g = groups
    if strategy != "flag_only":
        g = g.filter(~F.col("is_seed"))
    return g.select(F.lit(strategy).alias("action"), "group_id",
                    F.col("seed_id").alias("kept_id"), F.col("member_id").alias("affected_id"),
                    "rank_in_group", "group_size")


def resolution_totals(groups: DataFrame) -> DataFrame:
    """groups_processed and records_affected (= sum of group sizes)."""
    return groups.agg(F.count(F.when(F.col("is_seed"), 1)).alias("groups_processed"),
                      F.count(F.lit(1)).alias("records_affected"))


def _ts_lit(run_ts) -> F.Column:
    if isinstance(run_ts, _dt.datetime):
        run_ts = run_ts.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(str(run_ts)).cast("timestamp_ntz")


def merged_texts(groups: DataFrame, obs: DataFrame, run_ts, content_col: str = "content") -> DataFrame:
    """``(id, merged)`` for each group's primary: its text, then
    ``[MERGED from k duplicates on <run_ts>]`` and ``[Original dates: ...]`` listing the
    secondaries' times in scan order.  Built in two levels (fixed-size rank buckets,
    then the buckets in order) so no task sorts a whole hot group."""
    sec = groups.filter(~F.col("is_seed")).select(
        "group_id", "rank_in_group", ts_text(F.col("created_at")).alias("d"),
        (F.col("rank_in_group") / _MERGE_BUCKET).cast("long").alias("b"))
    part = sec.groupBy("group_id", "b").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank_in_group", "d"))),
                                 lambda x: x["d"]), ", ").alias("s")).withColumn("s", F.nullif("s", F.lit("")))
    dates = part.groupBy("group_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "s"))),
                                 lambda x: x["s"]), ", ").alias("dates"))
    prim = groups.filter(F.col("is_seed")).select(F.col("member_id").alias("id"), "group_id", "group_size")
    prim = prim.join(dates, "group_id").join(obs.select("id", F.col(content_col).alias("_c")), "id")
    merged = F.concat(F.col("_c"), F.lit("\n[MERGED from "), (F.col("group_size") - 1).cast("string"),
                      F.lit(" duplicates on "), ts_text(_ts_lit(run_ts)), F.lit("]"),
                      F.lit("\n[Original dates: "), F.col("dates"), F.lit("]"))
    return prim.select("id", merged.alias("merged"))


def merged_chunks(groups: DataFrame, obs: DataFrame, run_ts, content_col: str = "content") -> DataFrame:
    """``(id, chunk, text)``: the merged text of :func:`merged_texts` as ordered rows, so that
    no cell grows with its group.  Chunk 0 is the primary's own text and the heading of the
    dates; each later one holds at most ``_MERGE_BUCKET`` dates (some 21 KB), from one bucket
    of ranks, with its separator; the last closes the bracket.  Joined in order of ``chunk``
    they are the merged text.  A group without times has empty dates; an id whose text is
    NULL keeps a NULL chunk 0."""
    seed = groups.filter(F.col("is_seed") & (F.col("group_size") > 1)).select(F.col("member_id").alias("id"), "group_size")
    head = F.concat(F.col("_c"), F.lit("\n[MERGED from "), (F.col("group_size") - 1).cast("string"), F.lit(" duplicates on "),
                    ts_text(_ts_lit(run_ts)), F.lit("]\n[Original dates: "))
    heads = seed.join(obs.select("id", F.col(content_col).alias("_c")), "id").select("id", F.lit(0).cast("long").alias("chunk"), head.alias("text"))
    bucket = lambda rank: F.floor(rank / _MERGE_BUCKET).cast("long")
    times = groups.filter(~F.col("is_seed")).select(F.col("seed_id").alias("id"), "rank_in_group", "group_size",
                                                    bucket(F.col("rank_in_group")).alias("b"), ts_text(F.col("created_at")).alias("d"))
    parts = times.groupBy("id", "b", "group_size").agg(F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("rank_in_group", "d"))), lambda x: x["d"]), ", ").alias("s"))
    # rows without a time are last in scan order, so a bucket that has any dates follows one that has
    comma = F.when((F.col("b") > 0) & (F.col("s") != ""), F.lit(", ")).otherwise(F.lit(""))
    close = F.when(F.col("b") == bucket(F.col("group_size") - 1), F.lit("]")).otherwise(F.lit(""))
    return heads.unionByName(parts.select("id", (F.col("b") + 1).alias("chunk"), F.concat(comma, F.col("s"), close).alias("text")))


def apply(obs: DataFrame, groups: DataFrame, strategy: str = "keep_latest", run_ts=None,
          content_col: str = "content") -> DataFrame:
    """The table after resolution (same columns, same rows)."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    c = F.col(content_col)
    if strategy == "keep_latest":
        marks = groups.filter(~F.col("is_seed")).select(F.col("member_id").alias("id"),
                                                        keep_latest_marker(F.col("seed_id")).alias("_m"))
        out = obs.join(marks, "id", "left")
        return out.withColumn(content_col, F.when(F.col("_m").isNull(), c).otherwise(F.concat(c, F.col("_m")))) \
                  .drop("_m").select(*obs.columns)
    if strategy == "flag_only":
        marks = groups.select(F.col("member_id").alias("id"), group_marker(F.col("group_id")).alias("_m"))
        out = obs.join(marks, "id", "left")
        return out.withColumn(content_col, F.when(F.col("_m").isNull(), c).otherwise(F.concat(c, F.col("_m")))) \
                  .drop("_m").select(*obs.columns)
    if run_ts is None:
        raise ValueError("merge needs run_ts (the time written into the merged text and updated_at)")
    marks = groups.filter(~F.col("is_seed")).select(F.col("member_id").alias("id"),
                                                    merged_into_marker(F.col("seed_id")).alias("_m"))
    merged = merged_texts(groups, obs, run_ts, content_col)
    out = obs.join(marks, "id", "left").join(merged, "id", "left")
    out = (out.withColumn(content_col,
                          F.when(F.col("merged").isNotNull(), F.col("merged"))
                           .when(F.col("_m").isNotNull(), F.concat(c, F.col("_m"))).otherwise(c))
              .withColumn("updated_at", F.when(F.col("merged").isNotNull(), _ts_lit(run_ts))
                          .otherwise(F.col("updated_at"))))
    return out.drop("_m", "merged").select(*obs.columns)
