"""Effectiveness monitor: the metrics snapshot of an observation table.

The reference issues five SQL aggregates.  Here: one conditional aggregate over the
scan (counts, length, oldest/newest, LIKE-style checkpoint and processed counts), one
grouped aggregate over a 16-byte content key for exact duplicates (partial aggregation
before the shuffle) and one small per-day aggregate for recent activity.  ``as_of``
replaces ``NOW()`` so a snapshot is reproducible.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, functions as F

from ..config import MonitorConfig
from ..functions.text import is_processed, monitor_checkpoint_like
from ..session import cut_lineage


def content_key(c) -> F.Column:
    """Exact-content grouping key; NULL content keeps one NULL group, as GROUP BY does."""
    return F.unhex(F.md5(F.col(c) if isinstance(c, str) else c))


def _ts(as_of) -> F.Column:
    if isinstance(as_of, F.Column):
        return as_of.cast("timestamp_ntz")
    if isinstance(as_of, _dt.datetime):
        as_of = as_of.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(str(as_of)).cast("timestamp_ntz")


def daily_activity(obs: DataFrame, as_of, cfg: MonitorConfig = MonitorConfig()) -> DataFrame:
    """Rows per day since ``as_of - activity_days`` (date, count)."""
    since = _ts(as_of) - F.expr(f"INTERVAL {int(cfg.activity_days)} DAYS")
    return (obs.filter(F.col("created_at") >= since)
               .groupBy(F.to_date("created_at").alias("date"))
               .agg(F.count(F.lit(1)).alias("daily_count")))


def percentage(x: F.Column, total: F.Column) -> F.Column:
    return F.when(total > 0, x / total * 100).otherwise(F.lit(0.0))


def _general(length, checkpoint, processed) -> list:
    return [F.count(F.lit(1)).alias("total_records"),
            F.coalesce(F.avg(length), F.lit(0.0)).alias("avg_text_length"),
            F.min("created_at").alias("oldest_record"),
            F.max("created_at").alias("newest_record"),
            F.count(F.when(checkpoint, 1)).alias("total_checkpoints"),
            F.count(F.when(processed, 1)).alias("processed_records")]


def general(obs: DataFrame, content_col: str = "content") -> DataFrame:
    """Counts, mean length (0 for an empty table), oldest and newest: one aggregate."""
    c = F.col(content_col)
    return obs.agg(*_general(F.length(c), monitor_checkpoint_like(c), is_processed(c)))


def activity(obs: DataFrame, as_of, cfg: MonitorConfig = MonitorConfig()) -> DataFrame:
    """active_days, avg_daily_activity (mean over active days) and daily_counts, newest
    day first (at most ``activity_days`` + 1 entries)."""
    entry = F.struct("date", F.col("daily_count").alias("count"))
    return daily_activity(obs, as_of, cfg).agg(
        F.count(F.lit(1)).alias("active_days"),
        F.when(F.count(F.lit(1)) > 0, F.sum("daily_count") / F.count(F.lit(1))).otherwise(F.lit(0.0)).alias("avg_daily_activity"),
        F.sort_array(F.collect_list(entry), asc=False).alias("daily_counts"))


def snapshot(obs: DataFrame, as_of, cfg: MonitorConfig = MonitorConfig(),
             content_col: str = "content") -> DataFrame:
    """One row of unrounded metrics (the report rounds them to 2 decimals).

    The text is read once: a slim projection (16-byte content key, length, two flags,
    time) is written to the checkpoint folder and the three aggregates read that."""
    c = F.col(content_col)
    slim = cut_lineage(obs.select(
        content_key(c).alias("k"), F.length(c).alias("len"),
        monitor_checkpoint_like(c).alias("ck"), is_processed(c).alias("pr"), "created_at"))
    base = slim.agg(*_general(F.col("len"), F.col("ck"), F.col("pr")))
    dups = (slim.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
                .filter(F.col("n") > 1)
                .agg(F.count(F.lit(1)).alias("g"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("d")))
    d = dups.select(F.struct("g", "d")).scalar()
    a = activity(slim, as_of, cfg).select(F.struct("active_days", "avg_daily_activity", "daily_counts")).scalar()
    total = F.col("total_records")
    return base.select(
        _ts(as_of).alias("run_ts"),
        "total_records", "avg_text_length", "oldest_record", "newest_record",
        "total_checkpoints", percentage(F.col("total_checkpoints"), total).alias("checkpoint_percentage"),
        d["g"].alias("duplicate_groups"), d["d"].alias("total_duplicates"),
        percentage(d["d"], total).alias("duplicate_rate"),
        "processed_records", percentage(F.col("processed_records"), total).alias("processing_rate"),
        a["active_days"].alias("active_days"), a["avg_daily_activity"].alias("avg_daily_activity"),
        a["daily_counts"].alias("daily_counts"),
    )


def quality_metrics(obs: DataFrame, content_col: str = "content") -> DataFrame:
    """Storage utilization, completeness and integrity of an observation table: text
    bytes (UTF-8), NULL ratios, ids that occur more than once.  One aggregate pass plus
    one grouped count on ``id`` (partial aggregation before the shuffle)."""
    c = F.col(content_col)
    base = obs.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.coalesce(F.sum(F.octet_length(c)), F.lit(0)).alias("content_bytes"),
        F.coalesce(F.sum(F.length(c)), F.lit(0)).alias("content_chars"),
        F.count(F.when(c.isNull(), 1)).alias("null_content"),
        F.count(F.when(F.col("created_at").isNull(), 1)).alias("null_created_at"),
        F.count(F.when(F.length(c) == 0, 1)).alias("empty_content"),
    )
    dup = (obs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
              .agg(F.count(F.lit(1)).alias("ids"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")))
    d = dup.select(F.struct("ids", "rows")).scalar()
    total = F.col("total_records")

    def ratio(x):
        return F.when(total > 0, x / total).otherwise(F.lit(0.0))

    return base.select(
        "total_records", "content_bytes", "content_chars",
        F.when(total > 0, F.col("content_bytes") / total).otherwise(F.lit(0.0)).alias("avg_bytes_per_record"),
        "null_content", ratio(F.col("null_content")).alias("null_content_ratio"),
        "null_created_at", ratio(F.col("null_created_at")).alias("null_created_at_ratio"),
        "empty_content",
        (F.lit(1.0) - ratio(F.col("null_content") + F.col("empty_content"))).alias("completeness"),
        d["ids"].alias("duplicate_ids"), d["rows"].alias("rows_with_duplicate_id"),
    )
