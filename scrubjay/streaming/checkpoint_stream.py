"""Checkpoint counts on arrival: per event-time window and signature, how many
machine-generated rows came in, first and last time.  Append mode with a watermark,
so each window is emitted once it can no longer change and its state is dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import CHECKPOINT_PATTERNS, checkpoint_signature, is_checkpoint


def checkpoint_counts(stream: DataFrame, window: str = "1 day", delay: str = "1 hour",
                      patterns=None, content_col: str = "content") -> DataFrame:
    c = F.col(content_col)
    flagged = (stream.filter(is_checkpoint(c, patterns or CHECKPOINT_PATTERNS))
                     .withColumn("signature", checkpoint_signature(c))
                     .withColumn("event_time", F.col("created_at").cast("timestamp")))
    return (flagged.withWatermark("event_time", delay)
                   .groupBy(F.window("event_time", window).alias("window"), "signature")
                   .agg(F.count(F.lit(1)).alias("count"),
                        F.min("event_time").alias("first_occurrence"),
                        F.max("event_time").alias("last_occurrence")))
