"""Real-time duplicate prevention on an observation stream.

Rows whose normalized text was already seen within the watermark delay are dropped as
they arrive; state is keyed by the 16-byte text key and expires with the watermark, so
it stays bounded by the delay, not by the stream.  Note the policy: a stream keeps the
*first* arrival, whereas batch keep_latest keeps the newest record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import normalize_text
from ..operators.dedup import norm_key


def prevent_duplicates(stream: DataFrame, delay: str = "1 day", content_col: str = "content") -> DataFrame:
    """``stream``: observations with ``created_at``; returns the stream without repeats.
    Rows without content are never repeats of each other (as in batch): their key is
    their id, behind a byte that no text key of 16 bytes has room for."""
    own = F.concat(F.lit("id:").cast("binary"), F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"), F.lit(" " * 16).cast("binary"))
    keyed = (stream.withColumn("event_time", F.col("created_at").cast("timestamp"))
                   .withColumn("norm_key", F.coalesce(norm_key(normalize_text(F.col(content_col))), own)))
    return (keyed.withWatermark("event_time", delay)
                 .dropDuplicatesWithinWatermark(["norm_key"])
                 .drop("norm_key"))
