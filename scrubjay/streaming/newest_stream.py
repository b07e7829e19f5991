"""Keep-latest on a stream: the newest record of each normalized text, with corrections.

State holds one row per text: the best record so far by the batch rule (newest time first,
then the higher id).  When a later arrival beats it, the new survivor is emitted together
with the id that it replaces, so a sink that upserts by text, or drops replaced ids, ends up
with the survivors of batch ``keep_latest``.  A text's state goes when the watermark passes
its newest event time by ``expire``; a copy that comes after that starts afresh.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import normalize_text
from ..operators.dedup import norm_key

SURVIVORS = "norm_key binary, id long, event_time timestamp, replaced_id long"


def _advance(expire_ms: int):
    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else None
        best = held
        for rows in batches:
            newest = rows[rows["event_us"] == rows["event_us"].max()]
            rival = int(newest["event_us"].iloc[0]), int(newest["id"].max())
            best = rival if best is None or rival > best else best
        state.update(best)
        # an event time at or before the watermark cannot set a timer
        state.setTimeoutTimestamp(max(best[0] // 1000 + expire_ms, state.getCurrentWatermarkMs() + 1))
        if best != held:
            yield pd.DataFrame({"norm_key": [key[0]], "id": [best[1]], "event_time": [pd.Timestamp(best[0], unit="us")],
                                "replaced_id": pd.array([None if held is None or held[1] == best[1] else held[1]], dtype="Int64")})
    return run


def keep_newest(stream: DataFrame, delay: str = "1 day", expire_hours: int = 24, content_col: str = "content") -> DataFrame:
    """``stream``: observations with ``id`` and ``created_at``; returns (norm_key, id,
    event_time, replaced_id): a row whenever a text has a new survivor, and whom it replaces
    (null for the first).  Rows without content are all survivors (their key is their id, as
    in :func:`.dedup_stream.prevent_duplicates`); rows without a time or id are left out.
    Repeats of one record change nothing.  One text's arrivals of a batch meet in one task, as
    slim rows without their text; memory is one row per live text."""
    own = F.concat(F.lit("id:").cast("binary"), F.col("id").cast("string").cast("binary"), F.lit(" " * 16).cast("binary"))
    rows = stream.where(F.col("created_at").isNotNull() & F.col("id").isNotNull()).select(
        F.col("id").cast("long").alias("id"), F.col("created_at").cast("timestamp").alias("event_time"),
        F.coalesce(norm_key(normalize_text(F.col(content_col))), own).alias("norm_key"))
    rows = rows.withWatermark("event_time", delay).withColumn("event_us", F.unix_micros("event_time"))
    return rows.groupBy("norm_key").applyInPandasWithState(
        _advance(expire_hours * 3_600_000), SURVIVORS, "event_us long, id long", "append", GroupStateTimeout.EventTimeTimeout)
