"""Scan order and dense numbering.

The reference walks rows ``ORDER BY created_at DESC``.  We make that a total order,
``(created_at DESC NULLS LAST, id DESC)``, encoded as one orderable struct ``sk`` whose
ascending order *is* the scan order, so "earlier in the scan" is a plain comparison and
"first in the scan" is ``min(sk)``, usable in partial aggregates.

Dense 0-based numbering in a global order (group ids, ranks in a group) is done
without a single-partition window: a range-partitioned sort, a per-partition row count
(one row per partition), a running sum over those counts, and a broadcast join of the
offsets back.  The broadcast side has exactly one row per partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage

LONG_MAX = 9223372036854775807


def scan_key(created_at: str = "created_at", id_col: str = "id") -> Column:
    """Struct whose ascending order equals ``created_at DESC NULLS LAST, id DESC``."""
    micros = F.unix_micros(F.col(created_at).cast("timestamp"))
    return F.struct(
        F.coalesce(-micros, F.lit(LONG_MAX)).alias("t"),
        (-F.col(id_col)).alias("i"),
    )


def dense_index(df: DataFrame, order_cols: list, name: str = "idx") -> DataFrame:
    """Append a dense 0-based ``name`` following ``order_cols`` (must be a total order)."""
    tagged = (df.orderBy(*order_cols)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    # written once so both uses below see the same partition layout
    tagged = cut_lineage(tagged)
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    out = tagged.join(F.broadcast(offsets), "_pid")
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33)
    return out.withColumn(name, F.col("_off") + local).drop("_pid", "_mid", "_off")
