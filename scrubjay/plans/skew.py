"""Joins of rows to one row per class, where a class may hold a third of the rows.

When one join side is an aggregate on the join key, both sides arrive partitioned by
that key and a hot key stays in one task.  Classes of at least a thousandth of the rows
number a thousand at most, so they are broadcast (a proven bound) and their rows are
not shuffled at all; the rest joins by shuffle.  Every row is in exactly one part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SHARE = 1000


def join_classes(rows: DataFrame, classes: DataFrame, key: str, size: str, total, null_safe: bool = False) -> DataFrame:
    """Inner join of ``rows`` with ``classes`` (one row per ``key``, ``size`` rows each) on
    ``key``; ``total`` is the number of rows the sizes were counted over.  The result
    has the columns of ``rows`` and those of ``classes`` but the key, once."""
    hot = F.col(size) * SHARE >= F.lit(total)
    own = "_class_" + key
    table = classes.withColumnRenamed(key, own)
    match = F.col(key).eqNullSafe(F.col(own)) if null_safe else F.col(key) == F.col(own)
    large = F.broadcast(table.filter(hot))
    small = table.filter(~hot)
    direct = rows.join(large, match).drop(own)
    rest = rows.join(F.broadcast(table.filter(hot).select(own)), match, "left_anti").join(small, match).drop(own)
    return direct.unionByName(rest)


def mark_classes(rows: DataFrame, classes: DataFrame, key: str, size: str, total, flag: str) -> DataFrame:
    """``rows`` with a boolean ``flag``: whether ``key`` (text) is one of ``classes``.  Hot
    classes are broadcast; rows they settle, and rows without a key, are dealt by their
    id in the second join, so that neither a hot class nor NULL gathers in one task."""
    hot = F.col(size) * SHARE >= F.lit(total)
    large = F.broadcast(classes.filter(hot).select(F.col(key).alias("_hot"), F.lit(True).alias("_is_hot")))
    small = classes.filter(~hot).select(F.col(key).alias("_cold"), F.lit(True).alias("_is_cold"))
    first = rows.join(large, F.col(key) == F.col("_hot"), "left")
    dealt = first.withColumn("_deal", F.coalesce(F.when(F.col("_is_hot").isNull(), F.col(key)),
                                                 F.concat(F.lit("#"), F.coalesce(F.col("id").cast("string"), F.lit("")))))
    out = dealt.join(small, F.col("_deal") == F.col("_cold"), "left")
    return out.withColumn(flag, F.coalesce("_is_hot", "_is_cold", F.lit(False))).drop("_hot", "_is_hot", "_cold", "_is_cold", "_deal")
