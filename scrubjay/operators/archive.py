"""Time-based archiving with a verifiable manifest, and restoration.

Rows created before ``as_of - days`` move to an archive written as gzip Parquet
partitioned by month; the live table keeps each archived row with a short stub text
(``[ARCHIVED yyyy-MM]``, which the monitor counts as processed).  The manifest holds
the row count, text bytes and an order-insensitive checksum (sum of a 64-bit row hash),
so an archive can be verified without trusting file listings; restore joins the
archive back by id.  All steps are scans, one join on id and aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .metrics import _ts

# Archive stub prefix and month partition format.
ARCHIVE_PREFIX = "[ARCHIVED "
MONTH_FORMAT = "yyyy-MM"


def is_stub(c) -> F.Column:
    """Whether a text is the stub of an archived row, markers after it or not (false for NULL)."""
    return F.coalesce(c.rlike(r"^\[ARCHIVED [0-9]{4,}-[0-9]{2}\]"), F.lit(False))


def is_cold(as_of, days: int = 30, content_col: str = "content") -> F.Column:
    """Old enough to be archived and not archived yet: a stub holds no text to keep."""
    old = F.col("created_at") < (_ts(as_of) - F.expr(f"INTERVAL {int(days)} DAYS"))
    return old & ~is_stub(F.col(content_col))


def cold_rows(obs: DataFrame, as_of, days: int = 30, content_col: str = "content") -> DataFrame:
    return obs.filter(is_cold(as_of, days, content_col)).withColumn("month", F.date_format("created_at", MONTH_FORMAT))


def stubbed(obs: DataFrame, as_of, days: int = 30, content_col: str = "content") -> DataFrame:
    """The live table after archiving: same rows, archived texts replaced by a stub."""
    stub = F.concat(F.lit(ARCHIVE_PREFIX), F.date_format("created_at", MONTH_FORMAT), F.lit("]"))
    return obs.withColumn(content_col, F.when(is_cold(as_of, days, content_col), stub).otherwise(F.col(content_col)))


def manifest(df: DataFrame, content_col: str = "content") -> DataFrame:
    h = F.xxhash64(F.col("id"), F.col(content_col), F.col("created_at"))
    return df.agg(F.count(F.lit(1)).alias("rows"),
                  F.coalesce(F.sum(F.octet_length(F.col(content_col))), F.lit(0)).alias("content_bytes"),
                  F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).alias("checksum"),
                  F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))


class ArchiveDamaged(RuntimeError):
    """Archived rows do not match their manifest."""


def month_manifest(cold: DataFrame, content_col: str = "content") -> DataFrame:
    """The manifest of each month of :func:`cold_rows`."""
    h = F.xxhash64(F.col("id"), F.col(content_col), F.col("created_at"))
    return cold.groupBy("month").agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length(F.col(content_col))), F.lit(0)).alias("content_bytes"),
        F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).alias("checksum"),
        F.min("created_at").alias("oldest"), F.max("created_at").alias("newest"))


def _total(months: DataFrame) -> DataFrame:
    """The whole archive's manifest: sums and bounds of its months'."""
    return months.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast(t).alias(c) for c, t in (("rows", "long"), ("content_bytes", "long"), ("checksum", "decimal(38,0)"))],
                      F.min("oldest").alias("oldest"), F.max("newest").alias("newest"))


def write_archive(obs: DataFrame, path: str, as_of, days: int = 30) -> DataFrame:
    """Write the cold rows (gzip, by month) and their manifest; returns the manifest."""
    cold = cold_rows(obs, as_of, days)
    cold.write.mode("errorifexists").partitionBy("month").option("compression", "gzip").parquet(f"{path}/rows")
    # two levels: a row per month (dealt by month, combined before the shuffle), and their sum
    month_manifest(cold).coalesce(1).write.mode("errorifexists").parquet(f"{path}/months")
    _total(obs.sparkSession.read.parquet(f"{path}/months")).coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest")
    return obs.sparkSession.read.parquet(f"{path}/manifest")


def _archived(spark, path: str, months: list[str] | None) -> DataFrame:
    rows = spark.read.option("recursiveFileLookup", "false").parquet(f"{path}/rows").withColumn("month", F.col("month").cast("string"))
    return rows if months is None else rows.where(F.col("month").isin(months))


def verify_months(spark, path: str, months: list[str] | None = None) -> DataFrame:
    """A row per month of an archive folder: does it still match its manifest?  With
    ``months`` only those partitions are read.  Months without rows, and rows of months
    that the manifest does not know, are not intact.  The manifest itself is checked first:
    its months must sum up to the total, or :class:`ArchiveDamaged` is raised."""
    stored, total = spark.read.parquet(f"{path}/months"), spark.read.parquet(f"{path}/manifest")
    said, summed = total.first(), _total(stored).first()
    if said is None or any(said[c] != summed[c] for c in ("rows", "content_bytes", "checksum")):
        raise ArchiveDamaged(f"the month manifests of {path} do not sum up to the total")
    if months is not None:
        stored = stored.where(F.col("month").isin(months))
        stored = spark.createDataFrame([(m,) for m in sorted(set(months))], "month string").join(stored, "month", "left")
    now = month_manifest(_archived(spark, path, months))
    now = now.select("month", *[F.col(c).alias(f"now_{c}") for c in ("rows", "content_bytes", "checksum")])
    same = [F.col(f"now_{c}") == F.col(c) for c in ("rows", "content_bytes", "checksum")]
    return stored.join(now, "month", "full").select(
        "month", "rows", "now_rows", F.coalesce(same[0] & same[1] & same[2], F.lit(False)).alias("intact"))


def restore_months(live: DataFrame, path: str, months: list[str] | None = None, content_col: str = "content") -> DataFrame:
    """``live`` with the archived texts of ``months`` (all, without) put back.  The months are
    verified before; damaged ones are named in an :class:`ArchiveDamaged`.  Only their
    partitions are read."""
    spark = live.sparkSession
    bad = [r.month for r in verify_months(spark, path, months).where("not intact").orderBy("month").collect()]
    if bad:
        raise ArchiveDamaged(f"archive {path} does not match its manifest in {', '.join(map(str, bad))}")
    return restore(live, _archived(spark, path, months).drop("month"), content_col)


def verify(archive_rows: DataFrame, stored_manifest: DataFrame) -> DataFrame:
    """One row: does the archive still match its manifest?"""
    now = manifest(archive_rows.drop("month"))
    a = now.select(*[F.col(c).alias(f"now_{c}") for c in now.columns])
    ok = (F.col("now_rows") == F.col("rows")) & (F.col("now_checksum") == F.col("checksum")) & \
         (F.col("now_content_bytes") == F.col("content_bytes"))
    return stored_manifest.join(a, how="inner").select("rows", "now_rows", "checksum", "now_checksum", ok.alias("intact"))


def restore(live: DataFrame, archive_rows: DataFrame, content_col: str = "content") -> DataFrame:
    """Put archived texts back (join on id); rows not in the archive are unchanged."""
    back = archive_rows.select("id", F.col(content_col).alias("_archived"), F.lit(True).alias("_matched"))
    out = live.join(back, "id", "left")
    # the flag, not the text, tells an archived row: its text may have been NULL
    text = F.when(F.col("_matched"), F.col("_archived")).otherwise(F.col(content_col))
    return out.withColumn(content_col, text).select(*live.columns)
