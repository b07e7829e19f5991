"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubjay.session import scratch_path, ship_package

ARROW_ROWS = 1000


def prepare(spark: SparkSession) -> None:
    """Session settings the operators rely on: the package on every executor, UTC and
    Arrow batches small enough that a batch of long texts stays in tens of megabytes."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    ship_package(spark)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut and a lost
    executor costs a re-read, not a recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return table(spark, sf_dir, "documents")


def held_out(doc_id) -> F.Column:
    """True for the fold that is never learned from: crc32(doc_id as text) mod 4 = 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet (names clash without regard to case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = "_" + name
    return name
