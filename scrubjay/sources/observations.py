"""Observation tables: the canonical schema, a generic adapter, and the adapters over
the test tables.

Any table with an id, a text column and a timestamp becomes an observation table
through :func:`as_observations`; table and column names are arguments, never global
state.  Parquet scans prune columns and push filters down on their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

OBSERVATION_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("content", T.StringType(), True),
    T.StructField("created_at", T.TimestampNTZType(), True),
    T.StructField("entity_name", T.StringType(), True),
    T.StructField("updated_at", T.TimestampNTZType(), True),
])
OBSERVATION_COLUMNS = [f.name for f in OBSERVATION_SCHEMA.fields]

# The epoch the test adapters count minutes from.
ADAPTER_EPOCH = "2024-01-01 00:00:00"


def as_observations(df: DataFrame, id_col: str = "id", content_col: str = "content",
                    created_at_col: str = "created_at", entity_col: str | None = "entity_name",
                    updated_at_col: str | None = None) -> DataFrame:
    """Rename/cast an arbitrary table to the observation schema."""
    cols = set(df.columns)
    return df.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(content_col).cast("string").alias("content"),
        F.col(created_at_col).cast("timestamp_ntz").alias("created_at"),
        (F.col(entity_col).cast("string") if entity_col and entity_col in cols
         else F.lit(None).cast("string")).alias("entity_name"),
        (F.col(updated_at_col).cast("timestamp_ntz") if updated_at_col and updated_at_col in cols
         else F.lit(None).cast("timestamp_ntz")).alias("updated_at"),
    )


def validate_observations(df: DataFrame) -> DataFrame:
    missing = [c for c in ("id", "content", "created_at") if c not in df.columns]
    if missing:
        raise ValueError(f"not an observation table, missing columns {missing}")
    for c in OBSERVATION_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(OBSERVATION_SCHEMA[c].dataType))
    return df


def filter_entity(obs: DataFrame, entity: str | None) -> DataFrame:
    """``WHERE entity_name = ?`` (pushed into the scan by Catalyst)."""
    return obs if entity is None else obs.filter(F.col("entity_name") == F.lit(entity))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _minutes_after_epoch(id_col) -> F.Column:
    return F.expr(f"timestampadd(MINUTE, {id_col}, TIMESTAMP_NTZ'{ADAPTER_EPOCH}')")


def obs_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("content"),
        _minutes_after_epoch("doc_id").alias("created_at"),
        F.col("source").alias("entity_name"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"),
    )


def obs_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations")
    oid = F.col("conv_id") * 100 + F.col("turn")
    return c.select(
        oid.alias("id"),
        F.col("text").alias("content"),
        _minutes_after_epoch("conv_id * 100 + turn").alias("created_at"),
        F.col("role").alias("entity_name"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"),
    )


def checkpoint_content_expr() -> F.Column:
    """Machine-generated texts derived from ``events`` (view/click/error become three
    checkpoint shapes; the rest stays ordinary text)."""
    ts = F.col("ts")
    return (F.when(F.col("event_type") == "view",
                   F.concat(F.lit("SYNC: "), F.date_format(ts, "yyyy-MM-dd HH:mm:ss")))
            .when(F.col("event_type") == "click",
                  F.concat(F.lit("Checkpoint "), F.col("event_id").cast("string"), F.lit(" completed")))
            .when(F.col("event_type") == "error",
                  F.concat(F.lit("CHECKPOINT "), F.date_format(ts, "EEE MMM dd HH:mm:ss"),
                           F.lit(" UTC "), F.date_format(ts, "yyyy"), F.lit(": auto-sync")))
            .otherwise(F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" "),
                                F.col("event_type"), F.lit(" "), F.col("props"))))


def obs_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("id"),
        checkpoint_content_expr().alias("content"),
        F.col("ts").cast("timestamp_ntz").alias("created_at"),
        F.col("event_type").alias("entity_name"),
        F.lit(None).cast("timestamp_ntz").alias("updated_at"),
    )
