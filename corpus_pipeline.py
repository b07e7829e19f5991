"""Corpus pipeline: toxicity, near duplicates, benchmark decontamination, mixing, token files.

``STAGES`` lists (name, function) in order.  Each function takes (spark, docs, sf_dir) and
returns a DataFrame; ``run`` writes it as Parquet under the shared checkpoint folder and
reads it back as the next stage's ``docs``.  All but the last return the columns of
``docs``.

Rows with a null doc_id pass the near-duplicate stage (nothing identifies them); rows that
repeat a doc_id leave it as one row, the one with the smallest text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scrubjay.llm import decontaminate, mixing, ngram_join, token_files, toxicity
from scrubjay.llm.common import free_name, prepare, scratch, table, written
from scrubjay.llm.queries import TOKENIZERS

TOXIC_SCORE = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity score stays below ``TOXIC_SCORE``."""
    prepare(spark)
    name = free_name(docs, "_toxicity")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), name)
    return scored.where(F.col(name) < TOXIC_SCORE).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: the one with the smallest doc_id."""
    prepare(spark)
    found, _ = ngram_join.link_components(docs)
    stay = written(found.where("doc_id = component_id").select(F.col("doc_id").alias("_stay_id")).distinct(), "pipeline-stay")
    first, key = free_name(docs, "_first"), docs["doc_id"].cast("long")
    named = docs.where("doc_id is not null").join(stay, key == stay["_stay_id"], "left_semi")
    order = Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_first())
    once = named.withColumn(first, F.row_number().over(order)).where(F.col(first) == 1).drop(first)
    return once.unionByName(docs.where("doc_id is null"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item, also with other numbers, names or units."""
    prepare(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the source mix holds them."""
    prepare(spark)
    return mixing.mix(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: doc_id, start, n_tokens, ids_crc32."""
    prepare(spark)
    path = scratch(spark, "pipeline-tokens")
    token_files.write_token_files(docs, f"{TOKENIZERS}/byte_bpe_50k.json", path)
    return token_files.token_digests(spark, path)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token_files", token_output),
]

#: Boosted trees, component closure and tokenization are beyond SQL; tests hold the stages
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
