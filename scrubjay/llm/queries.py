"""Registered queries of the training-data operators (contract columns only)."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrubjay.llm import alignment, ann_graph, chat_format, decontaminate, fingerprint, language_id, mixing, ngram_join, periodic_runs, pii, substring_dedup, token_files, toxicity
from scrubjay.llm.common import documents, held_out, prepare, scratch, table, written

#: Folder of the vocabulary files, as the installed package names it.
TOKENIZERS = os.path.dirname(public_tokenizers.path("byte_bpe_50k.json"))


def op1_ann_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest neighbours of every hundredth vector, by sharded graph search."""
    prepare(spark)
    found = ann_graph.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets have a Jaccard of 0.8 or more."""
    return ngram_join.link_components(documents(spark, sf_dir))[0].select("doc_id", "n_shingles", "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated toxicity score of every document."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations formatted, written, and read back as digests; conversation -7 holds
    the template's own control strings."""
    prepare(spark)
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.conversation_digests(written(chat_format.format_turns(turns.unionByName(probe)), "chat"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed sequence: every document as often and where the mix holds it."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return mixing.mix(docs, details=True).select("doc_id", "source", "tokens", "epoch", "position", "block", "place_in_block")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base spans, and all spans with those the trees add."""
    marked = pii.find(documents(spark, sf_dir))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {i})) as long)").alias(f"n_{k}") for i, k in enumerate(pii.KINDS)]
    return marked.select("doc_id", *counts, F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"),
                         pii.spans_text(F.col("spans")).alias("spans"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, also with other numbers, names or units."""
    return decontaminate.report(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by cross-entropy under Kneser-Ney character models."""
    docs = documents(spark, sf_dir)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return language_id.identify(texts, language_id.fit(docs)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"), F.col("language.rejected").alias("rejected"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words under 50-word windows that start in a smaller document are removed."""
    return substring_dedup.removal_digests(documents(spark, sf_dir), 50)


def op10_token_files(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Every text encoded, written in directly addressable codes, read back."""
    path = scratch(spark, "token-files")
    token_files.write_token_files(documents(spark, sf_dir), f"{tokenizers}/byte_bpe_50k.json", path)
    return token_files.token_digests(spark, path)


def op11_alignment(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    """Groups and links between two tokenizations of every text."""
    return alignment.link_strengths(documents(spark, sf_dir), f"{tokenizers}/byte_bpe_50k.json", f"{tokenizers}/piece_bpe_32k.model")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words of every text, by block convolution."""
    return periodic_runs.run_digests(documents(spark, sf_dir))


def op13_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-permutation MinHash of every text, of its edited text, and their likeness."""
    compared = fingerprint.compare_with_edits(documents(spark, sf_dir))
    texts = [fingerprint.fingerprint_text(F.col(c)).alias(c) for c in ("fingerprint", "edited_fingerprint")]
    return compared.select("doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), *texts, "near_edited", "near_next")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline over ``documents``."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_ann_graph": op1_ann_graph,
    "op2_ngram_join": op2_ngram_join,
    "op3_toxicity": op3_toxicity,
    "op4_chat_format": op4_chat_format,
    "op5_mixing": op5_mixing,
    "op6_pii": op6_pii,
    "op7_decontaminate": op7_decontaminate,
    "op8_language_id": op8_language_id,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_token_files": op10_token_files,
    "op11_alignment": op11_alignment,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_fingerprint": op13_fingerprint,
}
ORACLE: dict[str, str] = {}
