"""Semantic search over given vectors: exact cosine top-k, in blocks.

Vectors are packed into chunks of ``CHUNK`` rows and queries into blocks of ``BLOCK``; a chunk
and a block meet in one task, where one matrix product scores their pairs and keeps the k
best of each query.  Those partial lists merge by a ranked window, which Spark cuts to k
rows a query before it shuffles them.  Neither side is broadcast or collected: the
blocks are copied to as many parts as there are chunks, so memory is one chunk and one
block a task, and the work is the queries times the rows, which an exact search has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.ordering import dense_index
from ..session import cut_lineage

CHUNK = 2048
BLOCK = 512


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector as doubles) of rows whose vector has a finite, non-zero length."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    length = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x * x)
    good = (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x))
    return rows.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & good).where(
        (length > 0) & (length < F.lit(float("inf"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision, summed in component order."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda acc, v: acc + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _packed(rows: DataFrame, size: int, prefix: str) -> DataFrame:
    """Rows (id, vector) of one dimension packed ``size`` at a time: dim, number, ids, values."""
    numbered = dense_index(rows.withColumn("dim", F.size("vector")), [F.col("dim"), F.col("id"), F.col("vector")], "at")
    numbered = numbered.withColumn("number", F.floor(F.col("at") / size))
    lists = numbered.groupBy("dim", "number").agg(F.collect_list(F.struct("id", "vector")).alias("rows"))
    return cut_lineage(lists.select(F.col("dim"), F.col("number").alias(f"{prefix}_number"), F.col("rows")["id"].alias(f"{prefix}_ids"),
                                    F.flatten(F.col("rows")["vector"]).alias(f"{prefix}_values")))


def _scored(k: int, same: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, queries = (np.asarray(batch.column(f"{p}_ids")[row].values) for p in "vq")
                x, q = (np.asarray(batch.column(f"{p}_values")[row].values).reshape(len(i), -1) for p, i in (("v", ids), ("q", queries)))
                x, q = (m / np.sqrt((m * m).sum(axis=1, keepdims=True)) for m in (x, q))
                scores = q @ x.T
                if same:
                    scores[queries[:, None] == ids[None, :]] = -np.inf
                # all that the k-th best score may tie with, up to rounding, stays
                n = min(k, len(ids))
                least = np.partition(scores, len(ids) - n, axis=1)[:, len(ids) - n]
                at, which = np.nonzero((scores >= least[:, None] - 1e-9) & (scores > -np.inf))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(queries[at]), pa.array(ids[which]), pa.array(scores[at, which])], ["query_id", "id", "score"])
    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id",
            vector_col: str = "embedding", skip_same_id: bool = True) -> DataFrame:
    """query_id, rank (from 1), id, score: the ``k`` rows of ``vectors`` with the highest cosine
    similarity to each row of ``queries`` (all, if fewer), ties to the smaller id.  Vectors
    that are null, empty, zero or hold a null or non-finite value take no part, and vectors
    of different lengths do not meet; with ``skip_same_id`` a query does not find its own id.
    Ids name rows: repeated ids on either side should be told apart by the caller."""
    v, q = _usable(vectors, id_col, vector_col), _usable(queries, id_col, vector_col)
    # of equal vectors only the k + 1 smallest ids can be in an answer, so that copies that
    # fill a large part of the table are cut where they lie
    copies = Window.partitionBy("vector").orderBy("id")
    v = v.withColumn("_copy", F.row_number().over(copies)).where(F.col("_copy") <= k + 1).drop("_copy")
    chunks, blocks = _packed(v, CHUNK, "v"), _packed(q, BLOCK, "q")
    pairs = chunks.select("dim", "v_number").join(blocks.select("dim", "q_number"), "dim")  # numbers only
    # blocks move to the chunks, once per chunk; the chunks move once
    dealt = pairs.join(blocks, ["dim", "q_number"]).join(chunks, ["dim", "v_number"])
    found = cut_lineage(dealt.select("v_ids", "v_values", "q_ids", "q_values")
                        .mapInArrow(_scored(k, skip_same_id), "query_id long, id long, score double"))
    # the product's rounding depends on the blocks: near ties are ranked by sums in component order
    near = Window.partitionBy("query_id").orderBy(F.col("score").desc())
    kth = found.withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= k) \
        .groupBy("query_id").agg(F.min("score").alias("_least"))
    left = found.join(kth, "query_id").where(F.col("score") >= F.col("_least") - 1e-9).select("query_id", "id")
    left = left.join(v.select("id", F.col("vector").alias("_v")), "id").join(q.select(F.col("id").alias("query_id"), F.col("vector").alias("_q")), "query_id")
    exact = left.select("query_id", "id", cosine(F.col("_q"), F.col("_v")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
