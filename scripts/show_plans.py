"""Print the formatted physical plans of the headline queries (sf0.1 by default)."""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    from pyspark.sql import functions as F

    from scrubjay.config import DedupConfig
    from scrubjay.operators import checkpoints as C
    from scrubjay.operators import dedup as D
    from scrubjay.operators import metrics as M
    from scrubjay.operators import search as SE
    from scrubjay.plans import candidates as CA
    from scrubjay.plans.edit_join import edit_candidates
    from scrubjay.session import get_spark
    from scrubjay.sources.observations import obs_checkpoints, obs_documents

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_spark("local[8]", shuffle_partitions=16)
    spark.sparkContext.setLogLevel("ERROR")
    docs = obs_documents(spark, sf)
    prep = D.prepare(docs)
    rows = prep.filter(F.col("content").isNotNull()).select(
        "id", "created_at", "sk", "norm", D.norm_key(F.col("norm")).alias("key"))
    shown = {
        "exact dedup: class aggregate (the default dedup)": prep.filter(F.col("content").isNotNull())
            .groupBy(D.norm_key(F.col("norm")).alias("key"))
            .agg(F.count(F.lit(1)).alias("n"), F.min(F.col("sk")["t"]).alias("tmin"))
            .filter(F.col("n") > 1),
        "checkpoint groups": C.checkpoint_groups(C.annotate(obs_checkpoints(spark, sf))),
        "monitor snapshot": M.snapshot(obs_checkpoints(spark, sf), "2024-01-31 00:00:00"),
        "similarity join: shared rare words, counted (t=0.60)":
            CA.candidate_pairs(CA.texts_of(rows), DedupConfig(similarity_threshold=0.6)),
        "similarity join: segments within 13 % of edits (t=0.50)": edit_candidates(CA.representatives(rows).select("v", "norm", "nc"), 0.13),
        "semantic search: merge of the partial lists": SE.nearest(spark.read.parquet(f"{sf}/embeddings.parquet"),
                                                                  spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 20 = 0")),
    }
    for title, df in shown.items():
        print(f"## {title}\n\n```")
        df.explain("formatted")
        print("```\n")


if __name__ == "__main__":
    main()
