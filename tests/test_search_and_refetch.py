import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrubjay.operators import checkpoints as C
from scrubjay.operators import pattern_scan as P
from scrubjay.operators import search as S


def test_plain_run():
    assert P.plain_run("%abc%de_f%") == "abc" and P.plain_run(r"%a\%b_c") == "a%b" and P.plain_run("%_%") == ""


def _groups(spark, samples):
    return spark.createDataFrame([(f"s{i}", (i, i), t) for i, t in enumerate(samples)],
                                 "signature string, first_sk struct<t:long,i:long>, sample_content string")


@pytest.mark.parametrize("limit", [P.PATTERNS, 4])
def test_refetch_equals_like_for_every_pair(spark, monkeypatch, limit):
    """With one pass for all patterns, and with passes for those without words and a join
    for the others."""
    monkeypatch.setattr(P, "PATTERNS", limit)
    rnd = random.Random(3)
    words = ["alpha", "beta", "a_b", "100%", "gamma", "x", "é", "back\\d", "\\%", ""]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 9))) for _ in range(150)] + [None, "", "alpha beta gamma x"] + ["alpha beta gamma"] * 40
    samples = [rnd.choice([t for t in texts if t]) for _ in range(12)] + ["alpha beta gamma", "beta", "%", "_", "%%alphabeta"]
    ann = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, content string").withColumn("created_at", F.lit(None).cast("timestamp_ntz"))
    g = _groups(spark, samples)
    got = sorted((r.signature, r.id) for r in C.refetch_prefix(ann.repartition(3), g).select("signature", "id").collect())
    pattern = C._pg_like_pattern(F.substring("sample_content", 1, 50))
    every = ann.crossJoin(g.withColumn("pattern", pattern)).where(F.expr("content LIKE pattern"))
    assert got == sorted((r.signature, r.id) for r in every.select("signature", "id").collect())
    plan = C.refetch_prefix(ann, g)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def _brute(rows, queries, k):
    good = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for qid, q in ((i, v) for i, v in good if i in queries):
        scored = [(float(q @ v / np.sqrt(q @ q) / np.sqrt(v @ v)), i) for i, v in good if i != qid and len(v) == len(q)]
        scored.sort(key=lambda s: (-round(s[0], 9), s[1]))
        out += [(qid, r + 1, i, round(s, 6)) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("chunk,block", [(2048, 512), (7, 3)])
def test_search_equals_brute_force(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(S, "CHUNK", chunk)
    monkeypatch.setattr(S, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).round(3).tolist()) for i in range(60)]
    rows += [(100 + i, rows[i % 4][1]) for i in range(15)]  # copies: ties
    rows += [(200, None), (201, []), (202, [0.0] * 6), (203, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (204, [float("nan")] * 6),
             (205, [float("inf")] + [1.0] * 5), (300, [1.0, 2.0]), (301, [2.0, 1.0]), (320, [5.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, id string").repartition(3)
    df = df.withColumn("embedding", F.col("embedding").cast("array<double>"))
    rows = [(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    queries = {i for i, _ in rows if i % 20 == 0}
    got = S.nearest(df, df.where("vec_id % 20 = 0"), 5).collect()
    assert sorted((r.query_id, r.rank, r.id, round(r.score, 6)) for r in got) == _brute(rows, queries, 5)
    assert S.nearest(df.limit(0), df, 5).collect() == []
