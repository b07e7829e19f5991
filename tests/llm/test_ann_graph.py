import numpy as np
from conftest import SF01

from scrubjay.llm import ann_graph as A, queries
from scrubjay.llm.common import prepare


def brute(rows, ask, k=10):
    out = {}
    for q, v in rows.items():
        if ask(q):
            near = sorted((float(np.sqrt(((np.array(w) - np.array(v)) ** 2).sum())), i) for i, w in rows.items() if i != q and len(w) == len(v))
            out[q] = near[:k]
    return out


def recall(got, want):
    """By distance, so that ties count."""
    hit = total = 0
    for q, near in want.items():
        limit = near[-1][0] if near else 0
        hit += sum(s <= limit * (1 + 1e-9) for _, _, s in got.get(q, []))
        total += len(near)
    return hit / max(total, 1)


def collect(df, name):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r[name], r.score))
    return out


def test_query_recall(spark):
    got = collect(queries.op1_ann_graph(spark, SF01), "vec_id")
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF01}/embeddings.parquet").collect()}
    want = brute(rows, lambda i: i % 100 == 0)
    assert got.keys() == want.keys() and all([r for r, _, _ in v] == list(range(1, 11)) for v in got.values())
    assert recall(got, want) >= 0.95
    for q, near in got.items():
        for _, i, s in near:
            assert abs(s - np.linalg.norm(np.array(rows[q]) - np.array(rows[i]))) < 1e-9


def test_shards_copies_and_odd_rows(spark):
    prepare(spark)
    rng = np.random.default_rng(2)
    rows = {i: rng.normal(size=8).round(1).tolist() for i in range(900)}
    for i in range(300, 700):
        rows[i] = rows[3]
    rows |= {1000: [1.0, 2.0], 1001: [1.5, 2.0], 1002: [1e30] * 8, 1003: [-0.0, 1.0], 1004: [0.0, 1.0]}
    odd = [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [1.0] * 7 + [None]), (2004, [1.0] * 7 + [float("nan")]),
           (2005, [float("inf")] * 8), (None, [1.0] * 8), (5, rows[5])]
    df = spark.createDataFrame([(i, v, 7) for i, v in [*rows.items(), *odd]], "vec_id long, embedding array<double>, shard int")
    got = collect(A.nearest(df, lambda i: i % 10 == 0, shard_rows=120), "id")
    want = brute(rows, lambda i: i % 10 == 0)
    assert got.keys() == want.keys()
    assert [i for _, i, _ in got[1000]] == [1001, 1003, 1004]
    assert recall(got, want) >= 0.95
    assert [i for _, i, _ in got[300]] == [3, *range(301, 310)]


def test_empty(spark):
    prepare(spark)
    assert A.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), lambda i: i % 100 == 0).collect() == []


def test_prune_keeps_diverse_edges():
    x = np.array([[0, 0], [1, 0], [1.1, 0], [0, 2]], np.float32)
    out = A.robust_prune(x, np.array([[1, 2, 3]]), np.array([[1, 1.21, 4]]), 3)
    assert out[0].tolist() == [1, 3, -1]
