import hashlib
import random
import re

from scrubjay.llm import substring_dedup as D
from scrubjay.llm.common import prepare


def brute(rows, window):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in split:
        if d is not None:
            for i in range(len(w) - window + 1):
                key = tuple(w[i:i + window])
                first[key] = min(first.get(key, d), d)
    out = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i:i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((-1 if d is None else d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def fixture(seed, shared=6, docs=60):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "É", "日本"]) + str(rng.randrange(3000))
    passages = [[word() for _ in range(rng.randrange(20, 160))] for _ in range(shared)]
    passages.append(["x", "y"] * 80)
    rows = []
    for i in range(docs):
        t = []
        for _ in range(rng.randrange(4)):
            t += [word() for _ in range(rng.randrange(30))]
            p = rng.choice(passages)
            a, b = sorted((rng.randrange(len(p)), rng.randrange(len(p) + 1)))
            t += p[a:b] if rng.random() < 0.5 else p
        rows.append((rng.randrange(10**6), rng.choice([" ", "  ", "\n", " \t"]).join(t)))
    rows += [(rng.randrange(10**6), rows[rng.randrange(docs)][1]) for _ in range(12)]
    rows += [(10**7, ""), (10**7 + 1, None), (10**7 + 2, " \n "), (None, rows[0][1]), (rows[3][0], rows[3][1]), (rows[3][0], rows[5][1])]
    return rows


def check(spark, rows, window):
    docs = spark.createDataFrame([(d, t, "z", 0) for d, t in rows], "doc_id long, text string, version string, fp int").repartition(3)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in D.removal_digests(docs, window).collect())
    assert got == brute(rows, window)


def test_against_brute_force(spark):
    prepare(spark)
    check(spark, fixture(1), 50)


def test_small_shards(spark, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(D, "SHARD", 2)
    check(spark, fixture(2, 2), 20)


def test_automaton():
    rng = random.Random(1)
    for _ in range(200):
        seqs = [[rng.randrange(3) for _ in range(rng.randrange(1, 14))] for _ in range(3)]
        a = D.SuffixAutomaton()
        for s in seqs:
            a.add(s)
        q = [rng.randrange(3) for _ in range(15)]
        for k in (1, 2, 4):
            has = {tuple(s[i:i + k]) for s in seqs for i in range(len(s) - k + 1)}
            assert a.matched(q, k) == [i for i in range(len(q) - k + 1) if tuple(q[i:i + k]) in has]


def test_empty_table_and_text(spark):
    prepare(spark)
    assert D.removal_digests(spark.createDataFrame([], "doc_id long, text string"), 50).collect() == []
    docs = spark.createDataFrame([(2, "a b c d e f g h i j"), (1, "x b c d e f g h i j k")], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.text) for r in D.remove_repeats(docs, 9).collect()}
    assert got == {1: (0, "x b c d e f g h i j k"), 2: (9, "a")}
