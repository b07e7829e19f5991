import glob
import math
import os
import random
import re
from collections import defaultdict

import pyarrow.parquet as pq

from conftest import SF001
from scrubjay.llm import mixing as M
from scrubjay.llm.common import prepare


def solve(shares, target, limit, budget):
    """Plain bisection on the exponent."""
    def measures(t):
        w = [p ** t for p in shares]
        z = sum(w)
        w = [x / z for x in w]
        return -sum(x * math.log(x) for x in w if x), max(x * budget / p for x, p in zip(w, shares)), w
    lo, hi = 0.0, 1.0
    bad = lambda t: measures(t)[1] > max(limit, budget) + 1e-12 or (target is not None and measures(t)[0] > target * math.log(len(shares)))
    if not bad(0.0):
        return 0.0, measures(0.0)[2]
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if bad(mid) else (lo, mid)
    return hi, measures(hi)[2]


def corpus(seed=1, extra=True):
    rng = random.Random(seed)
    rows = []
    for s, n in (("a", 300), ("b", 60), ("c", 25), ("d", 8), (None, 20)):
        rows += [(len(rows) + i, " ".join("w" for _ in range(rng.randrange(1, 40))), s) for i in range(n)]
    return rows + ([(9000, None, "a"), (9001, "", "b"), (9002, " \n", "void"), (9000, None, "a")] if extra else [])


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 2) for r in rows], "doc_id long, text string, source string, tokens string, epoch int").repartition(3)


def test_exponent_and_realisation(spark, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(M, "RANGE_DOCS", 16)
    rows = corpus()
    tokens = defaultdict(int)
    for _, t, s in rows:
        tokens[s] += len(re.findall(r"\S+", t or ""))
    named = {s: n for s, n in tokens.items() if n}
    total = sum(named.values())
    for config in (M.MixConfig(), M.MixConfig(target_entropy=None, max_repeats=2.5), M.MixConfig(budget_share=0.4, target_entropy=0.9), M.MixConfig(budget_share=1.7)):
        t, w = solve([n / total for n in named.values()], config.target_entropy, config.max_repeats, config.budget_share)
        table, got = M.weights(frame(spark, rows), config)
        assert abs(got - t) < 1e-6
        per = {r.source_key: r for r in table.collect()}
        out = M.mix(frame(spark, rows), config, details=True).collect()
        own = defaultdict(list)
        for r in out:
            own[r.source].append(r)
        for (s, n), weight in zip(named.items(), w):
            key = "null" if s is None else f"s:{s}"
            budget = weight * config.budget_share * total
            assert abs(per[key].weight - weight) < 1e-6
            used = [r for r in own[s] if r.text and r.text.strip()]
            taken = sum(len(r.text.split()) for r in used)
            assert budget - 1e-3 <= taken <= budget + 40
            times = defaultdict(int)
            for r in used:
                times[r.doc_id] += 1
            full = math.floor(budget / n + 1e-9)
            assert all(c in (full, full + 1) for c in times.values()) and (not full or len(times) == sum(bool((x[1] or "").strip()) and x[2] == s for x in rows))
            # the sequence of a source: positions are tokens before, over its budget
            at = 0
            for r in sorted(used, key=lambda r: r.position):
                assert abs(r.position - at / budget) < 1e-6
                at += len(r.text.split())
        empty = [r for r in out if not (r.text or "").strip()]
        assert sum(r.doc_id == 9000 for r in empty) >= 2 and any(r.doc_id == 9001 for r in empty) and sum(r.doc_id == 9002 for r in empty) == 1


def test_many_sources_join_by_salt(spark, monkeypatch):
    prepare(spark)
    rows = corpus(2)
    plain = sorted(map(repr, M.mix(frame(spark, rows)).collect()))
    monkeypatch.setattr(M, "BROADCAST_SOURCES", 0)
    assert sorted(map(repr, M.mix(frame(spark, rows)).collect())) == plain


def test_plain_and_detailed_mix_hold_the_same_rows(spark, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(M, "RANGE_DOCS", 16)
    docs = frame(spark, corpus(3) + [(7777, "same words here", "a")] * 90)
    for config in (M.MixConfig(), M.MixConfig(budget_share=0.4), M.MixConfig(budget_share=1.7)):
        plain = sorted(map(repr, M.mix(docs, config).collect()))
        detailed = M.mix(docs, config, details=True)
        assert len(set(detailed.columns)) == len(detailed.columns) == 10
        assert sorted(map(repr, detailed.select(*docs.columns).collect())) == plain
        same = detailed.where("doc_id = 7777").groupBy("_epoch").count().collect()
        assert (same or config.budget_share < 1) and all(r["count"] == 90 for r in same)


def test_written_mix_is_in_the_order_of_its_blocks(spark, tmp_dir):
    prepare(spark)
    config, path = M.MixConfig(block_tokens=500), os.path.join(tmp_dir, "mix")
    docs = spark.createDataFrame(corpus(4), "doc_id long, text string, source string").repartition(3)
    M.write_mix(docs, path, config)
    read = [r for f in sorted(glob.glob(path + "/*.parquet")) for r in pq.read_table(f).to_pylist()]
    order = [(r["block"], r["place_in_block"]) for r in read]
    assert order == sorted(order) and order[-1][0] > 5
    expected = M.mix(docs, config, details=True).select("doc_id", "block", "place_in_block").collect()
    assert sorted(map(str, ((r["doc_id"], r["block"], r["place_in_block"]) for r in read))) == sorted(map(str, map(tuple, expected)))
    # every block but the last holds the sources in proportion
    share = lambda rows, s: sum(len(r["text"].split()) for r in rows if r["source"] == s and r["text"]) / sum(len(r["text"].split()) for r in rows if r["text"])
    for b in range(order[-1][0]):
        assert abs(share([r for r in read if r["block"] == b], "a") - share(read, "a")) < 0.2


def test_registered_query(spark):
    from scrubjay.llm.queries import op5_mixing
    got = op5_mixing(spark, SF001)
    docs = spark.read.parquet(SF001 + "/documents.parquet").select("doc_id", "text", "source")
    assert got.columns == ["doc_id", "source", "tokens", "epoch", "position", "block", "place_in_block"]
    rows = got.collect()
    total = sum(len(re.findall(r"[^ \t-\r]+", r.text or "")) for r in docs.collect())
    assert total <= sum(r.tokens for r in rows) <= total * 1.05 and {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()}
    assert sorted(r.doc_id for r in M.mix(docs).collect()) == sorted(r.doc_id for r in rows)


def test_edges(spark):
    prepare(spark)
    assert M.mix(frame(spark, [(1, "x", "a")]).limit(0)).collect() == []
    blank = M.mix(frame(spark, [(1, None, "a"), (2, "", None)]))
    assert sorted(r.doc_id for r in blank.collect()) == [1, 2] and blank.columns == ["doc_id", "text", "source", "tokens", "epoch"]
    one = M.mix(frame(spark, [(1, "x y", "a"), (2, "z", "a")]))
    assert sorted(r.doc_id for r in one.collect()) == [1, 2]
