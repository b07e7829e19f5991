"""Fuzzy dedup beyond the Jaccard prefix join: edit-distance candidates, greedy grouping on
chains and hubs, and the bounds that keep pairs from Python."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from conftest import SF001, obs_frame
from spec_oracle import composite, first_independent_groups, lev_dp, normalize
from test_dedup import _groups, _scan_order
from scrubjay import session
from scrubjay.config import DedupConfig, Weights
from scrubjay.functions import similarity as S
from scrubjay.operators import dedup as D
from scrubjay.plans import candidates as CA
from scrubjay.plans import edit_join, grouping, set_join
from scrubjay.plans.components import component_labels
from scrubjay.sources.observations import obs_documents


def _edited(rnd, text, share):
    out = list(text)
    for _ in range(int(len(text) * share * rnd.random() * 1.3)):
        op, at = rnd.random(), rnd.randrange(len(out) + 1)
        if op < 0.35 and out:
            out[min(at, len(out) - 1)] = rnd.choice("abcdexyz ")
        elif op < 0.7:
            out.insert(at, rnd.choice("abcdexyz "))
        elif out:
            del out[min(at, len(out) - 1)]
    if rnd.random() < 0.15:  # a moved block
        cut = rnd.randrange(len(out) + 1)
        out = out[cut:] + out[:cut]
    return "".join(out)


def _records(seed, n=45):
    rnd = random.Random(seed)
    texts = []
    for _ in range(n):
        size = rnd.choice([1, 2, 3, 5, 8, 13, 30, 60, 110])
        base = "".join(rnd.choice("abcde fgh") for _ in range(size))
        texts += [base] + [_edited(rnd, base, rnd.choice([0.05, 0.15, 0.3])) for _ in range(rnd.randrange(0, 3))]
    return [(i + 1, t, f"2024-01-{1 + rnd.randrange(20):02d} 00:00:00") for i, t in enumerate(texts)]


CASES = [
    ((0.0, 0.5, 0.5, 0.0), 0.85), ((0.0, 0.4, 0.4, 0.2), 0.8), ((0.3, 0.25, 0.25, 0.2), 0.5),
    ((0.0, 1.0, 0.0, 0.0), 0.9),
]


@pytest.mark.parametrize("weights,threshold", CASES)
def test_groups_without_jaccard_floor_match_plain_loop(spark, weights, threshold):
    cfg = DedupConfig(similarity_threshold=threshold, weights=Weights(*weights))
    assert CA.filters(cfg)[1] is not None
    rows = _records(int(threshold * 100))
    recs = [(i, normalize(t)) for i, t, _ in _scan_order(rows)]
    scores = {}

    def score(a, b):
        if (a, b) not in scores:
            scores[a, b] = composite(a, b, weights)
        return scores[a, b]

    obs = obs_frame(spark, rows)
    want = first_independent_groups(*zip(*recs), threshold, score)
    assert _groups(D.find_groups(obs, cfg).collect()) == want
    assert len(want) > 5


def test_filters_hold_both_bounds():
    assert CA.filters(DedupConfig(similarity_threshold=0.6)) == (pytest.approx(0.5), None)
    tau, share = CA.filters(DedupConfig(similarity_threshold=0.5))
    assert tau == 0.25 and share == pytest.approx(0.05 / 0.375)
    for bad in (DedupConfig(similarity_threshold=0.2), DedupConfig(similarity_threshold=0.0),
                DedupConfig(similarity_threshold=0.3, weights=Weights(0, 0.5, 0.5, 0))):
        with pytest.raises(ValueError, match="no lossless candidate filter"):
            CA.filters(bad)


@pytest.mark.parametrize("share", [0.0, 0.2, 0.45])
def test_edit_candidates_lose_no_pair(spark, share):
    rnd = random.Random(int(share * 100))
    texts = {normalize(t) for _, t, _ in _records(int(share * 1000) + 7, 60)} - {""}
    texts |= {"é" * 20 + "x" * 20, "é" * 19 + "x" * 21, "z" * 700, "z" * 690 + "y" * 10, "ab" * 400 + "c"}
    texts = sorted(texts)
    rnd.shuffle(texts)
    df = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "v long, norm string, nc int")
    got = {(r.u, r.v) for r in edit_join.edit_candidates(df.repartition(3), share).collect()}
    assert all(u < v for u, v in got)
    for v in range(len(texts)):
        for u in range(v):
            longest = max(len(texts[u]), len(texts[v]))
            if abs(len(texts[u]) - len(texts[v])) <= share * longest and lev_dp(texts[u], texts[v]) <= share * longest:
                assert (u, v) in got, (texts[u], texts[v])


def test_edit_join_plan_is_an_equi_join(spark):
    df = spark.createDataFrame([(1, "abc def", 7)], "v long, norm string, nc int")
    plan = edit_join.edit_candidates(df, 0.15)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_ratio_bound_holds_for_moved_blocks():
    """An edit distance bounds the ratio by 1 - d/(n+m); 2(max - d)/(n+m) would be too low."""
    rnd = random.Random(1)
    for _ in range(400):
        a = "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 25)))
        b = _edited(rnd, a, 0.4) or "a"
        d = S.levenshtein_distance(a, b)
        assert SequenceMatcher(None, a, b).ratio() <= 1 - d / (len(a) + len(b)) + 1e-12
    assert SequenceMatcher(None, "xxA", "Ayy").ratio() > 2 * (3 - S.levenshtein_distance("xxA", "Ayy")) / 6


def test_histogram_bound(spark):
    rnd = random.Random(2)
    pairs = [("".join(rnd.choice("abc 1_é日") for _ in range(rnd.randrange(0, 40))), "".join(rnd.choice("abd 2é語") for _ in range(rnd.randrange(0, 40))))
             for _ in range(200)]
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select("a", "b", S.shared_characters(S.histogram(F.col("a")), S.histogram(F.col("b"))).alias("n"), S.histogram(F.col("a")).alias("h")).collect()
    for r in rows:
        assert sum(r.h) == len(r.a) and r.n >= sum(min(r.a.count(c), r.b.count(c)) for c in set(r.a))


def test_ratio_from_arrays_equals_difflib(monkeypatch):
    rnd = random.Random(8)
    for n in range(1200):
        size = rnd.choice([0, 1, 2, 5, 20, 60, 199, 200, 230, 500])
        alphabet = rnd.choice(["ab", "abcdefgh ", "abcdefghijklmnopqrstuvwxyzäöüABCDEFGHIJ0123456789_ 日本語🙂"])
        a = "".join(rnd.choice(alphabet) for _ in range(size))
        b = _edited(rnd, a, rnd.choice([0.02, 0.1, 0.5])) if rnd.random() < 0.7 else "".join(rnd.choice(alphabet) for _ in range(size))
        junk = rnd.random() < 0.7
        assert S.sequence_ratio(a, b, junk) == S.sequence_ratio_py(a, b, junk), (a, b, junk)
        assert S.levenshtein_distance(a[:60], b[:60]) == lev_dp(a[:60], b[:60])
    monkeypatch.setattr(S, "RUN_PAIRS", 10)
    assert S.sequence_ratio("abab" * 20, "baba" * 20) == S.sequence_ratio_py("abab" * 20, "baba" * 20)


def _plain_seeds(edges):
    before = {}
    for u, v in edges:
        before.setdefault(v, set()).add(u)
        before.setdefault(u, set())
    seed = {}
    for v in sorted(before):
        seed[v] = not any(seed[u] for u in before[v])
    return seed


def _seeds(spark, edges, **kw):
    df = spark.createDataFrame(edges, "u long, v long")
    return {r.x: r.seed for r in grouping.greedy_seeds(df, **kw).collect()}


def test_long_chain_takes_a_constant_number_of_writes(spark, monkeypatch):
    writes = []
    plain = session.cut_lineage
    monkeypatch.setattr(grouping, "cut_lineage", lambda df: writes.append(1) or plain(df))
    counts = []
    for n in (200, 2000):
        writes.clear()
        edges = [(i, i + 1) for i in range(n)]
        assert _seeds(spark, edges) == _plain_seeds(edges)
        counts.append(len(writes))
    assert counts[0] == counts[1] < 12


@pytest.mark.parametrize("limit", [0, 22])
def test_components_and_rounds_agree_with_plain_loop(spark, limit):
    """Chains, hubs and random graphs, with components walked or left to further rounds."""
    rnd = random.Random(limit)
    edges = [(i, i + 1) for i in range(0, 15)] + [(100, 101 + i) for i in range(60)] + [(200 + i, 300) for i in range(60)]
    edges += [(400 + i, 400 + j) for i in range(25) for j in range(i + 1, 25) if rnd.random() < 0.2]
    edges += [(1000 + 40 * c + i, 1000 + 40 * c + i + 1) for c in range(5) for i in range(10)] + edges[:10]
    rnd.shuffle(edges)
    assert _seeds(spark, edges, component_edges=limit) == _plain_seeds(edges)


def test_component_labels(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(300)] + [(500, 500 + i) for i in range(1, 50)] + [(7, 7), (600, 600)]
    edges += [(700 + rnd.randrange(60), 700 + rnd.randrange(60)) for _ in range(40)]
    rnd.shuffle(edges)
    got = {r.x: r.component for r in component_labels(spark.createDataFrame(edges + [(None, 3)], "u long, v long")).collect()}
    low = {x: x for e in edges for x in e}
    for _ in range(len(low)):
        before = dict(low)
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            break
    assert got == low
    assert component_labels(spark.createDataFrame([], "u long, v long")).collect() == []


def test_fewer_pairs_reach_python_and_ratios_are_difflib(spark):
    prep = D.prepare(obs_documents(spark, SF001)).filter(F.col("content").isNotNull())
    reps = CA.representatives(prep.select("id", "sk", "norm", D.norm_key(F.col("norm")).alias("key")))
    cfg = DedupConfig(similarity_threshold=0.5)
    texts = {tuple(r.v): r.norm for r in reps.collect()}
    edges = CA.scored_edges(session.cut_lineage(reps), cfg).collect()
    for r in edges:
        a, b = texts[tuple(r.u)], texts[tuple(r.v)]
        assert r.sequence_similarity == SequenceMatcher(None, a, b).ratio()
        assert r.levenshtein_similarity == 1.0 - lev_dp(a, b) / max(len(a), len(b)) if len(a) < 900 else True


def _word_texts(seed, n=260):
    """Texts of one to 60 words from a small vocabulary, many of them edited copies."""
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        if out and rnd.random() < 0.6:
            words = [w for w in rnd.choice(out) if rnd.random() < 0.85] + [rnd.choice("pqrst") * rnd.randrange(1, 5) for _ in range(rnd.randrange(4))]
        else:
            words = [f"w{min(int(rnd.expovariate(0.02)), 400)}" for _ in range(rnd.choice([1, 2, 5, 20, 40, 60]))]
        out.append(words or ["one"])
    return list(dict.fromkeys(" ".join(w) for w in out))


@pytest.mark.parametrize("tau,entries", [(0.2, 300), (0.5, 8_000_000), (0.5, 300), (0.72, 60)])
def test_counting_join_loses_no_pair(spark, monkeypatch, tau, entries):
    monkeypatch.setattr(set_join, "BLOCK_ENTRIES", entries)
    monkeypatch.setattr(set_join, "PART_ROWS", 50)
    texts = _word_texts(int(tau * 100))
    sets = [set(t.split()) for t in texts]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900 + i, t) for i, t in enumerate(texts[:40])], "i long, norm string")
    rows = rows.select(F.struct(F.lit(0).cast("long").alias("t"), "i").alias("sk"), "norm", D.norm_key(F.col("norm")).alias("key")).repartition(5)
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for b in range(len(sets)) for a in range(b)}
    got = [(r.u.i, r.v.i, r.jaccard) for r in CA.jaccard_pairs(rows, tau).collect()]
    assert len(got) == len(set(got)) and {(a, b): j for a, b, j in got} == {k: j for k, j in want.items() if j >= tau}
    assert len(got) > 50


def test_texts_that_share_words_by_chance_make_no_rows(spark):
    """Every text holds the same few rare words; a row per text and shared word would be 400 * 400 * 3 / 2."""
    texts = [" ".join([f"r{k}" for k in range(3)] + [f"t{i}x{k}" for k in range(12)] + ["the"]) for i in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "v long, norm string").select(
        "v", "norm", F.length("norm").alias("nc"), D.norm_key(F.col("norm")).alias("key"))
    assert set_join.set_candidates(rows, 0.5).count() == 0


def test_segments_are_not_broadcast(spark):
    """Rows of segments grow far beyond the bytes of the texts, so no side goes through the driver."""
    path = session.cut_lineage(spark.range(2000).select(F.col("id").alias("v"), F.concat(F.lit("http://a.example/"), F.col("id").cast("string")).alias("norm"))
                               .withColumn("nc", F.length("norm")))
    assert "Broadcast" not in edit_join.edit_candidates(path, 0.15)._jdf.queryExecution().executedPlan().toString()


def test_counting_join_compares_whole_sets(spark):
    """Sets that share their first words but too few others bring no candidate row: all words
    are compared where the index lies, so that no text moves for such pairs."""
    import random

    from scrubjay.plans import set_join
    from scrubjay.plans.candidates import texts_of
    rng = random.Random(8)
    common = [f"c{i}" for i in range(300)]
    rows, want = [], set()
    for i in range(120):
        # rare words shared by four texts each, the rest drawn from few common ones
        words = [f"r{i // 4}x{k}" for k in range(12)] + rng.sample(common, 60)
        rows.append((f"k{i:03d}", (i, i), " ".join(words), set(words)))
    for a in range(120):
        for b in range(a):
            x, y = rows[a][3], rows[b][3]
            if len(x & y) / len(x | y) >= 0.3:
                want.add((b, a))
    df = spark.createDataFrame([r[:3] for r in rows], "key string, sk struct<t:long,i:long>, norm string")
    got = {(r.u.i, r.v.i) for r in set_join.set_candidates(texts_of(df), 0.3).collect()}
    assert got == want and len(want) < 120 * 3 / 2
