import random

from pyspark.sql import functions as F

from conftest import SF001, obs_frame
from spec_oracle import composite, first_independent_groups, lev_dp, normalize
from scrubjay.config import DedupConfig
from scrubjay.functions.similarity import levenshtein_distance, sequence_ratio_py
from scrubjay.operators import dedup as D
from scrubjay.operators import resolve as RS
from scrubjay.sources.observations import obs_documents


def _groups(rows):
    g = {}
    for r in rows:
        g.setdefault(r.group_id, []).append((r.rank_in_group, r.member_id))
    return [[m for _, m in sorted(v)] for _, v in sorted(g.items())]


def _scan_order(records):
    with_ts = sorted([r for r in records if r[2] is not None], key=lambda r: (r[2], r[0]), reverse=True)
    without = sorted([r for r in records if r[2] is None], key=lambda r: r[0], reverse=True)
    return with_ts + without


def test_levenshtein_bitparallel_matches_dp():
    rnd = random.Random(7)
    for _ in range(300):
        a = "".join(rnd.choice("abcé ") for _ in range(rnd.randint(0, 90)))
        b = "".join(rnd.choice("abcé ") for _ in range(rnd.randint(0, 90)))
        assert levenshtein_distance(a, b) == lev_dp(a, b)
    s = "x" * 70 + "y" * 70
    assert levenshtein_distance(s, s[::-1]) == lev_dp(s, s[::-1])


def test_sequence_ratio_asymmetry_and_autojunk():
    assert sequence_ratio_py("tide", "diet") == 0.25
    assert sequence_ratio_py("diet", "tide") == 0.5
    base = " ".join(f"w{i % 37}" for i in range(120))
    other = base.replace("w3 ", "zz ", 1).replace("w5 ", "yy ", 1)
    assert sequence_ratio_py(base, other, True) != sequence_ratio_py(base, other, False)


def test_exact_groups_on_documents_match_greedy(spark):
    obs = obs_documents(spark, SF001)
    rows = [(r.id, r.content, r.created_at) for r in obs.collect()]
    recs = [(i, normalize(t)) for i, t, _ in _scan_order(rows) if t is not None]
    # at the default weights an unequal pair scores below .25 + .25 + .2 = .7 < .85
    want = first_independent_groups(*zip(*recs), 0.85, lambda a, b: float(a == b))
    got = _groups(D.find_groups(obs).collect())
    assert got == want
    tot = D.dedup_totals(obs, D.find_groups(obs)).collect()[0]
    assert tot.total_records == len(rows)
    assert tot.duplicate_groups == len(want)
    assert tot.duplicate_records == sum(len(g) for g in want)


def _random_cases(n_cases, seed):
    rnd = random.Random(seed)
    rows, cases = [], {}
    nid = 1
    for c in range(n_cases):
        vocab = [f"c{c}w{k}" for k in range(6)]
        base = [rnd.choice(vocab) for _ in range(rnd.randint(2, 7))]
        recs = []
        for _ in range(rnd.randint(3, 9)):
            words = list(base)
            for _ in range(rnd.randint(0, 3)):
                op = rnd.random()
                if op < 0.4 and words:
                    words[rnd.randrange(len(words))] = rnd.choice(vocab)
                elif op < 0.7:
                    words.insert(rnd.randrange(len(words) + 1), rnd.choice(vocab))
                elif words:
                    words.pop(rnd.randrange(len(words)))
            text = " ".join(words) + rnd.choice(["", "!", " #12", " 2024-01-02"])
            ts = None if rnd.random() < 0.05 else f"2024-01-{rnd.randint(1, 3):02d} 0{rnd.randint(0, 2)}:00:00"
            recs.append((nid, text, ts))
            rows.append((nid, text, ts))
            nid += 1
        cases[c] = recs
    return rows, cases


def test_fuzzy_groups_match_greedy_loop(spark):
    """Many random near-duplicate clusters in one table; the groups must equal those of
    the plain newest-first loop over the whole table (texts that normalize to the empty
    string are equal, so such rows group across clusters)."""
    rows, _cases = _random_cases(60, seed=3)
    obs = obs_frame(spark, rows)
    recs = [(i, normalize(x)) for i, x, _ in _scan_order(rows)]
    cache = {}

    def score(a, b):
        if (a, b) not in cache:
            cache[(a, b)] = composite(a, b)
        return cache[(a, b)]

    for t in (0.55, 0.6, 0.7):
        got = _groups(D.find_groups(obs, DedupConfig(similarity_threshold=t)).collect())
        assert got == first_independent_groups(*zip(*recs), t, score), t


def test_non_transitive_triple_and_ties(spark):
    a, b, c = "beta sigma delta delta sigma", "beta sigma beta delta sigma", "beta sigma omega delta sigma"
    t = 0.6
    assert composite(a, b) >= t and composite(b, c) >= t and composite(a, c) < t
    import itertools
    for perm in itertools.permutations([(1, a), (2, b), (3, c)]):
        rows = [(i, x, f"2024-01-0{k + 1} 00:00:00") for k, (i, x) in enumerate(perm)]
        obs = obs_frame(spark, rows)
        got = _groups(D.find_groups(obs, DedupConfig(similarity_threshold=t)).collect())
        recs = [(i, normalize(x)) for i, x, _ in _scan_order(rows)]
        assert got == first_independent_groups(*zip(*recs), t, composite)
    # equal time: the higher id comes first in the scan and is the seed
    obs = obs_frame(spark, [(1, "same text", "2024-01-01 00:00:00"), (2, "same text", "2024-01-01 00:00:00")])
    g = D.find_groups(obs).collect()
    assert {r.member_id for r in g if r.is_seed} == {2}


def test_nulls(spark):
    obs = obs_frame(spark, [(1, None, "2024-01-01 00:00:00"), (2, "x y", None), (3, "x y", "2024-01-01 00:00:00"),
                            (4, None, None)])
    g = D.find_groups(obs).collect()
    assert sorted((r.member_id, r.is_seed) for r in g) == [(2, False), (3, True)]
    assert D.dedup_totals(obs, D.find_groups(obs)).collect()[0].total_records == 4


def test_resolution_markers(spark):
    obs = obs_frame(spark, [(1, "Same", "2024-01-01 00:00:00"), (2, "same!", "2024-01-02 00:00:00"),
                            (3, "other", "2024-01-03 00:00:00")])
    groups = D.find_groups(obs)
    kl = {r.id: r.content for r in RS.apply(obs, groups, "keep_latest").collect()}
    assert kl == {1: "Same [DUPLICATE - KEPT ID: 2]", 2: "same!", 3: "other"}
    fo = {r.id: r.content for r in RS.apply(obs, groups, "flag_only").collect()}
    assert fo == {1: "Same [DUPLICATE GROUP: 0]", 2: "same! [DUPLICATE GROUP: 0]", 3: "other"}
    mg = {r.id: (r.content, r.updated_at) for r in RS.apply(obs, groups, "merge", "2024-06-01 12:00:00").collect()}
    assert mg[2][0] == ("same!\n[MERGED from 1 duplicates on 2024-06-01 12:00:00]"
                        "\n[Original dates: 2024-01-01 00:00:00]")
    assert str(mg[2][1]) == "2024-06-01 12:00:00"
    assert mg[1][0] == "Same [MERGED INTO ID: 2]"
    tot = RS.resolution_totals(groups).collect()[0]
    assert (tot.groups_processed, tot.records_affected) == (1, 2)


def test_default_plan_has_no_pairwise_or_python(spark):
    obs = obs_documents(spark, SF001)
    g = D.find_groups(obs)
    plan = g._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython"):
        assert bad not in plan
    assert F is not None


def test_summary_fast_path_equals_grouped_totals(spark):
    obs = obs_documents(spark, SF001)
    a = D.summarize(obs).collect()[0].asDict()
    b = D.dedup_totals(obs, D.find_groups(obs)).collect()[0].asDict()
    assert a == b
