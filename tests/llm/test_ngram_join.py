import random
import re

import numpy as np
import pyarrow as pa

from scrubjay.llm import graph, ngram_join
from scrubjay.llm.common import prepare


def shingles(text):
    lower = "".join(c.lower() if c.isascii() else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            n, m = len(sets[a]), len(sets[b])
            if n and m and min(n, m) * 100 >= 80 * max(n, m):
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (n + m - both):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def fixture(seed, groups=24, common=True):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(400))
    boiler = [word() for _ in range(30)]
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([1, 3, 5, 6, 8, 9, 12, 20, 40, 90, 200]))]
        if common and rng.random() < 0.5:
            base += boiler
        texts.append(base)
        for _ in range(rng.choice([0, 1, 2, 5, 45 if seed % 2 else 3])):
            t = list(base)
            for _ in range(rng.randrange(0, 1 + len(t) // 20)):
                at = rng.randrange(len(t))
                t[at:at + 1] = rng.choice([[], [word()], [t[at], word()]])
            if rng.random() < 0.3:
                t = t[: max(1, len(t) - rng.randrange(1 + len(t) // 6))]
            texts.append(t)
    texts += [[], ["solo"], ["solo"], ["É", "b"], ["é", "b"], ["A", "B"], ["a", "b"]]
    rng.shuffle(texts)
    return [(i * 3 + 1, " ".join(t)) for i, t in enumerate(texts)] + [(100000, None), (100001, "\t \n")]


def check(spark, rows):
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], "doc_id long, text string, key string, component_id int").repartition(3)
    per, links = ngram_join.link_components(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in per.collect()} == brute(rows)


def test_against_brute_force(spark):
    prepare(spark)
    check(spark, fixture(1))


def test_long_lists_use_deletions(spark, monkeypatch):
    """With every list of two or more skipped, the one-deletion neighbourhoods must find all links."""
    prepare(spark)
    monkeypatch.setattr(ngram_join, "LONG_LIST", 1)
    check(spark, fixture(2, 14))


def family(copies):
    """Near copies of one text, texts that share a long passage of it, and one link outside."""
    rng = random.Random(copies)
    base = [f"b{i}" for i in range(120)]
    texts = [base]
    for i in range(copies):
        t = list(base)
        t[rng.randrange(120)] = f"x{i}"
        texts.append(t)
    texts += [base[:70] + [f"o{i}w{j}" for j in range(50)] for i in range(40)]
    texts.append(base[:70] + [f"o7w{j}" for j in range(48)])
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_no_deletions_for_a_hot_family(spark, monkeypatch):
    """However many near copies a text has, they are contracted, and only texts without
    any surplus are indexed by deletions."""
    prepare(spark)
    made, written = {}, ngram_join.written

    def counted(df, name):
        made[name] = written(df, name)
        return made[name]
    monkeypatch.setattr(ngram_join, "written", counted)
    for copies in (60, 240):
        check(spark, family(copies))
        assert made["join-long"].count() > 10 * copies
        no_surplus = made["join-entries"].where("spare <= 0").select("id")
        assert made["join-deletions"].join(no_surplus, "id", "left_anti").count() == 0


def test_long_lists_with_many_outside(spark, monkeypatch):
    """Long lists that are too dear to use are left to the deletions: all, or some of them."""
    prepare(spark)
    monkeypatch.setattr(ngram_join, "LONG_LIST", 1)
    for outside in (-1, 1):
        monkeypatch.setattr(ngram_join, "OUTSIDE", outside)
        check(spark, fixture(2, 14) + [(200000 + i, t) for i, t in family(45)])


def test_pigeonhole_is_lossless():
    """Driver-side: any linked pair shares an exact subset, or lacks slack and shares a deletion."""
    scheme, rng = ngram_join.Scheme(), random.Random(5)
    for _ in range(120):
        n = rng.choice([1, 2, 3, 4, 5, 7, 9, 14, 25, 60, 150, 400])
        a = [f"w{rng.randrange(10**6)}" for _ in range(n + 4)]
        b = list(a)
        for _ in range(rng.randrange(1 + max(1, n // 40))):
            b[rng.randrange(len(b))] = f"x{rng.randrange(10**6)}"
        x, y = shingles(" ".join(a)), shingles(" ".join(b))
        if 100 * len(x & y) < 80 * len(x | y):
            continue
        column = pa.array([" ".join(a), " ".join(b)])
        (_, _, data, offsets), = ngram_join.text_slices(column)
        s = ngram_join.Sets(data, offsets, 5)
        sigs = [set(), set()]
        for slot in (0, 1):
            doc, sig, _ = ngram_join._exact(s, scheme, slot)
            for d, v in zip(doc.tolist(), sig.tolist()):
                sigs[d].add(v)
        use, band = ngram_join._slot(s, scheme, 0)
        dele = [set(), set()]
        batch = pa.RecordBatch.from_arrays([column, pa.array([3, 3], pa.int32()), pa.array(s.key.view(np.int64)), pa.array([1, 2])], names=["t", "s", "k", "i"])
        for out in ngram_join._deletions(scheme, 5)(iter([batch])):
            for v, key in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
                for d in (0, 1):
                    if key == s.key[d].view(np.int64):
                        dele[d].add(v)
        assert dele[0] & dele[1]
        shared = len(sigs[0] & sigs[1])
        for d in (0, 1):  # what the count filter and the skipping of long lists rely on
            for slot in (0, 1):
                use, band = ngram_join._slot(s, scheme, slot)
                if use[d] and slot == (0 if s.size[d] <= s.size[1 - d] or band[d] == band[1 - d] else 1):
                    doc, _, _ = ngram_join._exact(s, scheme, slot)
                    assert shared >= (doc == d).sum() - scheme.differ(s.size, band, slot)[d]


def test_short_texts_of_a_hot_family(spark):
    """A text of six shingles, two a segment, and the text of five of them: where they
    differ one hash is left, which no other of the family has alone or beside one more."""
    prepare(spark)
    scheme = ngram_join.Scheme()

    def segments(text):
        (_, _, data, offsets), = ngram_join.text_slices(pa.array([text]))
        s = ngram_join.Sets(data, offsets, 5)
        use, band = ngram_join._slot(s, scheme, 0)
        _, label, start, end, _ = s.segments(use, scheme.roomy[band], band)
        return dict(zip(label.tolist(), (end - start).tolist()))
    for f in range(1000):
        base = " ".join(f"f{f}w{i}" for i in range(9))
        longer, shorter = segments(base + " x"), segments(base)
        if sorted(longer.values()) == [2, 2, 2]:
            break
    lost = next(c for c, n in longer.items() if shorter.get(c) == 1)
    hot = [t for t in (f"{base} y{i} z{i}" for i in range(400)) if segments(t)[lost] != 2][:120]
    check(spark, list(enumerate([base, base + " x"] + hot)))


def test_pairs_that_meet_under_two_slots(spark):
    """Isolated pairs just at the threshold whose sets lie in one band and link into the band below."""
    prepare(spark)
    rows = []
    for i in range(1500):
        shared, x, y = [(24, 3, 3), (28, 3, 4), (28, 4, 3)][i % 3]
        base = " ".join(f"p{i}w{j}" for j in range(shared + 4))
        rows += [(2 * i, base + "".join(f" p{i}x{j}" for j in range(x))), (2 * i + 1, base + "".join(f" p{i}y{j}" for j in range(y)))]
    per, _ = ngram_join.link_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert [r.doc_id for r in per.collect() if r.component_id != r.doc_id // 2 * 2] == []


def test_edges(spark):
    prepare(spark)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.link_components(empty)[0].collect() == []
    docs = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (4, "q r s"), (9, "A b  c")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in ngram_join.link_components(docs)[0].collect())
    assert got == [(-1, 1, None), (4, 1, 4), (5, 1, 5), (5, 1, 5), (9, 1, 5)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 140)]
    parent = {x: x for e in edges for x in e}
    for _ in parent:
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r.id: r.component_id for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: parent[n] for e in edges if e[0] != e[1] for n in e}
