from collections import Counter

import numpy as np
from conftest import SF01

from scrubjay.llm import language_id as L, queries
from scrubjay.llm.common import prepare


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in queries.op8_language_id(spark, SF01).collect()}
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    rows = [(docs[d].lang, r) for d, r in got.items() if r.held_out and docs[d].lang is not None and r.lang_pred != "und"]
    assert len(got) == len(docs) and sum(a == r.lang_pred for a, r in rows) / len(rows) > 0.97
    for d, r in got.items():
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in docs[d].text or "")) and 0 <= r.score <= 1


def kneser_ney(texts, size):
    """Plain dictionary version: log2 P of the last character of any 4-gram."""
    grams = Counter()
    for t in texts:
        s = "   "
        for c in t.lower():
            s += c if c.isalpha() else (" " if s[-1] != " " else "")
        for i in range(3, len(s)):
            grams[s[i - 3:i + 1]] += 1
    levels = {4: grams}
    for k in (3, 2, 1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def p(g):
        if not g:
            return 1 / size
        c = levels[len(g)]
        n1, n2 = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        own = {h: v for h, v in c.items() if h[:-1] == g[:-1]}
        total = sum(own.values())
        if not total:
            return p(g[1:])
        return max(c[g] - d, 0) / total + min(1, d * len(own) / total) * p(g[1:])
    return lambda g: np.log2(p(g))


def test_against_plain_kneser_ney(spark):
    prepare(spark)
    texts = {"aa": ["banana bandana, cabana!", "ab ac ad"], "bb": ["über öl äpfel", "zebra quiz über"]}
    rows = [(4 * i, lang, t) for i, (lang, t) in enumerate((x, t) for x, ts in texts.items() for t in ts)]
    model = L.fit(spark.createDataFrame([(None, lang, t) for _, lang, t in rows], "doc_id long, lang string, text string"))
    assert model.languages == ["aa", "bb"]
    probe = ["   b", "bana", "nana", "zzzz", "über", " öl ", "cab ", "ebra"]
    keys = np.array([sum(ord(c) << (16 * (3 - i)) for i, c in enumerate(g)) for g in probe], np.uint64)
    got = model.log_probabilities(4, keys)
    size = len({c for ts in texts.values() for t in ts for c in t.lower() if c.isalpha()}) + 2  # and the space, and one unseen
    for j, lang in enumerate(model.languages):
        plain = kneser_ney(texts[lang], size)
        want = np.array([plain(g) for g in probe])
        seen = [i for i, g in enumerate(probe) if all(c in "".join(texts[lang]).lower() + " " for c in g)]
        assert np.allclose(got[seen, j], want[seen], atol=1e-3)


def test_edges(spark):
    prepare(spark)
    docs = spark.createDataFrame([(1, "x", None), (2, None, "hello"), (3, "en", ""), (4, "en", "123 !?")], "doc_id long, lang string, text string")
    out = {r.doc_id: r.language for r in L.identify(docs, L.fit(docs)).collect()}
    assert all(v.lang == "und" and v.score == 0 for v in out.values())
    empty = docs.limit(0)
    assert L.fit(empty) is None and L.identify(empty, None).collect() == []
    one = spark.createDataFrame([(1, "en", "hello world"), (8, "en", None), (9, None, "42 " * 3000 + "x"), (10, "en", "𝒳𝒴")], "doc_id long, lang string, text string")
    out = {r.doc_id: r.language.lang for r in L.identify(one, L.fit(one)).collect()}
    assert out == {1: "en", 8: "und", 9: "en", 10: "en"}


def test_joined_tables_give_the_same_answers(spark):
    """Beyond ``max_grams`` nothing is cut: the joined tables answer as the broadcast model."""
    prepare(spark)
    docs = spark.read.parquet(f"{SF01}/documents.parquet").where("doc_id < 400").select("doc_id", "lang", "text")
    odd = spark.createDataFrame([(None, "en", "12"), (1001, None, None), (1002, None, "zq zq жж 漢字"), (1002, None, "zq zq жж 漢字")], docs.schema)
    docs = docs.unionByName(odd)
    whole, tables = L.fit(docs), L.fit(docs, max_grams=100)
    assert np.allclose([whole.slope, whole.offset], [tables.slope, tables.offset], atol=1e-3) and np.allclose(whole.limits, tables.limits, atol=1e-5)
    want, got = (sorted(((str(r.doc_id), r.text or "", r.language) for r in L.identify(docs, m).collect()), key=lambda r: r[:2]) for m in (whole, tables))
    assert [(a, t, x.lang, x.rejected) for a, t, x in want] == [(a, t, x.lang, x.rejected) for a, t, x in got]
    for (_, _, x), (_, _, y) in zip(want, got):
        assert np.allclose([x.score, x.entropy or 0], [y.score, y.entropy or 0], atol=1e-4)


def test_calibration_counts_every_training_text(spark):
    """12,000 answers: the chance and the limits follow all of them, rows without id included."""
    model = L.Model(["aa", "bb"], [], np.zeros(2))
    rows = [("aa" if i % 5 else "bb", 0, float(i % 97), 2 + i / 6000) for i in range(12000)] + [("bb", 1, 40.0, 1.0), ("bb", -1, 0.0, 9.0)]
    L._calibrate(model, spark.createDataFrame(rows, "lang string, best long, margin double, low double").repartition(3))
    low = np.array([r[3] for r in rows if r[1] == 0])
    assert np.allclose(model.limits, [np.quantile(low, 1 - L.REJECT_SHARE), 1.0], rtol=0, atol=1e-12)
    chance = 1 / (1 + np.exp(-(model.slope * np.log1p(50.0) + model.offset)))
    assert abs(chance - 0.8) < 0.02


def test_texts_without_an_id_are_learned_and_calibrated(spark):
    prepare(spark)
    rows = [(None, "aa" if i % 2 else "bb", "banana bandana" if i % 2 else "zebra quiz") for i in range(40)]
    model = L.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert np.isfinite(model.limits).all() and model.slope * np.log1p(20) + model.offset > 0
