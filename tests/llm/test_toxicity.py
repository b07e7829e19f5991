import zlib

import numpy as np
import pytest
from conftest import SF01

from scrubjay.llm import queries, toxicity
from scrubjay.llm.common import prepare


def auc(labels, scores):
    order = np.argsort(scores, kind="stable")
    s, y = np.asarray(scores)[order], np.asarray(labels)[order]
    _, inverse, counts = np.unique(s, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    pos = y.sum()
    return (ranks[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos))


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in queries.op3_toxicity(spark, SF01).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    rows = [(labels[d], r) for d, r in got.items() if d in labels and r.held_out]
    assert len(got) == spark.read.parquet(f"{SF01}/documents.parquet").count()
    assert auc([y for y, _ in rows], [r.score for _, r in rows]) > 0.85
    right = sum((r.score >= 0.3) == (r.predicted == 1) for _, r in rows)
    assert right == len(rows) and all(0 <= r.score <= 1 for r in got.values())


def test_features_undo_spelling():
    def one(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        return toxicity.features(raw, np.array([0, len(raw)]), toxicity.Lexicon(np.zeros(0, np.uint64), np.zeros(0)))[0]
    for bad in ("you idiot", "you id1ot", "you I.D.I.O.T", "you iidiooot", "you 1d10t!"):
        assert one(bad)[2] == pytest.approx(0.5) and one(bad)[8] > 0, bad
    assert one("a nice day")[2] == 0 and one("")[0] == 0


def test_edges(spark):
    prepare(spark)
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "a b", "z"), (1, None, "x")], "doc_id long, text string, _toxic_f string")
    labels = spark.createDataFrame([(1, None), (2, 0)], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.fit(docs, labels))
    assert out.columns == ["doc_id", "text", "_toxic_f", "score"] and {r.score for r in out.collect()} == {0.0}
    empty = docs.limit(0)
    assert toxicity.score(empty, toxicity.fit(empty, labels.limit(0))).collect() == []


def test_one_toxic_row(spark):
    """A class with a single labelled row still makes a score that tells texts apart."""
    prepare(spark)
    texts = [(i, f"a fine day number {i} by the sea") for i in range(60)]
    learned = [i for i, _ in texts if zlib.crc32(str(i).encode()) % 4 != 2]
    texts[learned[0]] = (learned[0], "you idiot you stupid loser")
    docs = spark.createDataFrame(texts + [(900, "you stupid idiot you loser"), (901, "a fine day by the sea"), (902, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i == learned[0])) for i, _ in texts], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert model.map is None and got[900] > got[901] and all(0 <= x <= 1 for x in got.values())
    few = toxicity.fit(docs, labels, sample_rows=20)   # drawn per class: the one toxic row stays
    assert few.trees is not None
