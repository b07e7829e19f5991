"""Toxicity scores: boosted trees over dense text features, isotonic calibration (operator 3).

Features are lexicon densities, second-person proximity, capitals, punctuation and
obfuscation rates; they read the text only.  The lexicon has a short fixed list and
units learned from labelled rows: normalised words and their 4- to 6-byte beginnings
(stems), kept as 64-bit hashes with log-odds weights.  Normalising lower-cases, undoes
digit-for-letter spelling, drops punctuation inside words and collapses repeated letters,
alike in the lexicon and in texts.

Lexicon, trees and calibration are fitted on a bounded sample: of each class the
``sample_rows / 2`` labelled training rows with the smallest hash of doc_id, weighted by
the class's rows per row drawn.  Trees see three parts of four, the isotonic map the
fourth.  Where a part lacks a class, the trees see all four and their probability is the
score, uncalibrated.

Edge cases: null and empty texts get the score of their (all-zero) features; rows whose
label is null are not learned from; if no labelled row of one class is there at all, the
score is the other class's label (0 without labelled rows).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubjay.llm.common import free_name, held_out, written
from scrubjay.llm.textkernel import _BYTE, _LOWER, U64, Words, _power_tables, grams, mix, text_slices, words

SAMPLE_ROWS = 20_000    # labelled rows that anything is fitted on
CANDIDATE_UNITS = 20_000
LEXICON_UNITS = 4_096
MIN_DOCS = 3            # toxic rows a learned unit must occur in
MIN_LOG_ODDS = 2.0
STEMS = (4, 5, 6)
NEAR = 5                # words between an insult and a second-person word

# Insults the lexicon starts with, and second-person words.
INSULTS = ("idiot moron stupid dumb loser scum trash worthless pathetic disgusting clown fool jerk imbecile "
           "scumbag bastard bitch asshole shit fuck fucking hate kill retard ugly garbage dumm trottel arschloch "
           "scheisse con connard salope merde idiota imbecil puta mierda").split()
SECOND_PERSON = ("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch "
                 "tus ti usted ustedes vosotros").split()

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "@$"]] = True
_PLAIN = _LOWER.copy()
for _from, _to in zip(b"013457@$", b"oieastas"):
    _PLAIN[_from] = _to
_LETTER = np.array([chr(c).isalpha() if c < 128 else True for c in range(256)])
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
FEATURES = 18


def normalised(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the normalised text of a slice."""
    keep = ~_PUNCTUATION[data]
    plain = _PLAIN[data]
    again = np.zeros(len(data), bool)
    again[1:] = plain[1:] == plain[:-1]
    again[offsets[:-1][offsets[:-1] < len(data)]] = False
    keep &= ~again
    at = np.concatenate(([0], np.cumsum(keep)))
    return words(plain[keep], at[offsets])


def units(w: Words) -> np.ndarray:
    """(words, 1 + stems) hashes: the whole word, then its beginnings (0 where shorter)."""
    up, down = _power_tables(len(w.data) + 1)
    sums = np.concatenate((np.zeros(1, U64), np.cumsum(_BYTE[w.data] * up[:len(w.data)], dtype=U64)))
    out = np.zeros((len(w.hashes), 1 + len(STEMS)), U64)
    out[:, 0] = w.hashes
    for j, n in enumerate(STEMS, 1):
        long = w.ends - w.starts > n
        s = w.starts[long]
        out[long, j] = mix((sums[s + n] - sums[s]) * down[s] + U64(n))
    return out


def _hashes_of(items: list[str]) -> np.ndarray:
    raw = " ".join(items).encode()
    return np.unique(normalised(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).hashes)


@dataclass
class Lexicon:
    """Sorted unit hashes and their weights."""

    hashes: np.ndarray
    weights: np.ndarray

    def weigh(self, u: np.ndarray) -> np.ndarray:
        """Largest weight among each word's units."""
        if not len(self.hashes):
            return np.zeros(len(u))
        at = np.minimum(np.searchsorted(self.hashes, u), len(self.hashes) - 1)
        return np.where(self.hashes[at] == u, self.weights[at], 0.0).max(axis=1, initial=0.0)


def _per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return (total[bounds[1:]] - total[bounds[:-1]]).astype(float)


def features(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """One row of ``FEATURES`` numbers per document of a slice."""
    w = normalised(data, offsets)
    b, docs = w.bounds, len(offsets) - 1
    n = np.maximum(w.counts, 1).astype(float)
    weight = lexicon.weigh(units(w))
    seed = np.isin(w.hashes, _SEED)
    hit = seed | (weight > 0)
    doc = np.repeat(np.arange(docs), w.counts)
    peak = np.zeros(docs)
    np.maximum.at(peak, doc[weight > 0], weight[weight > 0])
    hits = _per_doc(hit, b)
    different = np.zeros(docs)
    at = np.flatnonzero(hit)
    if len(at):
        order = at[np.lexsort((w.hashes[at], doc[at]))]
        new = np.concatenate(([True], (w.hashes[order][1:] != w.hashes[order][:-1]) | (doc[order][1:] != doc[order][:-1])))
        different = np.bincount(doc[order][new], minlength=docs).astype(float)
    person = np.flatnonzero(np.isin(w.hashes, _PERSON))
    near = np.zeros(docs)
    if len(at) and len(person):
        spot = np.searchsorted(person, at)
        for side in (np.maximum(spot - 1, 0), np.minimum(spot, len(person) - 1)):
            close = (np.abs(person[side] - at) <= NEAR) & (doc[person[side]] == doc[at])
            near = np.maximum(near, np.bincount(doc[at][close], minlength=docs))
    size = np.maximum(np.diff(offsets), 1).astype(float)
    letter, upper, digit, mark = _LETTER[data], _UPPER[data], _DIGIT[data], _PUNCTUATION[data]
    rate = lambda flags: _per_doc(flags, offsets) / size
    letters = np.maximum(_per_doc(letter, offsets), 1)
    between = np.zeros(len(data), bool)
    between[1:-1] = letter[:-2] & letter[2:]
    triple = np.zeros(len(data), bool)
    triple[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & letter[2:]
    caps_run = np.zeros(len(data), bool)
    caps_run[2:] = upper[2:] & upper[1:-1] & upper[:-2]
    return np.column_stack([
        np.log1p(w.counts), _per_doc(w.ends - w.starts, b) / n, _per_doc(seed, b) / n, hits / n,
        _per_doc(weight, b) / n, peak, np.log1p(different), np.log1p(hits), near / (hits + 1),
        np.bincount(doc[person], minlength=docs) / n, _per_doc(upper, offsets) / letters, rate(caps_run),
        rate(data == 33), rate(data == 63), rate(mark), rate(digit & between), rate(mark & between), rate(triple)])


_SEED, _PERSON = _hashes_of(INSULTS), _hashes_of(SECOND_PERSON)


def _features_column(text, lexicon):
    """The features of a text column as array<double>; other columns pass by untouched."""
    @F.arrow_udf("array<double>")
    def run(column: pa.Array) -> pa.Array:
        rows = [features(data, offsets, lexicon.value) for _, _, data, offsets in text_slices(column)]
        flat = np.concatenate(rows) if rows else np.zeros((0, FEATURES))
        offsets = pa.array(np.arange(0, flat.size + 1, FEATURES), pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(flat.ravel()))
    return run(text)


def _unit_counts(known: np.ndarray | None):
    """(unit, docs) per batch: rows of the batch a unit occurs in; of ``known`` units only,
    where given."""
    def run(batches):
        for batch in batches:
            found = []
            for _, _, data, offsets in text_slices(batch.column(0)):
                w = normalised(data, offsets)
                u = units(w)
                doc = np.repeat(np.arange(len(offsets) - 1), w.counts)
                flat, owner = u.ravel(), np.repeat(doc, u.shape[1])
                use = flat != 0
                if known is not None:
                    use &= np.isin(flat, known)
                flat, owner = flat[use], owner[use]
                order = np.lexsort((owner, flat))
                flat, owner = flat[order], owner[order]
                if len(flat):
                    found.append(flat[np.concatenate(([True], (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])))])
            unit, docs = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, U64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(unit.view(np.int64)), pa.array(docs, pa.int64())], names=["unit", "docs"])
    return run


def _minhash(text):
    """The smallest hash of three consecutive words: equal for most near copies."""
    @F.arrow_udf("long")
    def run(column: pa.Array) -> pa.Array:
        out = []
        for _, _, data, offsets in text_slices(column):
            w = normalised(data, offsets)
            g = grams(w, 3)
            for a, b in zip(w.bounds[:-1], w.bounds[1:]):
                own = g[a:max(b - 2, a)] if b - a >= 3 else w.hashes[a:b]
                out.append(int(own.min().view(np.int64)) if len(own) else 0)
        return pa.array(out, pa.int64())
    return run(text)


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Units of the toxic rows of ``sample`` (text, toxic, group) by log-odds.  A group
    (near copies) counts once among toxic rows, so copied texts do not make a unit."""
    spark = sample.sparkSession
    toxic, clean = sample.where("toxic = 1").dropDuplicates(["group"]), sample.where("toxic = 0")
    counted = toxic.select("text").mapInArrow(_unit_counts(None), "unit long, docs long").groupBy("unit").agg(F.sum("docs").alias("n1"))
    top = counted.where(F.col("n1") >= MIN_DOCS).orderBy(F.desc("n1"), "unit").limit(CANDIDATE_UNITS).collect()
    known = np.array(sorted(r.unit for r in top), np.int64).view(U64)
    known.sort()
    n1, n0 = toxic.count(), clean.count()
    counts = clean.select("text").mapInArrow(_unit_counts(known), "unit long, docs long").groupBy("unit").agg(F.sum("docs").alias("n0"))
    other = {r.unit: r.n0 for r in counts.collect()}  # at most CANDIDATE_UNITS rows
    scored = [(np.log((r.n1 + 0.5) / (n1 + 1)) - np.log((other.get(r.unit, 0) + 0.5) / (n0 + 1)), r.n1, r.unit) for r in top]
    best = sorted((s for s in scored if s[0] >= MIN_LOG_ODDS), key=lambda s: (-s[0] * s[1], s[2]))[:LEXICON_UNITS]
    hashes = np.array([s[2] for s in best], np.int64).view(U64)
    order = np.argsort(hashes)
    return Lexicon(hashes[order], np.array([s[0] for s in best])[order])


@dataclass
class Model:
    lexicon: Lexicon
    trees: GBTClassificationModel | None
    map: IsotonicRegressionModel | None
    share: float


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from labelled rows outside the held-out fold."""
    ids = F.col("doc_id").cast("long").alias("doc_id")
    marked = labels.select(ids, F.col("toxic").cast("int").alias("toxic")).where(
        F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    each = written(marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "toxic-labels")
    half, chosen = max(sample_rows // 2, 1), None
    for label, rows in sorted((r.toxic, r["count"]) for r in each.groupBy("toxic").count().collect()):
        drawn = each.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(half).withColumn(
            "weight", F.lit(rows / min(rows, half)))
        chosen = drawn if chosen is None else chosen.unionAll(drawn)
    if chosen is None:
        chosen = each.withColumn("weight", F.lit(1.0))
    texts = docs.select(ids, F.col("text").cast("string").alias("text"))
    # the sample is bounded by its parameter, so broadcasting its ids is too
    sample = written(texts.join(F.broadcast(chosen), "doc_id").withColumn("group", _minhash(F.col("text"))), "toxic-sample")
    lexicon = learn_lexicon(sample.where("toxic is not null"))
    held = docs.sparkSession.sparkContext.broadcast(lexicon)
    rows = written(sample.select((F.pmod(F.xxhash64(F.lit("calibration"), "group"), F.lit(4)) == 0).alias("calibrates"),
                                 F.col("toxic").cast("double").alias("label"), "weight", _features_column(F.col("text"), held).alias("f"))
                   .select("calibrates", "label", "weight", array_to_vector("f").alias("features")), "toxic-features")
    total, toxic = rows.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    parts = {(r.calibrates, r.label) for r in rows.groupBy("calibrates", "label").count().collect()}
    if len({label for _, label in parts}) < 2:
        return Model(lexicon, None, None, toxic / total if total else 0.0)
    trees = GBTClassifier(maxIter=20, maxDepth=4, stepSize=0.2, seed=7, weightCol="weight")
    if len(parts) < 4:  # so few rows of a class that leaves of one row must be allowed
        return Model(lexicon, trees.setMinInstancesPerNode(1).fit(rows), None, toxic / total)
    trees = trees.setMinInstancesPerNode(5).fit(rows.where("not calibrates"))
    raw = trees.transform(rows.where("calibrates")).select("label", "weight", vector_to_array("probability")[1].alias("features"))
    return Model(lexicon, trees, IsotonicRegression(isotonic=True, weightCol="weight").fit(raw), toxic / total)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name`` between 0 and 1."""
    if model.trees is None:
        return docs.withColumn(name, F.lit(float(model.share)))
    held = docs.sparkSession.sparkContext.broadcast(model.lexicon)
    inner = {x: free_name(docs, f"_toxic_{x}") for x in ("f", "raw", "p", "y", "x")}
    out = docs.withColumn(inner["f"], array_to_vector(_features_column(F.col("text").cast("string"), held)))
    trees = model.trees.copy().setFeaturesCol(inner["f"]).setRawPredictionCol(inner["raw"]).setProbabilityCol(inner["p"]).setPredictionCol(inner["y"])
    out = trees.transform(out).withColumn(inner["x"], vector_to_array(inner["p"])[1])
    final = free_name(docs, "_toxic_score")
    if model.map is None:
        out = out.withColumn(final, F.col(inner["x"]))
    else:
        out = model.map.copy().setFeaturesCol(inner["x"]).setPredictionCol(final).transform(out)
    kept = [F.col(f"`{c}`") for c in docs.columns if c != name]
    return out.select(*kept, F.least(F.greatest(F.col(final), F.lit(0.0)), F.lit(1.0)).alias(name))
