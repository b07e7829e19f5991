"""Language identification by interpolated Kneser-Ney character models (operator 8).

Each language has a character 4-gram model.  Counts come from every training text and
are reduced in Spark; lower orders use continuation counts (in how many different
contexts a gram occurs), as Kneser-Ney smoothing asks.  The models are stored together
in arrays of sorted 64-bit gram keys (four 16-bit characters) with one column of
interpolated log-probabilities a language.  A text goes to the language of the lowest
cross-entropy per character.  The margin over the second language is calibrated to a
probability on all training texts, which also give each language the entropy beyond which
an answer is marked ``rejected``; only counts of their answers reach the driver.

Text is lower-cased; runs of other characters than letters become one space.  Letters
beyond the basic plane count as one symbol.  ``MAX_GRAMS`` bounds what is broadcast: where
an order has more grams, all of them stay in written tables, and the grams of the texts
are joined to these for the same values (``TableModel``).

Edge cases: a null text, or one without a letter, is ``und`` with score 0; ties go to the
first language in sorted order; without training rows every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubjay.llm.common import free_name, held_out, written
from scrubjay.llm.textkernel import SLICE_BYTES, U64
from scrubjay.plans.skew import join_classes

ORDER = 4
MAX_GRAMS = 1_000_000       # per order, all languages together; joined tables beyond
MARGIN_STEPS, ENTROPY_STEPS = 4096, 1024  # places a unit at which calibration counts log margins and entropies
REJECT_SHARE = 0.001        # of calibration texts of a language that its entropy limit leaves out
FLUSH_GRAMS = 2_000_000

_SPACE = 32
_ALPHA = np.array([chr(c).isalpha() for c in range(0x10000)])
_ALPHA[0xFFFF] = True


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(grams, bounds): the 4-gram key at each letter or space of the texts, where each
    text begins after three spaces, and where each text's grams begin."""
    low = [t.lower() for t in texts]
    lengths = np.array([len(t) for t in low], np.int64)
    cp = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4")
    wide = cp > 0xFFFE
    if wide.any():
        cp = cp.copy()
        values, inverse = np.unique(cp[wide], return_inverse=True)
        cp[wide] = np.array([0xFFFF if chr(v).isalpha() else _SPACE for v in values.tolist()], np.uint32)[inverse]
    letter = _ALPHA[cp]
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    follows = np.zeros(len(cp), bool)
    follows[1:] = letter[:-1]
    starts = offsets[:-1][lengths > 0]
    follows[starts] = False
    kept = letter | follows
    at = np.concatenate(([0], np.cumsum(kept)))[offsets]
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    padded = np.full(at[-1] + (ORDER - 1) * len(texts), _SPACE, U64)
    place = np.arange(at[-1]) + (ORDER - 1) * (doc + 1)
    padded[place] = np.where(letter, cp, _SPACE)[kept]
    grams = np.zeros(len(place), U64)
    for back in range(ORDER - 1, -1, -1):
        grams = (grams << U64(16)) | padded[place - back]
    has = np.concatenate(([0], np.cumsum(letter)))[offsets]
    if (np.diff(has) == 0).any():  # texts without a letter have no grams
        use = (np.diff(has) > 0)[doc]
        grams, doc = grams[use], doc[use]
    return grams, np.searchsorted(doc, np.arange(len(texts) + 1))


def _text_groups(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t or "") > SLICE_BYTES:
            yield lo, [x or "" for x in texts[lo:i]]
            lo, size = i, 0
        size += len(t or "")
    if lo < len(texts):
        yield lo, [x or "" for x in texts[lo:]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, count), combined over the task."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merged(parts):
        grams, counts = (np.concatenate(x) for x in zip(*parts))
        grams, inverse = np.unique(grams, return_inverse=True)
        return grams, np.bincount(inverse, weights=counts, minlength=len(grams)).astype(np.int64)

    def out():
        for lang, parts in held.items():
            grams, counts = merged(parts)
            for lo in range(0, len(grams), 100_000):
                g = grams[lo:lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.view(np.int64)),
                                                  pa.array(counts[lo:lo + 100_000])], names=["lang", "gram", "c"])

    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for lo, texts in _text_groups(batch.column(1).to_pylist()):
            grams, bounds = symbols(texts)
            own = np.repeat(langs[lo:lo + len(texts)], np.diff(bounds))
            for lang in set(own.tolist()):
                g, c = np.unique(grams[own == lang], return_counts=True)
                held.setdefault(lang, []).append((g, c))
                size += len(g)
        if size > FLUSH_GRAMS:
            held = {lang: [merged(parts)] for lang, parts in held.items()}
            size = sum(len(p[0][0]) for p in held.values())
            if size > FLUSH_GRAMS // 2:
                yield from out()
                held, size = {}, 0
    yield from out()


@dataclass
class _Level:
    """One order: sorted grams with log-probabilities, sorted contexts with back-off weights."""

    grams: np.ndarray
    full: np.ndarray
    contexts: np.ndarray
    weight: np.ndarray


@dataclass
class Model:
    languages: list[str]
    levels: list[_Level]
    floor: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    limits: np.ndarray | None = None

    def log_probabilities(self, order: int, grams: np.ndarray) -> np.ndarray:
        """log2 P(last character | the others), a column a language."""
        if order == 0:
            return np.broadcast_to(self.floor, (len(grams), len(self.languages)))
        level = self.levels[order - 1]
        at = np.minimum(np.searchsorted(level.grams, grams), max(len(level.grams) - 1, 0))
        hit = level.grams[at] == grams if len(level.grams) else np.zeros(len(grams), bool)
        out = np.empty((len(grams), len(self.languages)), np.float32)
        out[hit] = level.full[at[hit]]
        rest = np.flatnonzero(~hit)
        if len(rest):
            rare, inverse = np.unique(grams[rest], return_inverse=True)
            lower = self.log_probabilities(order - 1, rare & U64((1 << (16 * (order - 1))) - 1))
            out[rest] = (lower + self._back_off(level, rare >> U64(16)))[inverse]
        return out

    @staticmethod
    def _back_off(level: _Level, contexts: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(level.contexts, contexts), max(len(level.contexts) - 1, 0))
        out = level.weight[at].copy()
        out[level.contexts[at] != contexts] = 0.0
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(characters, cross-entropy a character and language) of each text."""
        grams, bounds = symbols(texts)
        n = np.diff(bounds)
        total = np.zeros((len(texts), len(self.languages)))
        if len(grams):
            logs = self.log_probabilities(ORDER, grams)
            some = np.flatnonzero(n)
            total[some] = np.add.reduceat(logs, bounds[:-1][some], axis=0, dtype=np.float64)
        return n, -total / np.maximum(n, 1)[:, None]

    def answers(self, texts: list[str]):
        """(language place or -1, second-best margin in bits, entropy) of each text."""
        return _decide(*self.entropies(texts))


@dataclass
class _Counts:
    """One order in Spark: (lang, gram, c), (lang, context, total, types), and the discount of each language."""

    grams: DataFrame
    contexts: DataFrame
    discount: dict[str, float]


def _orders(counts: DataFrame) -> dict[int, _Counts]:
    grams, out = counts, {}
    for order in range(ORDER, 0, -1):
        if order < ORDER:
            grams = written(grams.groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << (16 * order)) - 1)).alias("gram"))
                            .agg(F.count("*").alias("c")), f"grams{order}")
        context = F.shiftrightunsigned("gram", 16) if order > 1 else F.lit(0).cast("long")
        sums = grams.groupBy("lang", context.alias("context")).agg(F.sum("c").alias("total"), F.count("*").alias("types"))
        ones = {r.lang: (r.n1, r.n2) for r in grams.groupBy("lang").agg(
            F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).collect()}
        out[order] = _Counts(grams, sums, {lang: (a / (a + 2 * b) if a and b else 0.5) for lang, (a, b) in ones.items()})
    return out


def _levels(orders: dict[int, _Counts], languages: list[str]) -> list[_Level]:
    place = {lang: i for i, lang in enumerate(languages)}
    out: list[_Level] = []
    tables = [(order, o.grams.toPandas(), o.contexts.toPandas(), o.discount) for order, o in orders.items()]
    model = Model(languages, out, np.zeros(len(languages)))
    vocabulary = max(len(set(tables[-1][1]["gram"])), 1) + 1
    model.floor = np.full(len(languages), -np.log2(vocabulary), np.float32)
    for order, g, c, discount in reversed(tables):
        contexts = np.unique(c["context"].to_numpy(np.int64).view(U64))
        lang = np.array([place[x] for x in c["lang"]], np.int64)
        d = np.array([discount[x] for x in c["lang"]])
        total = np.zeros((len(contexts), len(languages)))
        weight = np.ones((len(contexts), len(languages)))
        at = np.searchsorted(contexts, c["context"].to_numpy(np.int64).view(U64))
        total[at, lang] = c["total"]
        weight[at, lang] = np.minimum(1.0, d * c["types"] / c["total"])
        keys = np.unique(g["gram"].to_numpy(np.int64).view(U64))
        lang = np.array([place[x] for x in g["lang"]], np.int64)
        d = np.array([discount[x] for x in g["lang"]])
        own = np.zeros((len(keys), len(languages)))
        raw = g["gram"].to_numpy(np.int64).view(U64)
        of = np.searchsorted(contexts, raw >> U64(16) if order > 1 else np.zeros_like(raw))
        of = np.minimum(of, len(contexts) - 1)
        known = total[of, lang] > 0
        value = np.where(known, (g["c"].to_numpy() - d) / np.maximum(total[of, lang], 1), 0.0)
        own[np.searchsorted(keys, raw), lang] = value
        level = _Level(np.zeros(0, U64), np.zeros((0, len(languages)), np.float32), contexts, np.log2(weight).astype(np.float32))
        lower = model.log_probabilities(order - 1, keys & U64((1 << (16 * (order - 1))) - 1))
        back = Model._back_off(level, keys >> U64(16) if order > 1 else np.zeros_like(keys))
        level.full = np.log2(own + np.exp2(lower.astype(float) + back)).astype(np.float32)
        level.grams = keys
        out.append(level)
    return out


@dataclass
class TableModel:
    """The same model as written tables, for counts beyond what may be broadcast: per order
    (gram, full) and (context, back) with a float a language, as in ``_Level``."""

    languages: list[str]
    levels: list[tuple[DataFrame, DataFrame]]
    floor: np.ndarray
    slope: float = 1.0
    offset: float = 0.0
    limits: np.ndarray | None = None

    def log_probabilities(self, order: int, grams: DataFrame) -> DataFrame:
        """(gram, v) of distinct grams: those of the order, and the others by back-off."""
        if order == 0:
            return grams.withColumn("v", _floats(self.floor))
        full, back = self.levels[order - 1]
        hit = grams.join(full, "gram").select("gram", F.col("full").alias("v"))
        miss = grams.join(full, "gram", "left_anti").select("gram", *_parts(order))
        lower = self.log_probabilities(order - 1, miss.select(F.col("suffix").alias("gram")).distinct()).toDF("suffix", "v")
        none = F.coalesce("back", _floats(np.zeros(len(self.languages))))
        return hit.unionByName(miss.join(lower, "suffix").join(back, "context", "left").select(
            "gram", F.zip_with("v", none, lambda x, y: x + y).alias("v")))

    def answers(self, texts: DataFrame) -> DataFrame:
        """(key, best, margin, low) of each distinct text (key, text) with a letter."""
        grams = written(texts.mapInArrow(_text_grams, "key binary, gram long, n long").groupBy("key", "gram").agg(F.max("n").alias("n")), "language-grams")
        needed = written(grams.groupBy("gram").agg(F.count("*").alias("size")), "language-needed")
        logs = written(self.log_probabilities(ORDER, needed.select("gram")).join(needed, "gram"), "language-logs")
        rows = join_classes(grams, logs, "gram", "size", grams.count())
        sums = F.array(*[F.sum(F.col("n") * F.col("v")[i].cast("double")) for i in range(len(self.languages))])
        entropy = rows.groupBy("key").agg(sums.alias("sums"), F.sum("n").alias("n"))

        @F.arrow_udf("struct<best:bigint,margin:double,low:double>")
        def decided(n: pa.Array, sums: pa.Array) -> pa.Array:
            characters = n.to_numpy(zero_copy_only=False)
            h = -np.array(sums.to_pylist(), float).reshape(len(n), -1) / characters[:, None]
            return pa.StructArray.from_arrays([pa.array(x) for x in _decide(characters, h)], names=["best", "margin", "low"])
        return written(entropy.select("key", decided("n", "sums").alias("d")).select("key", "d.*"), "language-answers")


def _floats(values: np.ndarray) -> F.Column:
    return F.array(*[F.lit(float(v)).cast("float") for v in values])


def _parts(order: int) -> tuple[F.Column, F.Column]:
    """Suffix and context of a gram of an order."""
    context = F.shiftrightunsigned("gram", 16) if order > 1 else F.lit(0).cast("long")
    return F.col("gram").bitwiseAND(F.lit((1 << (16 * (order - 1))) - 1)).alias("suffix"), context.alias("context")


def _text_key() -> F.Column:
    return F.unhex(F.md5(F.col("text").cast("string").cast("binary")))


def _text_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, gram, count) of each text."""
    for batch in batches:
        for lo, texts in _text_groups(batch.column(1).to_pylist()):
            grams, bounds = symbols(texts)
            doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
            order = np.lexsort((grams, doc))
            grams, doc = grams[order], doc[order]
            first = np.flatnonzero(np.concatenate(([True], (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])))) if len(doc) else doc
            n = np.diff(np.append(first, len(doc)))
            for a in range(0, len(first), 100_000):
                at = first[a:a + 100_000]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc[at] + lo)), pa.array(grams[at].view(np.int64)),
                                                  pa.array(n[a:a + 100_000], pa.int64())], names=["key", "gram", "n"])


def _tables(orders: dict[int, _Counts], languages: list[str]) -> TableModel:
    """What ``_levels`` computes, by joins: every suffix of a gram is a gram of the order below."""
    lang_place = F.create_map(*[x for i, lang in enumerate(languages) for x in (F.lit(lang), F.lit(i))])[F.col("lang")]

    def vector(name: str):
        pairs = F.map_from_entries(F.collect_list(F.struct(lang_place.alias("k"), F.col(name).alias("v"))))
        return F.transform(F.sequence(F.lit(0), F.lit(len(languages) - 1)), lambda i: F.coalesce(pairs[i], F.lit(0.0)))
    floor = np.full(len(languages), -np.log2(orders[1].grams.select("gram").distinct().count() + 1), np.float32)
    model = TableModel(languages, [], floor)
    for order in range(1, ORDER + 1):
        o = orders[order]
        d = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(o.discount.get(lang, 0.5)))])[F.col("lang")]
        weight = F.log2(F.least(F.lit(1.0), d * F.col("types") / F.col("total")))
        back = written(o.contexts.withColumn("w", weight).groupBy("context").agg(vector("w").cast("array<float>").alias("back")), f"language-back{order}")
        own = o.grams.select("lang", "gram", "c", _parts(order)[1]).join(o.contexts, ["lang", "context"]) \
            .withColumn("p", (F.col("c") - d) / F.col("total")).groupBy("gram").agg(vector("p").alias("own"))
        own = own.select("gram", "own", *_parts(order))
        lower = model.levels[-1][0].toDF("suffix", "lower") if order > 1 else None
        below = own.join(lower, "suffix") if order > 1 else own.withColumn("lower", _floats(floor))
        rest = F.zip_with("lower", "back", lambda x, y: F.pow(F.lit(2.0), x.cast("double") + y))
        full = F.zip_with("own", rest, lambda x, y: F.log2(x + y)).cast("array<float>")
        model.levels.append((written(below.join(back, "context").select("gram", full.alias("full")), f"language-full{order}"), back))
    return model


def _decide(n: np.ndarray, h: np.ndarray):
    """(language place or -1, second-best margin in bits, entropy) by the entropies of each text."""
    best = h.argmin(axis=1)
    low = h[np.arange(len(h)), best]
    second = np.partition(h, 1, axis=1)[:, 1] if h.shape[1] > 1 else low + 1
    return np.where(n > 0, best, -1), n * (second - low), low


def _calibrate(model: Model | TableModel, answered: DataFrame) -> None:
    """Logistic map from log(1 + margin) to the chance of being right, with two pseudo
    texts (one right, one wrong) at margin 0; entropy limits from the answers.  ``answered``
    (lang, best, margin, low) is counted in Spark, by log margin and by entropy."""
    truth = F.array_position(F.array(*[F.lit(x) for x in model.languages]), F.col("lang")) - 1
    used = answered.where("best >= 0").withColumn("bin", F.floor(F.col("low") * ENTROPY_STEPS))
    margins = used.groupBy(F.round(F.log1p("margin") * MARGIN_STEPS).cast("long").alias("x"), (F.col("best") == truth).alias("right")).count().collect()
    margins = sorted((r.x / MARGIN_STEPS, float(r.right), r["count"]) for r in margins) + [(0.0, 1.0, 1), (0.0, 0.0, 1)]
    x, right, n = np.array(margins, float).T
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        w = n * np.maximum(p * (1 - p), 1e-9)
        gradient = np.array([(n * (p - right) * x).sum() + 0.01 * (a - 1), (n * (p - right)).sum() + 0.01 * b])
        hessian = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
        step = np.linalg.solve(hessian, gradient)
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    model.slope, model.offset = max(float(a), 0.0), float(b)
    model.limits = _limits(used, len(model.languages))


def _limits(used: DataFrame, languages: int) -> np.ndarray:
    """The entropy quantile of each language's answers (infinite without any): counts by bins
    tell where it lies, and only the entropies of those bins are fetched."""
    out, bins = np.full(languages, np.inf), {}
    for r in used.groupBy("best", "bin").count().collect():
        bins.setdefault(r.best, []).append((r.bin, r["count"]))
    asked, before = [], {}
    for best, own in bins.items():
        at, n = np.array(sorted(own)).T
        ends = np.cumsum(n)
        rank = (ends[-1] - 1) * (1 - REJECT_SHARE)
        lo, hi = np.searchsorted(ends, [int(rank), int(np.ceil(rank))], side="right")
        before[best] = rank, int(ends[lo] - n[lo])
        asked += [(best, int(k)) for k in {at[lo], at[hi]}]
    if not asked:
        return out
    wanted = F.broadcast(used.sparkSession.createDataFrame(asked, "best long, bin long"))
    values: dict[int, list] = {}
    for r in used.join(wanted, ["best", "bin"]).groupBy("best", "low").count().orderBy("best", "low").collect():
        values.setdefault(r.best, []).append((r.low, r["count"]))
    for best, own in values.items():
        low, n = np.array(own).T
        rank, first = before[best]
        ends = first + np.cumsum(n)
        lo, hi = low[np.searchsorted(ends, [int(rank), int(np.ceil(rank))], side="right")]
        out[best] = lo + (hi - lo) * (rank - int(rank))
    return out


def fit(docs: DataFrame, max_grams: int = MAX_GRAMS) -> Model | TableModel | None:
    """Models of the languages of ``docs`` outside the held-out fold; as tables if an order
    has more than ``max_grams`` (language, gram) rows."""
    ids = F.col("doc_id").cast("long")
    train = docs.select(ids.alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")) \
        .where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    counts = written(train.select("lang", "text").mapInArrow(_count, "lang string, gram long, c long")
                     .groupBy("lang", "gram").agg(F.sum("c").alias("c")), "grams4")
    languages = sorted(r.lang for r in counts.select("lang").distinct().collect())
    if not languages:
        return None
    orders = _orders(counts)
    # an order has no more contexts than grams
    small = all(o.grams.count() <= max_grams for o in orders.values())
    if small:
        model = Model(languages, _levels(orders, languages), np.zeros(0))
        model.floor = np.full(len(languages), -np.log2(len(model.levels[0].grams) + 1), np.float32)
    else:
        model = _tables(orders, languages)
    held = docs.sparkSession.sparkContext.broadcast(model) if small else None

    def answers(batches):
        for batch in batches:
            for lo, texts in _text_groups(batch.column(1).to_pylist()):
                best, margin, low = held.value.answers(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), pa.array(best, pa.int64()), pa.array(margin), pa.array(low)],
                                                 names=["lang", "best", "margin", "low"])
    if small:
        answered = train.select("lang", "text").mapInArrow(answers, "lang string, best long, margin double, low double")
    else:
        keyed = train.select("lang", "text", _text_key().alias("key"))
        answered = keyed.select("lang", "key").join(model.answers(keyed.select("key", "text")), "key").select("lang", "best", "margin", "low")
    _calibrate(model, written(answered, "language-answered"))
    return model


ANSWER = "struct<lang:string,score:double,entropy:double,rejected:boolean>"


def identify(docs: DataFrame, model: Model | None, name: str = "language") -> DataFrame:
    """``docs`` with a struct ``name``: lang, score, entropy (bits a character), rejected."""
    if model is None:
        return docs.withColumn(name, F.expr(f"cast(named_struct('lang', 'und', 'score', 0D, 'entropy', null, 'rejected', true) as {ANSWER})"))
    if isinstance(model, TableModel):
        return _identify_by_tables(docs, model, name)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(ANSWER)
    def run(column: pa.Array) -> pa.Array:
        m, langs, scores, bits, rejected = held.value, [], [], [], []
        for _, texts in _text_groups(column.to_pylist()):
            best, margin, low = m.answers(texts)
            p = 1 / (1 + np.exp(-(m.slope * np.log1p(margin) + m.offset)))
            for i, s, h in zip(best.tolist(), p.tolist(), low.tolist()):
                langs.append(m.languages[i] if i >= 0 else "und")
                scores.append(s if i >= 0 else 0.0)
                bits.append(h if i >= 0 else None)
                rejected.append(i < 0 or h > m.limits[i])
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64()),
                                           pa.array(rejected, pa.bool_())], names=["lang", "score", "entropy", "rejected"])
    return docs.withColumn(name, run(F.col("text").cast("string")))


def _identify_by_tables(docs: DataFrame, model: TableModel, name: str) -> DataFrame:
    own = free_name(docs, "_text_key")
    found = model.answers(docs.where("text is not null").select(_text_key().alias("key"), F.col("text").cast("string").alias("text")))
    langs, limits = F.array(*[F.lit(x) for x in model.languages]), F.array(*[F.lit(float(x)) for x in model.limits])
    at = (F.col("best") + 1).cast("int")
    score = 1 / (1 + F.exp(-(F.lit(model.slope) * F.log1p("margin") + F.lit(model.offset))))
    answer = F.struct(F.element_at(langs, at).alias("lang"), score.alias("score"), F.col("low").alias("entropy"),
                      (F.col("low") > F.element_at(limits, at)).alias("rejected"))
    found = written(found.select(F.col("key").alias("_found_key"), answer.cast(ANSWER).alias(name)), "language-found")
    und = F.expr(f"cast(named_struct('lang', 'und', 'score', 0D, 'entropy', null, 'rejected', true) as {ANSWER})")
    marked = docs.withColumn(own, _text_key())
    joined = marked.join(found, marked[own] == found["_found_key"], "left")
    return joined.select(*[marked[c] for c in docs.columns], F.coalesce(found[name], und).alias(name))
