"""Benchmark decontamination by template canonicalisation (operator 7).

A text becomes a sequence of tokens (runs between white space, without punctuation at
their ends, lower-cased).  Numbers, units and names (capitalised inside a sentence) turn
into typed placeholders whose values are kept as slots.  Windows of ``window`` canonical
tokens, at least ``plain`` of them words, are joined by hash between documents and
benchmark items, so a question whose numbers or names were changed still meets its item.

Hits of a document and an item on one diagonal (document place minus item place) form an
alignment.  Its slots must be consistent: one item value stands for one document value
throughout the alignment.  A document is contaminated by an item if consistent alignments
cover at least ``run`` of the item's tokens, or the whole item.

Windows of the tokens themselves, without case in any script, placeholders or ``plain``,
are joined too and count whatever their diagonal's slots say: verbatim copies are found, in
capitals or full of names.  Of an alignment whose slots clash, the longest consistent
stretch counts.  An item of fewer tokens than a window is its own window, and documents get
windows of the lengths such items have: it is found where it stands whole.

The only broadcast is a bitmap of ``BITMAP_BITS`` bits over window hashes; it keeps
document windows that cannot match from being shuffled and has that size for a benchmark
of any size.  Windows join by shuffle.

Edge cases: null and empty texts have no windows; an item with a null id is not searched
for; an item of one word is found in every document that holds the word; rows that repeat
are judged each by their own text.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubjay.llm.common import free_name, written
from scrubjay.llm.textkernel import _BYTE, _LOWER, U64, Words, _power_tables, grams, mix, text_slices, words

WINDOW = 8
PLAIN = 5
RUN = 13
BITMAP_BITS = 1 << 24

# Unit words.
UNITS = ("mm cm m km in ft yd mi mg g kg t lb oz ml l cl gal s sec secs second seconds min mins minute minutes h hr hrs hour hours day days "
         "week weeks month months year years kmh mph km/h m/s w kw v a hz khz mhz ghz j kj cal kcal k c f percent dollar dollars euro euros "
         "cent cents pound pounds meter meters metre metres kilometer kilometers kilometre kilometres mile miles inch inches foot feet yard "
         "yards gram grams kilogram kilograms ton tons tonne tonnes liter liters litre litres").split()

_WORDY = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".?!:;\"'()[]"]] = True
_NUMBER, _UNIT, _NAME, _VERBATIM = (U64(x) for x in (0x6E756D, 0x756E6974, 0x6E616D65, 0x76657262))


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * up[:len(data)], dtype=U64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


_raw_units = " ".join(UNITS).encode()
_unit_words = words(np.frombuffer(_raw_units, np.uint8), np.array([0, len(_raw_units)]))
_UNIT_HASHES = np.unique(_word_hashes(_unit_words.data, _unit_words.starts, _unit_words.ends))


class Canonical:
    """Canonical tokens of a slice: ``tokens`` (hashes or placeholders), ``slot`` (whether a
    token is one) and ``value`` (the token's own hash), ``bounds`` per document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        w = words(data, offsets)
        wordy = np.flatnonzero(_WORDY[data])
        first, last = np.searchsorted(wordy, w.starts), np.searchsorted(wordy, w.ends) - 1
        keep = first <= last
        starts, ends = wordy[first[keep]], wordy[last[keep]] + 1
        lower = _LOWER[data]
        self.value = _word_hashes(lower, starts, ends)
        digits = np.concatenate(([0], np.cumsum(_DIGIT[data])))
        number = digits[ends] > digits[starts]
        unit = np.isin(self.value, _UNIT_HASHES)
        two = np.append(data, 0)[starts + 1] if len(starts) else np.zeros(0, np.uint8)
        capital = _UPPER[data[starts]] | ((data[starts] == 0xC3) & (two >= 0x80) & (two <= 0x9E))
        # a capital opens a sentence after a stop, a line end, or at the beginning
        raw_first = np.flatnonzero(keep)
        before = raw_first - 1
        opens = np.ones(len(starts), bool)
        has = before >= 0
        lines = np.concatenate(([0], np.cumsum(data == 10)))
        opens[has] = _STOP[data[w.ends[before[has]] - 1]] | (lines[starts[has]] > lines[w.ends[before[has]]])
        opens |= starts != w.starts[keep]
        at = np.concatenate(([0], np.cumsum(keep)))
        self.bounds = at[w.bounds]
        opens[self.bounds[:-1][self.bounds[:-1] < len(starts)]] = True
        name = capital & ~opens & ~number & ~unit
        self.slot = number | unit | name
        self.tokens = np.select([number, unit, name], [_NUMBER, _UNIT, _NAME], self.value)

    def windows(self, window: int, plain: int, verbatim: bool = False):
        """(document place, window hash, place in the document) of the windows to join;
        ``verbatim`` ones are of the tokens themselves, every one of them."""
        n = len(self.tokens) - window + 1
        if n <= 0:
            z = np.zeros(0, np.int64)
            return z, z.astype(U64), z
        doc = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))[:n]
        h = grams(Words(None, None, None, None, self.value if verbatim else self.tokens, None), window)
        if verbatim:
            h = mix(h ^ _VERBATIM)
        slots = np.concatenate(([0], np.cumsum(self.slot)))
        some = np.arange(n) + window <= self.bounds[1:][doc]
        if not verbatim:
            some &= window - (slots[window:] - slots[:n]) >= plain
        at = np.flatnonzero(some)
        return doc[at], h[at], at - self.bounds[doc[at]]

    def slots_in(self, doc: np.ndarray, place: np.ndarray, window: int) -> list[list[int]]:
        start = self.bounds[doc] + place
        value, slot = self.value.view(np.int64), self.slot
        return [value[a:a + window][slot[a:a + window]].tolist() for a in start.tolist()]


def _folded(column: pa.Array) -> pa.Array:
    """Texts without case in any script; token places stay."""
    return pa.array([t if t is None else t.casefold() for t in column.to_pylist()], pa.large_string())


def _document_windows(window: int, plain: int, short: list[int], bitmap=None):
    """(doc columns, window, place, slots) of template windows, then of verbatim windows of
    the folded text, which have no slots.  A text of fewer tokens than ``window`` is one
    window of its own length; with a ``bitmap`` every text has windows of the ``short``
    lengths instead, and windows off the bitmap are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if bitmap is None else bitmap.value
        for batch in batches:
            for verbatim in (False, True):
                column = _folded(batch.column(2)) if verbatim else batch.column(2)
                for lo, hi, data, offsets in text_slices(column):
                    c = Canonical(data, offsets)
                    sizes = np.diff(c.bounds)
                    for length in (window, *short):
                        doc, h, place = c.windows(length, plain, verbatim)
                        if bits is None:
                            own = np.minimum(sizes[doc], window) == length
                            doc, h, place = doc[own], h[own], place[own]
                        else:
                            cell = (h & U64(BITMAP_BITS - 1)).astype(np.int64)
                            on = (bits[cell >> 6] >> (cell & 63).astype(U64)) & U64(1) == 1
                            doc, h, place = doc[on], h[on], place[on]
                        for a in range(0, len(doc), 20_000):
                            d, p = doc[a:a + 20_000], place[a:a + 20_000]
                            at = pa.array(d + lo)
                            slots = [[]] * len(d) if verbatim else c.slots_in(d, p, length)
                            yield pa.RecordBatch.from_arrays([
                                batch.column(0).take(at), batch.column(1).take(at), pa.array(h[a:a + 20_000].view(np.int64)), pa.array(p, pa.int32()),
                                pa.array(sizes[d], pa.int32()), pa.array(slots, pa.list_(pa.int64())),
                                pa.array(np.full(len(d), verbatim))], names=["id", "version", "h", "place", "tokens", "slots", "verbatim"])
    return run


_WINDOWS = "id long, version long, h long, place int, tokens int, slots array<long>, verbatim boolean"


def _keyed(rows: DataFrame, id_col: str) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("version"), text.alias("text"))


def _bitmap(windows: DataFrame) -> np.ndarray:
    """The windows' cells, or-ed in Spark to 64-bit words: BITMAP_BITS / 64 rows at most."""
    cell = F.col("h").bitwiseAND(F.lit(BITMAP_BITS - 1))
    rows = windows.select(F.shiftright(cell, 6).alias("word"), F.expr(f"shiftleft(1L, cast(h & 63 as int))").alias("bit")) \
        .groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(BITMAP_BITS // 64, np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return out.view(U64)


def _stretch(hits: list[dict], window: int) -> list[int]:
    """Places of the consecutive windows that cover most tokens among those in which every
    item value stands for one document value."""
    hits = sorted(hits, key=lambda h: h["item_place"])
    places = [h["item_place"] for h in hits]
    gains = [0] + [min(window, b - a) for a, b in zip(places, places[1:])]
    seen: dict[int, Counter] = defaultdict(Counter)
    clashes, lo, cover, most, best = 0, 0, 0, 0, (0, 0)
    for hi, hit in enumerate(hits):
        cover = cover + gains[hi] if hi > lo else window
        for s in hit["slots"]:
            values = seen[s["item_slots"]]
            values[s["slots"]] += 1
            clashes += values[s["slots"]] == 1 and len(values) == 2
        while clashes:
            for s in hits[lo]["slots"]:
                values = seen[s["item_slots"]]
                values[s["slots"]] -= 1
                if not values[s["slots"]]:
                    del values[s["slots"]]
                    clashes -= len(values) == 1
            lo += 1
            cover = cover - gains[lo] if lo <= hi else 0
        if cover > most:
            most, best = cover, (lo, hi + 1)
    return places[best[0]:best[1]]


def _consistent(window: int):
    @F.arrow_udf("array<int>")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([_stretch(hits, window) for hits in column.to_pylist()], pa.list_(pa.int32()))
    return run


def alignments(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, plain: int = PLAIN) -> DataFrame:
    """(doc_id, version, item_id, covered, covered_whole, item_tokens, exact): per document
    and item the item tokens under consistent template alignments, and those under verbatim
    windows and the longest consistent stretch of an alignment that clashes as well;
    ``exact`` if every slot kept its value."""
    items = written(_keyed(benchmark, "item_id").where("id is not null").mapInArrow(
        _document_windows(window, plain, list(range(1, window))), _WINDOWS), "bench-windows")
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(items))
    short = sorted(r.tokens for r in items.where(F.col("tokens") < window).select("tokens").distinct().collect())  # fewer than window
    # an item's repeated window is one template place per repetition; equal rows are one
    theirs = items.select(F.col("id").alias("item_id"), F.col("version").alias("item_version"), "h", F.col("place").alias("item_place"),
                          F.col("tokens").alias("item_tokens"), F.col("slots").alias("item_slots"), "verbatim").dropDuplicates(
        ["item_id", "item_version", "item_place", "verbatim"])
    ours = _keyed(docs, "doc_id").mapInArrow(_document_windows(window, plain, short, bitmap), _WINDOWS).drop("verbatim")
    hits = written(ours.join(theirs, "h").select(
        F.col("id").alias("doc_id"), "version", "item_id", "item_version", "item_tokens", "item_place",
        (F.col("place") - F.col("item_place")).alias("diagonal"), "verbatim", F.arrays_zip("item_slots", "slots").alias("slots")).distinct(), "bench-hits")
    line = ["doc_id", "version", "item_id", "item_version", "item_tokens", "diagonal"]
    clash = hits.select(*line, F.explode("slots").alias("s")).groupBy(*line, F.col("s.item_slots").alias("a")).agg(
        F.min("s.slots").alias("x"), F.max("s.slots").alias("y")).groupBy(*line).agg(
        F.max(F.col("x") != F.col("y")).alias("clash"), F.min((F.col("a") == F.col("x")) & (F.col("a") == F.col("y"))).alias("kept"))
    clash = clash.toDF(*[f"c_{c}" for c in line], "clash", "kept")
    null_safe = [F.col(c).eqNullSafe(F.col(f"c_{c}")) for c in line]
    judged = hits.join(clash, null_safe, "left")
    fine = judged.where(F.col("verbatim") | ~F.coalesce("clash", F.lit(False))).select(
        *line, "item_place", (~F.col("verbatim")).alias("template"), (F.col("verbatim") | F.coalesce("kept", F.lit(True))).alias("kept"))
    # a line has at most one window per item place
    cut = judged.where(~F.col("verbatim") & F.col("clash")).groupBy(*line).agg(
        F.collect_list(F.struct("item_place", "slots")).alias("hits"))
    fine = fine.unionByName(cut.select(*line, F.explode(_consistent(window)("hits")).alias("item_place"),
                                       F.lit(False).alias("template"), F.lit(False).alias("kept")))
    # item places are bounded by the item's length, so a group's list is no longer than the item
    covered = fine.groupBy("doc_id", "version", "item_id", "item_version", "item_tokens").agg(
        F.array_sort(F.collect_set(F.when(F.col("template"), F.col("item_place")))).alias("places"),
        F.array_sort(F.collect_set("item_place")).alias("all_places"), F.min("kept").alias("exact"))

    size = F.least(F.lit(window), F.col("item_tokens"))

    def step(places: str):
        return F.aggregate(places, F.expr("named_struct('n', 0, 'end', -1)"), lambda acc, p: F.struct(
            (acc["n"] + p + size - F.greatest(acc["end"], p)).alias("n"), (p + size).alias("end")), lambda acc: acc["n"])
    return covered.select("doc_id", "version", "item_id", step("places").alias("covered"), step("all_places").alias("covered_whole"),
                          "item_tokens", "exact")


def contaminated(docs: DataFrame, benchmark: DataFrame, run: int = RUN) -> DataFrame:
    """The alignments that make a document contaminated; ``covered`` counts
    verbatim windows and stretches only where templates alone do not suffice."""
    enough = F.least(F.lit(run), F.col("item_tokens"))
    found = alignments(docs, benchmark).where(F.col("covered_whole") >= enough)
    return found.withColumn("covered", F.when(F.col("covered") >= enough, F.col("covered")).otherwise(F.col("covered_whole"))).drop("covered_whole")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, contaminated, items (how many), item_id (of the largest
    cover, ties to the smaller id), covered."""
    bad = contaminated(docs, benchmark).groupBy("doc_id", "version").agg(
        F.count_distinct("item_id").alias("items"), F.max(F.struct("covered", (-F.col("item_id")).alias("i"))).alias("best"))
    rows = _keyed(docs, "doc_id").select(F.col("id").alias("own"), F.col("version").alias("own_version"))
    joined = rows.join(bad, F.col("own").eqNullSafe(F.col("doc_id")) & (F.col("own_version") == F.col("version")), "left")
    return joined.select(F.col("own").alias("doc_id"), F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.lit(0)).alias("items"),
                         (-F.col("best.i")).alias("item_id"), F.coalesce("best.covered", F.lit(0)).alias("covered"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated rows."""
    bad = written(contaminated(docs, benchmark).select(F.col("doc_id").alias("_bad_id"), F.col("version").alias("_bad_version")).distinct(), "bench-bad")
    version = free_name(docs, "_version")
    marked = docs.withColumn(version, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    same = marked["doc_id"].cast("long").eqNullSafe(bad["_bad_id"]) & (marked[version] == bad["_bad_version"])
    return marked.join(bad, same, "left_anti").drop(version)
