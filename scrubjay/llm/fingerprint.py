"""Document fingerprints by one-permutation MinHash (operator 13); DataFrame functions only.

Every shingle of a text (five words; a shorter text has its whole word sequence as one)
is hashed once.  The top bits of the hash name one of ``BINS`` bins, and each bin keeps
its smallest hash.  An empty bin takes the value of another: it tries the bins that a
hash of (bin, attempt) names until one is filled (optimal densification: the donor is
uniform over the filled bins, and equal for two texts that fill the same bins).  After
``PROBES`` attempts the filled bin with the smallest hash of (bin, donor) gives, which is
uniform too and always ends.  The low ``BITS`` bits of each bin are packed into longs.

Two fingerprints agree in a bin with probability J + (1 - J) / 2**BITS, J being the Jaccard
similarity of the shingle sets; :func:`likeness` inverts that (bias correction) and keeps
the result in 0 to 1.

Words are runs of bytes other than space and 0x09-0x0D, unchanged.  A text without words
(null, empty, white space) has an empty fingerprint, which is like another empty one (1)
and unlike any other (0).  Equal texts have equal fingerprints.  The work on a text is
linear in its words, but for one sort of its shingle hashes; no Python, no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrubjay.llm.common import free_name, written

SHINGLE = 5
BINS = 128
BITS = 8
PROBES = 12


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once (a lambda's argument is not repeated)."""
    return F.get(F.transform(F.array(value), body), 0)


def shingle_hashes(text: Column, k: int = SHINGLE) -> Column:
    """64-bit hashes of a text's ``k``-word shingles, in text order, repeats kept."""
    split = F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")

    def hashes(words: Column) -> Column:
        n = F.size(words)
        every = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))
        return F.when(n >= k, every).when(n > 0, F.array(F.xxhash64(words))).otherwise(F.expr("cast(array() as array<long>)"))
    return _let(split, hashes)


def _bin(h: Column, bins: int) -> Column:
    """Place of a hash by its top bits, in ascending order of the hash."""
    top = bins.bit_length() - 1
    return (F.shiftright(h, 64 - top) + bins // 2).cast("int")


def _minima(hashes: Column, bins: int) -> Column:
    """Each filled bin's smallest hash, in bin order."""
    top = bins.bit_length() - 1
    return _let(F.sort_array(hashes), lambda s: F.filter(
        s, lambda h, i: (i == 0) | (F.shiftright(h.bitwiseXOR(F.get(s, i - 1)), 64 - top) != 0)))


def _densified(minima: Column, bins: int, bits: int) -> Column:
    """array<int> of ``bins`` low-order values; empty bins take a filled bin's value."""
    gap = lambda n: F.array_repeat(F.lit(None).cast("int"), n)
    low = lambda h: h.bitwiseAND((1 << bits) - 1).cast("int")

    def sparse(m: Column) -> Column:
        filled = F.transform(m, lambda h, i: F.concat(
            gap(_bin(h, bins) - F.when(i == 0, 0).otherwise(_bin(F.get(m, i - 1), bins) + 1)), F.array(low(h))))
        return F.concat(F.flatten(filled), gap(bins - 1 - _bin(F.element_at(m, -1), bins)))

    def dense(m: Column, v: Column) -> Column:
        def donor(i: Column) -> Column:
            ranked = F.transform(m, lambda h: F.struct(F.xxhash64(i, _bin(h, bins)).alias("rank"), low(h).alias("value")))
            return F.array_min(ranked)["value"]

        def value(x: Column, i: Column) -> Column:
            probes = [F.get(v, F.xxhash64(i, F.lit(t)).bitwiseAND(bins - 1).cast("int")) for t in range(-1, -1 - PROBES, -1)]
            return F.coalesce(x, *probes, donor(i))
        return F.transform(v, value)
    return _let(minima, lambda m: _let(sparse(m), lambda v: dense(m, v)))


def _packed(values: Column, bits: int) -> Column:
    """Low-order values, 64 / ``bits`` to a long, the first in the highest bits."""
    per = 64 // bits
    word = lambda i: F.aggregate(F.slice(values, i * per + 1, F.lit(per)), F.lit(0).cast("long"),
                                 lambda acc, x: F.shiftleft(acc, bits).bitwiseOR(x.cast("long")))
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / per).cast("int") - 1), word)


def fingerprint(text: Column, k: int = SHINGLE, bins: int = BINS, bits: int = BITS) -> Column:
    """Packed fingerprint (array<long>) of a text; empty for a text without words.
    ``bins`` is a power of two, ``bits`` divides 64, and they fill whole longs."""
    if bins & (bins - 1) or 64 % bits or bins * bits % 64:
        raise ValueError("bins must be a power of two, bits a divisor of 64, and bins * bits a multiple of 64")
    none = F.expr("cast(array() as array<long>)")

    def made(h: Column) -> Column:
        return F.when(F.size(h) > 0, _let(_densified(_minima(h, bins), bins, bits), lambda v: _packed(v, bits))).otherwise(none)
    return _let(shingle_hashes(text, k), made)


def likeness(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Jaccard similarity estimated from two packed fingerprints, 0 to 1."""
    lowest = reduce(lambda acc, i: acc | (1 << i), range(0, 64, bits), 0)
    lowest -= (lowest >> 63) << 64  # as a signed long
    folds = [1 << s for s in range(bits.bit_length() - 2, -1, -1)]

    def differing(x: Column, y: Column) -> Column:
        folded = reduce(lambda acc, s: lambda v: _let(acc(v), lambda w: w.bitwiseOR(F.shiftrightunsigned(w, s))),
                        folds, lambda v: v)
        return F.bit_count(folded(x.bitwiseXOR(y)).bitwiseAND(F.lit(lowest))).cast("int")

    apart = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda acc, n: acc + n)
    chance = 1.0 / (1 << bits)
    estimate = ((1 - apart / F.lit(float(bins))) - chance) / (1 - chance)
    empty_a, empty_b = F.size(a) == 0, F.size(b) == 0
    return F.when(empty_a | empty_b, F.when(empty_a & empty_b, 1.0).otherwise(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), estimate)))


def fingerprint_text(packed: Column) -> Column:
    """Hexadecimal form, 16 digits a long."""
    return F.array_join(F.transform(packed, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def fingerprints(docs: DataFrame, column: str = "fingerprint", text: str = "text") -> DataFrame:
    """``docs`` with the packed fingerprint of ``text`` as a further column (under a name
    that is free, if ``column`` is taken)."""
    return docs.withColumn(free_name(docs, column), fingerprint(F.col(text)))


KEY = ["has_id", "id", "hash", "n_chars"]


def _order(keys: DataFrame) -> DataFrame:
    """Each distinct document key with the key before it and that one's length (the last
    key is before the first).  Keys are slim rows: a range sort is written, the row before
    is found inside each range, and the last row of the range before, from a table of one
    row per range."""
    ranges = keys.repartitionByRange(*KEY[:3], "n_chars").sortWithinPartitions(*KEY)
    placed = written(ranges.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()),
                     "fingerprint-order")
    key = F.struct(*KEY)
    lasts = placed.groupBy("part").agg(F.max_by(key, "at").alias("last"))
    before = Window.orderBy("part")  # one row per range
    final = lasts.agg(F.max_by("last", "part").alias("final"))
    lasts = lasts.withColumn("previous", F.lag("last").over(before)).crossJoin(F.broadcast(final)) \
        .select("part", F.coalesce("previous", "final").alias("range_before"))
    inside = Window.partitionBy("part").orderBy("at")
    pairs = placed.withColumn("before", F.lag(key).over(inside)).join(F.broadcast(lasts), "part")
    return pairs.select(*KEY, F.coalesce("before", "range_before").alias("before"))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Every row's fingerprint beside those of its edited text and of the next document.

    The edited text ends in the beginning of the next document: the last quarter of the
    code points (rounded down) is replaced by as many from there, or all it has.  Order is
    ascending ``doc_id``, nulls first, equal ids by text hash; the first document follows
    the last.  Rows that repeat both ``doc_id`` and text are one document and give equal
    rows.  Null texts are empty; only ``doc_id`` and ``text`` of ``docs`` are read.

    Returns doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited,
    near_next.  Texts are dealt once by key; both joins read that exchange, and what
    follows a document moves as a prefix of at most a quarter of its neighbour's length."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(
        F.col("doc_id").isNotNull().alias("has_id"), F.coalesce("doc_id", F.lit(0)).alias("id"),
        F.xxhash64("text").alias("hash"), F.length("text").alias("n_chars"), "text")
    keys = written(rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies")), "fingerprint-keys")
    if keys.where("copies > 1").isEmpty():
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    else:  # copies meet in a partial aggregate, so a row that repeats very often does not gather
        rows = rows.groupBy(*KEY).agg(F.min("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumn("fingerprint", fingerprint(F.col("text")))
    order = _order(keys.drop("copies"))
    take = F.floor(F.col("before.n_chars") / 4).cast("int")
    follows = rows.join(order.hint("shuffle_hash"), KEY).select(
        *[F.col(f"before.{c}").alias(c) for c in KEY],
        F.substring("text", F.lit(1), take).alias("tail"), F.col("fingerprint").alias("next_fingerprint"), "copies")
    follows = follows.drop("copies")
    own = F.col("n_chars") - F.floor(F.col("n_chars") / 4).cast("int")
    joined = rows.join(follows, KEY).withColumn("edited_text", F.concat(F.substring("text", F.lit(1), own), "tail")) \
        .withColumn("edited_fingerprint", fingerprint(F.col("edited_text")))
    return joined.select(
        F.when(F.col("has_id"), F.col("id")).alias("doc_id"), F.col("n_chars").cast("long").alias("n_chars"), "edited_text",
        "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int"))).alias("_copy")).drop("_copy")
