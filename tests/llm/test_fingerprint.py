import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from scrubjay.llm import fingerprint as P
from scrubjay.llm.common import prepare
from scrubjay.llm.queries import op13_fingerprint

SF001 = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def shingles_of(text, k=5):
    w = words_of(text)
    return {tuple(w[i:i + k]) for i in range(max(len(w) - k + 1, 0))} or ({tuple(w)} if w else set())


def hashes_by_word(spark, texts):
    """Spark's hash of every shingle, keyed by its words."""
    out = {}
    every = sorted(set().union(*(shingles_of(t) for t in texts)))
    for n in {len(s) for s in every}:
        own = [s for s in every if len(s) == n]
        df = spark.createDataFrame([(list(s),) for s in own], "w array<string>")
        h = F.xxhash64(*[F.col("w")[i] for i in range(5)]) if n == 5 else F.xxhash64("w")
        out |= {tuple(r.w): r.h for r in df.select("w", h.alias("h")).collect()}
    return out


def pair_hashes(spark, firsts, seconds):
    a = spark.createDataFrame([(i,) for i in firsts], "i int")
    b = spark.createDataFrame([(j,) for j in seconds], "j int")
    return {(r.i, r.j): r.h for r in a.crossJoin(b).select("i", "j", F.xxhash64("i", "j").alias("h")).collect()}


def plain(hashes, probe, rank, bins, bits):
    """Packed longs of a set of hashes, bin by bin."""
    shift, least = 64 - (bins.bit_length() - 1), {}
    for h in hashes:
        b = (h >> shift) + bins // 2
        least[b] = min(h, least.get(b, h))
    if not least:
        return []
    values = []
    for i in range(bins):
        b = i
        if b not in least:
            tries = [probe[i, t] & (bins - 1) for t in range(-1, -1 - P.PROBES, -1)]
            b = next((x for x in tries if x in least), None)
            if b is None:
                b = min(least, key=lambda x: rank[i, x])
        values.append(least[b] & ((1 << bits) - 1))
    per, out = 64 // bits, []
    for lo in range(0, bins, per):
        word = 0
        for v in values[lo:lo + per]:
            word = (word << bits) | v
        out.append(word - (1 << 64) if word >> 63 else word)
    return out


@pytest.mark.parametrize("bins,bits", [(128, 8), (64, 2), (64, 1), (16, 16), (256, 4)])
def test_equals_plain_version(spark, bins, bits):
    rng = random.Random(bins)
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "日本", "x\x0b"[:1]]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (0, 1, 2, 4, 5, 6, 9, 30, 200, 3000)]
    texts += [None, " \t\n", "a  b\tc\nd\x0be f", " lead a b c d trail ", "a b c d e " * 400]
    word_hash = hashes_by_word(spark, texts)
    probe = pair_hashes(spark, range(bins), range(-P.PROBES, 0))
    rank = pair_hashes(spark, range(bins), range(bins))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for r in df.withColumn("fp", P.fingerprint(F.col("text"), bins=bins, bits=bits)).collect():
        assert list(r.fp) == plain([word_hash[s] for s in shingles_of(r.text)], probe, rank, bins, bits), r.text


def test_likeness_is_unbiased(spark):
    rng = random.Random(5)
    rows = []
    for i in range(240):
        n, cut = rng.choice([20, 60, 150, 400]), rng.random()
        a = [f"{rng.random():.6f}" for _ in range(n)]
        b = a[:int(n * cut)] + [f"{rng.random():.6f}" for _ in range(n - int(n * cut))]
        x, y = shingles_of(" ".join(a)), shingles_of(" ".join(b))
        rows.append((" ".join(a), " ".join(b), len(x & y) / len(x | y)))
    df = spark.createDataFrame(rows, "a string, b string, truth double")
    for bins, bits in ((128, 8), (128, 2), (256, 4)):
        near = P.likeness(P.fingerprint(F.col("a"), bins=bins, bits=bits), P.fingerprint(F.col("b"), bins=bins, bits=bits), bins, bits)
        off = df.select((near - F.col("truth")).alias("d")).agg(F.avg("d"), F.sqrt(F.avg(F.col("d") ** 2))).first()
        assert abs(off[0]) < 0.02 and off[1] < (0.1 if bits == 2 else 0.07), (bins, bits, off)


def edited(rows):
    """doc_id -> (n_chars, edited text, next text) by the contract's words; ids distinct."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = {}
    for i, (doc_id, text, *_) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        cut = len(text) // 4
        out[doc_id] = (len(text), text[:len(text) - cut] + after[:cut], after)
    return out


def check(got, rows):
    want = edited(rows)
    assert sorted(got, key=str) == sorted(want, key=str)
    for doc_id, (n, text, _) in want.items():
        r = got[doc_id]
        assert (r.n_chars, r.edited_text) == (n, text), doc_id
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if text == dict((x[0], x[1] or "") for x in rows)[doc_id]:
            assert r.near_edited == 1.0 and r.fingerprint == r.edited_fingerprint


def test_edits_with_odd_rows(spark):
    prepare(spark)
    long = "lorem ipsum dolor sit amet " * 40_000
    rows = [(5, "abc", "x"), (-3, None, "x"), (-2, " ", "x"), (9, "", "y"), (12, long, "y"), (13, "日本語のテキスト です 🙂🙂🙂🙂", "z"),
            (None, "no id at all, eight words are in here", None), (40, "abc", "x"), (41, long, "x"), (42, "a b", "x")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, tail string, n_chars int")
    got = {r.doc_id: r for r in P.compare_with_edits(docs.repartition(4)).collect()}
    check(got, rows)
    assert got[12].fingerprint == got[41].fingerprint and got[5].fingerprint == got[40].fingerprint
    assert got[-3].fingerprint == [] and got[-3].near_next == 1.0 and got[9].near_next == 0.0
    one = P.compare_with_edits(docs.where("doc_id = 13")).first()
    text, cut = rows[5][1], len(rows[5][1]) // 4
    assert one.edited_text == text[:-cut] + text[:cut] and one.near_next == 1.0


def test_repeated_rows_and_empty_table(spark):
    prepare(spark)
    rows = [(1, "one two three four five six")] * 50 + [(1, "one two")] + [(2, "x y z")] + [(None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = P.compare_with_edits(docs.repartition(3)).collect()
    assert len(got) == len(rows)
    assert len({(r.doc_id, r.edited_text) for r in got}) == 4
    assert P.compare_with_edits(docs.limit(0)).collect() == []
    assert P.fingerprints(docs.withColumn("Fingerprint", F.lit(1))).columns[-1] == "_fingerprint"


def test_query_reads_whole_table(spark):
    got = {r.doc_id: r for r in op13_fingerprint(spark, SF001).collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    for doc_id, (n, text, after) in edited(rows).items():
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(text.encode()).hexdigest())
    texts = dict(rows)
    share = [(got[d].near_edited, shingles_of(texts[d]), shingles_of(e)) for d, (_, e, _) in edited(rows).items()]
    off = [abs(x - (len(a & b) / len(a | b) if a | b else 1.0)) for x, a, b in share]
    assert sum(off) / len(off) < 0.05
    same = {}
    for d, t in rows:
        same.setdefault(t or "", set()).add(got[d].fingerprint)
    assert all(len(v) == 1 for v in same.values())


def test_plan_has_no_python(spark):
    plan = P.compare_with_edits(spark.read.parquet(f"{SF001}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "MapIn" not in plan
