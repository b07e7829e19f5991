import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from scrubjay.llm import periodic_runs as R
from scrubjay.llm.common import prepare
from scrubjay.llm.queries import op12_periodic_runs

SF001 = "/root/testdata/sf0.001"


def plain_runs(x):
    """(start, length, period): every stretch of equal words q apart, smallest period first."""
    n, out = len(x), []
    x = list(x)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            a = i
            while i + q < n and x[i] == x[i + q]:
                i += 1
            length = i - a + q
            part = x[a:a + length]
            if length >= max(12, 2 * q) and not any(part[:-p] == part[p:] for p in range(1, q)):
                out.append((a, length, q))
    return sorted(out)


def random_words(rng):
    kind, n = rng.randrange(6), rng.randrange(0, 160)
    if kind == 0:
        return [rng.randrange(2) for _ in range(n)]
    if kind == 1:
        return [rng.randrange(30) for _ in range(n)]
    out = []
    while len(out) < n:
        unit = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.choice([1, 2, 3, 5, 6, 7, 8, 13, 14, 15, 30, 31, 40]))]
        out += (unit * rng.randrange(1, 7))[:rng.randrange(1, 60)]
        out += [rng.randrange(50) for _ in range(rng.choice([0, 0, 1, 5]))]
    if kind == 5 and out:
        out[rng.randrange(len(out))] = 99
    return out


def test_transform_is_exact():
    rng = np.random.default_rng(2)
    for n in (2, 8, 64):
        x = rng.integers(0, R.PRIME, (3, n), dtype=np.uint64)
        w = pow(R.ROOT, (R.PRIME - 1) // n, R.PRIME)
        want = [[sum(int(v) * pow(w, k * j, R.PRIME) for j, v in enumerate(row)) % R.PRIME for k in range(n)] for row in x]
        assert R.transform(x).tolist() == want
        back = R.transform(R.transform(x), inverse=True) * np.uint64(pow(n, -1, R.PRIME)) % np.uint64(R.PRIME)
        assert (back == x).all()


def test_mismatches_are_sums_of_squares():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 40, 100)
    for size, low, high in ((2, 1, 6), (4, 7, 14), (8, 15, 30)):
        starts = np.arange(0, 100 // size * size, size)
        got = R.mismatches(codes, starts, size, low, high)
        padded = np.concatenate([codes, np.zeros(100, int)])
        for s, row in zip(starts, got):
            assert row.tolist() == [int(((padded[s:s + size] - padded[s + d:s + d + size]) ** 2).sum()) for d in range(low, high + 1)]


def test_runs_equal_plain_version():
    rng = random.Random(7)
    for _ in range(1500):
        x = random_words(rng)
        assert R.runs(np.array(x, np.int64), len(x)) == plain_runs(x), x


def test_false_zeros_do_no_harm():
    # squares that vanish modulo the prime but not as integers
    a, b = next((a, R.PRIME - a * a % R.PRIME) for a in range(70000, 80000))
    root = next((c for c in range(1, 1 << 17) if (c * c) % R.PRIME == b), None)
    x = [5, 5 + a] * 3 + [5 + a, 5] + list(range(100, 140)) + [7] * 15
    if root:
        x += [0, 0, a, root] * 5
    assert R.runs(np.array(x, np.int64), len(x)) == plain_runs(x)
    assert R._walk(np.array([1, 2, 3, 4]), 0, 2, 2) == (0, 0)
    assert R._walk(np.array([9, 1, 2, 1, 2, 1, 8]), 2, 4, 2) == (1, 4)


def test_documents_of_a_slice_do_not_touch():
    rng = random.Random(11)
    docs = [[b"w%d" % w for w in random_words(rng)] for _ in range(300)]
    docs += [[b"a"] * 40, [b"a"] * 40, [], [b"a"] * 11]
    for words, found in zip(docs, R._document_runs(docs)):
        assert found == plain_runs(words)


def test_long_repetitive_text_is_linear_in_blocks(monkeypatch):
    blocks = []
    plain = R.mismatches
    monkeypatch.setattr(R, "mismatches", lambda c, s, *a: blocks.append(len(s) * 4 * a[0]) or plain(c, s, *a))
    x = np.zeros(50_000, np.int64)
    x[30_000:] = np.arange(20_000) % 700 + 1
    assert R.runs(x, len(x)) == [(0, 30_000, 1), (30_000, 20_000, 700)]
    assert sum(blocks) < 40 * len(x)


def planted(words, doc_id):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    a = (h // 10) % n
    p = 1 + (n - a) // (3 + (h // 10) % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def digests(doc_id, text, plant=True):
    words = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    words = planted(words, doc_id) if plant and doc_id is not None else words
    found = plain_runs(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(found, key=lambda r: (r[0], r[2])))
    return (doc_id, len(found), *best, best[1] * 1000 // best[2] if found else None, sha(lines),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_odd_rows(spark):
    prepare(spark)
    long = "la " * 30_000 + "end " + "x y " * 20_000
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a " * 11), (5, "a " * 12), (6, "é ü x " * 9), (None, "b c " * 6), (7, "same " * 20),
            (7, "same " * 20), (8, "one\x0btwo\x0c" * 7)]
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows + [(9, long)]], "doc_id long, text string, start int, runs string")
    got = R.run_digests(docs.repartition(3), planted=False).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got if r.doc_id != 9), key=key) == sorted((digests(*r, plant=False) for r in rows), key=key)
    full = {r.doc_id: r for r in R.find_runs(docs).collect()}
    assert [tuple(r) for r in full[9].runs] == [(0, 30_000, 1), (30_001, 40_000, 2)] and full[9].collapsed == "la end x y"
    assert full[1].runs == [] and full[1].collapsed == ""
    assert R.run_digests(docs.limit(0)).collect() == [] and R.find_runs(docs.limit(0)).collect() == []


def test_query_equals_plain_version(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in op12_periodic_runs(spark, SF001).collect()}
    assert len(got) == len(docs)
    short = [r for r in docs if len(r.text or "") < 6000]
    for r in short:
        assert got[r.doc_id] == digests(r.doc_id, r.text), r.doc_id
    assert sum(got[r.doc_id][1] > 0 for r in short) > 10
