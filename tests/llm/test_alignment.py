import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from scrubjay.llm import alignment as A
from scrubjay.llm.common import prepare
from scrubjay.llm.queries import op11_alignment

SF001 = "/root/testdata/sf0.001"
JSON, MODEL = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def plain():
    """text -> (ids of A, ids of B, groups) by whole-text encoding and dictionaries, or None."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    a.encode_special_tokens = True
    names, alphabet = {i: t for t, i in a.get_vocab().items()}, A.byte_alphabet()

    def bytes_a(i):
        return bytes(alphabet[c] for c in names[i])

    def bytes_b(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def run(text):
        if not text:
            return None
        ids_a, ids_b, whole = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text), (" " + text).encode()
        parts_a, parts_b = [bytes_a(i) for i in ids_a], [bytes_b(i) for i in ids_b]
        if b"".join(parts_a) != whole or b"".join(parts_b) != whole:
            return None
        ends = []
        for parts in (parts_a, parts_b):
            at, index = 0, {}
            for i, p in enumerate(parts):
                at += len(p)
                index[at] = i
            ends.append(index)
        groups, i, j = [], 0, 0
        for end in sorted(ends[0].keys() & ends[1].keys()):
            groups.append((ids_a[i:ends[0][end] + 1], ids_b[j:ends[1][end] + 1]))
            i, j = ends[0][end] + 1, ends[1][end] + 1
        return ids_a, ids_b, groups
    return run


def groups_text(groups):
    return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


def want(plain, rows):
    """Rows of the query by its words."""
    done = [(doc_id, plain(text)) for doc_id, text in rows]
    counts = Counter((x[-1], y[-1]) for _, r in done if r for x, y in r[2])
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    out = []
    for doc_id, r in done:
        if r is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(x[-1], y[-1]) for x, y in r[2]]
        out.append((doc_id, len(r[0]), len(r[1]), len(r[2]), len(links), sum(counts[p] == most[p[1]] for p in links),
                    sum(counts[p] for p in links), hashlib.sha256(groups_text(r[2]).encode()).hexdigest()))
    return out


def odd_texts():
    rng = random.Random(4)
    chars = list("abcdeXYZ0189.,;'\"-_/()") + [" "] * 8 + ["\n", "\t", "\r", "  ", "é", "ß", "ﬁ", "日本", "🙂", " ", "　", " ",
                                                            "́", "\x00", "<|endoftext|>", "</s>", "<0x0A>", "'s", "don't", "​"]
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(1, 60))) for _ in range(1500)]
    return texts + ["", None, " ", "  ", "\n", "a", " a", "a ", "▁", "x ▁y", "<|endoftext|>", "<s> a </s>", "word " * 3000, "word word"]


def test_every_text_equals_whole_encoding(spark, plain):
    prepare(spark)
    rows = list(enumerate(odd_texts()))
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, links string")
    got = {r.doc_id: r for r in A.align_texts(docs.repartition(3), JSON, MODEL, groups=True).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        r, p = got[doc_id], plain(text)
        if p is None:
            assert (r.n_a, r.n_b, r.n_groups, r.groups_sha256, r.links, r.groups) == (0, 0, 0, "", [], ""), text
        else:
            assert (r.n_a, r.n_b) == (len(p[0]), len(p[1])), text
            assert r.groups == groups_text(p[2]), text
            assert [(x // 32000, x % 32000) for x in r.links] == [(x[-1], y[-1]) for x, y in p[2]]
            assert A.groups_of(r.groups) == p[2]
    assert sum(plain(t) is None for _, t in rows) == 4


@pytest.mark.parametrize("bound", [A.BROADCAST_PAIRS, 0])
def test_counts_with_repeats_broadcast_or_joined(spark, plain, bound):
    prepare(spark)
    rng = random.Random(9)
    words = ["alpha", "beta", "antidisestablishment", "Zürich", "x1", "...", "naïve"]
    rows = [(i % 40, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))) for i in range(60)]
    rows += [(None, "alpha beta"), (7, None)] + [(100 + i, "the same text, again") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = A.link_strengths(docs.repartition(4), JSON, MODEL, broadcast_pairs=bound).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want(plain, rows), key=key)


def test_very_long_text_and_empty_table(spark, plain):
    prepare(spark)
    text = "Periods, commas; and so on.\nNext line " * 20_000
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    got = {r.doc_id: tuple(r) for r in A.link_strengths(docs, JSON, MODEL).collect()}
    assert got == {r[0]: r for r in want(plain, [(1, text), (2, "short")])}
    assert A.link_strengths(docs.limit(0), JSON, MODEL).collect() == []


def test_decimal_rows():
    d = A._Decimal(12345)
    for i in (0, 7, 9, 10, 99, 100, 999, 1000, 12344):
        assert bytes(d.rows[i][:d.size[i]]).decode() == str(i) and not d.rows[i][d.size[i]:].any()
    assert np.array_equal(d.size, [len(str(i)) for i in range(12345)])


def test_query_equals_plain_version(spark, plain):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    assert sorted(map(tuple, op11_alignment(spark, SF001).collect())) == sorted(want(plain, rows))
