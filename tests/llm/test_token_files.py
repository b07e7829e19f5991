import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scrubjay.llm import token_files as T
from scrubjay.llm.common import prepare, scratch

JSON = "/opt/tokenizers/byte_bpe_50k.json"


def test_pack_random_access():
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = (rng.integers(0, 1 << 32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        r = T.Reader(T.pack(ids))
        assert r.n == n and (r.range(0, n) == ids).all()
        assert [r[i] for i in range(n)] == ids.tolist()
        for _ in range(20):
            a, b = sorted(rng.integers(0, n + 1, 2).tolist())
            assert (r.range(a, b) == ids[a:b]).all()
    with pytest.raises(IndexError):
        T.Reader(T.pack(np.zeros(3, np.uint32)))[3]


def test_round_trip(spark):
    from tokenizers import Tokenizer

    prepare(spark)
    texts = ["", None, "a", " lead", "trail ", "two  spaces", "line\nbreak \n x", "é 日本 ñ", "don't stop",
             "a\x00b c", "x <|endoftext|> y", "tab\t and\x85more", "word " * 5000 + "end", "same text", "same text"]
    rows = [(i * 7 % 31, t, "x") for i, t in enumerate(texts)] + [(None, "no id", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    path = scratch(spark, "t")
    T.write_token_files(docs.repartition(5), JSON, path)
    got = {r.doc_id: r for r in T.read_token_files(spark, path).collect()}
    t, start = Tokenizer.from_file(JSON), 0
    for doc_id, text in sorted(((d, x or "") for d, x, _ in rows), key=lambda r: (-1 if r[0] is None else r[0])):
        ids = t.encode(text, add_special_tokens=False).ids + [0]
        r = got[doc_id]
        assert (r.start, r.n_tokens, list(r.ids)) == (start, len(ids), ids), text
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    every = spark.range(start).select(F.col("id").alias("position"))
    flat = [x for _, r in sorted(got.items(), key=lambda kv: kv[1].start) for x in r.ids]
    assert [r.token for r in T.token_at(spark, path, every).orderBy("position").collect()] == flat


def test_empty(spark):
    prepare(spark)
    path = scratch(spark, "t")
    T.write_token_files(spark.createDataFrame([], "doc_id long, text string"), JSON, path)
    assert T.token_digests(spark, path).collect() == []


def test_pieces_encode_as_whole_texts(monkeypatch):
    """Pieces cut at spaces, line ends and signs give the ids of the whole text, are encoded
    once whatever sign follows them, and texts that are encoded whole are not kept."""
    from tokenizers import Tokenizer

    with open(JSON, encoding="utf-8") as f:
        encoder, t = T._Encoder(f.read()), Tokenizer.from_file(JSON)
    plain = ["word, word. word!! word", "word\nword, end", " ", "\n", "it's O'Neill's x'tyz 'quoted' ''s", "a.b@c-d.org 3.14,15 n°5 x²,",
             "été, élan. «oui» don’t", "日本。 ok, ", "a\u0301,b ,\u0301 _x_ $5%"]
    whole = ["two  spaces", "\n\n", "x \n y", "a\tb", "nbsp\u00a0x", "<|endoftext|> y", "thin\u2009x"]
    texts = [None, "", *plain, *whole, "", whole[0], *plain]
    for _ in range(2):
        got = [raw for some in encoder.encode(pa.array(texts).slice(1)) for raw in some]
        assert got == [np.array(t.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts[1:]]
        assert "word" in encoder.pieces and "word," not in encoder.pieces and not set(whole) & set(encoder.pieces)
    monkeypatch.setattr(T, "CACHE_PIECES", 3)
    list(encoder.encode(pa.array(["new one"])))
    assert set(encoder.pieces) == {" ", "\n", "new", " one"}
    assert list(encoder.encode(pa.array([], pa.string()))) == [] and list(encoder.encode(pa.array(["", None], pa.string()))) == [[b"", b""]]
