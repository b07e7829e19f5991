import numpy as np
from conftest import SF001
from pyspark.sql import functions as F

import corpus_pipeline as P
from scrubjay.llm.common import table, written
from test_decontaminate import brute as contaminated
from test_ngram_join import brute as components


def test_stages_against_brute_force(spark):
    docs = table(spark, SF001, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = docs
    out = {}
    for name, stage in P.STAGES:
        result = written(stage(spark, kept, SF001), f"test-{name}")
        if name != "token_files":
            assert result.columns == docs.columns
            out[name] = sorted(r.doc_id for r in result.select("doc_id").collect())
            before = kept
            kept = result
        else:
            out[name] = result.collect()
    assert set(out["toxicity"]) <= set(texts) and len(out["toxicity"]) > 0.6 * len(texts)
    left = [(d, texts[d]) for d in out["toxicity"]]
    assert out["near_duplicates"] == sorted(d for d, (_, c) in components(left).items() if d == c)
    left = [(d, texts[d]) for d in out["near_duplicates"]]
    items = [tuple(r) for r in table(spark, SF001, "benchmark").select("item_id", "text").collect()]
    assert out["decontamination"] == sorted(r[1] for r in contaminated(left, items) if not r[2])
    assert set(out["mixing"]) <= set(out["decontamination"]) and before.columns == docs.columns
    assert sorted(r.doc_id for r in out["token_files"]) == out["mixing"]
    ordered = sorted(out["token_files"], key=lambda r: r.start)
    assert [r.start for r in ordered] == np.concatenate(([0], np.cumsum([r.n_tokens for r in ordered])))[:-1].tolist()


def test_odd_rows_pass_every_stage(spark):
    odd = spark.createDataFrame([(1, None, "en", "s", 0, "x"), (None, "some text here", None, None, None, "y"), (2, "", "en", "s", 0, "x"),
                                 (3, "a b c d e f", "en", "s", 11, "x"), (3, "a b c d e f", "en", "s", 11, "x"), (4, "A b c d e f", "en", None, 11, "x")],
                                "doc_id long, text string, lang string, source string, n_chars long, _first string")
    for docs in (odd, odd.limit(0)):
        for name, stage in P.STAGES:
            docs = written(stage(spark, docs, SF001), f"test-{name}")
            if name != "token_files":
                assert docs.columns == odd.columns
        assert docs.where(F.col("doc_id") == 4).count() == 0


def test_registered():
    import __spark_entry__ as entry

    names = list(entry.queries())
    assert [n for n in names if n.startswith("op")] == sorted((n for n in names if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    assert "pipeline" in names and [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_files"]
