import re

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SF001, obs_frame
from spec_oracle import normalize
from scrubjay.functions import text as T
from scrubjay.functions.regex import portable_regex
from scrubjay import sql_twins as Q

EDGE_TEXTS = [
    "Task #12 done 2024-01-02 10:00:00",
    "task #99 done 2025-03-04 11:11:11",
    "ID: 7 ok",
    "a - b",
    "!!!",
    "???",
    "Sincronización automática cada 5 min",
    "SINCRONIZACIÓN AUTOMÁTICA CADA 5 MIN",
    "Café au lait",
    "non breaking space",
    "sep\x1cchars\x1dhere",
    "  padded\t\n",
    "under_score and déjà-vu, naïve!",
    "",
    "٣٤٥٦-١٢-١٢ arabic digits",
]


def test_portable_regex_classes():
    assert portable_regex(r"\d+") == r"\p{Nd}+"
    assert portable_regex(r"[^\w\s]") == r"[^\p{L}\p{N}_\t-\r\x1c-\x20\x85\p{Z}]"
    assert portable_regex(r"a\.b\s*") == r"a\.b[\t-\r\x1c-\x20\x85\p{Z}]*"
    with pytest.raises(ValueError):
        portable_regex(r"[\W]")


def test_normalize_matches_python_rules(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(EDGE_TEXTS)], "id long, t string")
    got = {r.id: r.n for r in df.select("id", T.normalize_text("t").alias("n")).collect()}
    for i, t in enumerate(EDGE_TEXTS):
        assert got[i] == normalize(t), (t, got[i], normalize(t))
    # the documented quirks
    assert got[0] == got[1] == "task done"
    assert got[2] == "id 7 ok"
    assert got[3] == "a  b"
    assert got[4] == got[5] == ""


def test_normalize_whole_tables_match_python(spark):
    for table, col in (("documents", "text"), ("conversations", "text")):
        df = spark.read.parquet(f"{SF001}/{table}.parquet")
        rows = df.select(col, T.normalize_text(col).alias("n")).collect()
        assert rows
        for r in rows:
            if r[col] is not None:
                assert r.n == normalize(r[col])


def test_normalize_duckdb_twin_agrees():
    con = duckdb.connect()
    for t in EDGE_TEXTS:
        got = con.execute(f"SELECT {Q.normalize('x')} FROM (SELECT ? AS x)", [t]).fetchall()[0][0]
        assert got == normalize(t), t


def test_checkpoint_flag_and_signature(spark):
    texts = [
        "CHECKPOINT Mon Jan 01 00:00:07 UTC 2024: auto-sync",
        "checkpoint tue feb 02 10:11:12 utc 2024:   AUTO-SYNC extra",
        "SINCRONIZACIÓN AUTOMÁTICA CADA 5 MIN",
        "auto-sync - Sincronización automática del repositorio principal, vuelta 3",
        "SYNC: 2024-01-01 00:06:29",
        "Checkpoint 17 completed",
        "Auto-save at 2024-05-05",
        "just a note",
        None,
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    rows = {r.id: r for r in df.select("id", T.is_checkpoint("t").alias("f"),
                                       T.masked_checkpoint("t").alias("m")).collect()}
    pats = T.CHECKPOINT_PATTERNS
    for i, t in enumerate(texts):
        want = t is not None and any(re.search(p, t, re.IGNORECASE) for p in pats)
        assert rows[i].f == want, t
        if t is not None:
            m = t
            for p, r in T.SIGNATURE_MASKS:
                m = re.sub(p, r, m)
            assert rows[i].m == m, t
    assert rows[0].m == "CHECKPOINT TIMESTAMP: auto-sync"
    assert rows[4].m == "SYNC: DATETIME"
    assert rows[5].m == "Checkpoint NUM completed"


def test_monitor_like_is_case_sensitive(spark):
    df = obs_frame(spark, [(1, "Checkpoint 1 completed", None), (2, "CHECKPOINT x", None),
                           (3, "x auto-sync", None), (4, "a checkpoint", None)])
    got = {r.id: r.f for r in df.select("id", T.monitor_checkpoint_like("content").alias("f")).collect()}
    assert got == {1: False, 2: True, 3: True, 4: True}


def test_markers(spark):
    df = spark.createDataFrame([(7, 3)], "k long, g long")
    r = df.select(T.keep_latest_marker("k").alias("a"), T.merged_into_marker("k").alias("b"),
                  T.group_marker("g").alias("c")).collect()[0]
    assert (r.a, r.b, r.c) == (" [DUPLICATE - KEPT ID: 7]", " [MERGED INTO ID: 7]", " [DUPLICATE GROUP: 3]")
    assert T.CONSOLIDATED_MARKER == " [CONSOLIDATED]"
    assert F.col("k") is not None
