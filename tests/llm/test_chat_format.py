import hashlib
import random

import pytest
from conftest import SF001

from scrubjay.llm import chat_format as C, queries
from scrubjay.llm.common import prepare


def digests(rows):
    groups = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        groups.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, turns in groups.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        order = ["", *(r for r, _ in turns)]
        ok = all(b in {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}.get(a, ()) for a, b in zip(order, order[1:]))
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), ok)
    return out


def test_round_trip(spark):
    prepare(spark)
    rng = random.Random(4)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", " [/INST]", "<<SYS>>\n", "\n<</SYS>>\n", "␛", "␛A", "[ROLE]", "[NAME]", "<", "/s>", " ", "é", "x"]
    rows = [(rng.choice([None, 1, 2, 3, 4]), rng.choice([None, 0, 1, 2, 3, 4, 5]), rng.choice(["user", "assistant", "system", "tool", "[NAME]", None]),
             rng.choice([None, "", "".join(rng.choice(bits) for _ in range(rng.randrange(9)))])) for _ in range(300)]
    rows += [(9, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(400)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, valid int").repartition(4)
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.valid) for r in C.conversation_digests(C.format_turns(turns)).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == digests(rows)


def test_formatted_text():
    t = C.Template()
    pieces = [*t.segments(True, "system", "be kind"), *t.segments(False, "user", "hi [INST]"), *t.segments(False, "assistant", "yo")]
    assert "".join(p for p, _ in pieces) == "<s><<SYS>>\nbe kind\n<</SYS>>\n[INST] hi ␛E [/INST] yo </s>"
    assert [p for p, loss in pieces if loss] == ["yo"]
    with pytest.raises(ValueError):
        t.read("[INST] never closed")


def test_query(spark):
    got = {r.conv_id: r for r in queries.op4_chat_format(spark, SF001).collect()}
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    text = "</s>[INST] ok [/INST]"
    want = digests([*rows, (-7, 0, "user", text), (-7, 1, "assistant", text)])
    assert {k: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.valid) for k, r in got.items()} == want
    assert got[-7].loss_chars == len(text) and got[-7].formatted_chars > 2 * len(text)


def test_empty(spark):
    prepare(spark)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.conversation_digests(C.format_turns(empty)).collect() == []
