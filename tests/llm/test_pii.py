import hashlib
import random
import re

from conftest import SF01
from pyspark.sql import functions as F

from scrubjay.llm import pii, queries
from scrubjay.llm.common import prepare


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    text = text or ""
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def expected(text):
    spans = base(text)
    digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
    return [sum(k == kind for k, _, _ in spans) for kind in pii.KINDS], digest


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    got = queries.op6_pii(spark, SF01).collect()
    assert len(got) == len(docs)
    for r in got:
        assert ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) == expected(docs[r.doc_id])
        assert {f"{k}:{a}:{b}" for k, a, b in base(docs[r.doc_id])} <= set(r.spans.split(","))


def test_patterns_against_python(spark):
    prepare(spark)
    rng = random.Random(6)
    bits = ["1", "23", "4", "255", "256", "007", ".", ".", "-", " ", " ", "+", "+1", "(", ")", "@", "a", "b.c", "x@y", "é", "日", "\n", "4111 1111 1111 1111",
            "4111111111111111", "5500-0000-0000-0004", "+1 (743) 555-3824", "152.143.123.131", "me@mail.example.com", "%", "_"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(2500)]
    texts += [None, "", "a@b.c.@d.e", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "1 " * 30, "+1 2345678" * 3, "@" * 50, "0255.1.1.1"]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, base string")
    got = df.select("doc_id", pii.spans_text(pii.base_spans(F.coalesce("text", F.lit("")))).alias("s")).collect()
    for r in got:
        assert r.s == ",".join(f"{k}:{a}:{b}" for k, a, b in base(texts[r.doc_id])), repr(texts[r.doc_id])


def test_long_texts(spark):
    prepare(spark)
    long = ["7" * 200_000, "1 " * 100_000, "a" * 200_000, "1." * 20_000, "a." * 100_000 + "@", "+" * 100_000, "+1" + " (" * 50_000, "a@b" + ".c" * 50_000]
    df = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.base] for r in pii.find(df).collect()}
    assert got[0] == got[1] == got[2] == got[4] == got[5] == got[6] == [] and got[7] == [(0, 0, 100_003)]
    assert len(got[3]) == len(base(long[3]))


def test_added_spans_and_redaction(spark):
    prepare(spark)
    rng = random.Random(1)
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    rows = [f"word phone: ({num(3)}) {num(3)}-{num(4)} word" for _ in range(80)] + [f"made {num(9)} units in {num(8)} cases" for _ in range(80)]
    rows += [f"reach +1 ({num(3)}) {num(3)}-{num(4)}" for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    out = {r.doc_id: r for r in pii.find(df).join(df, "doc_id").select("doc_id", "base", "spans", pii.redact(F.col("text"), F.col("spans")).alias("clean")).collect()}
    assert sum(len(out[i].spans) > 0 for i in range(80)) > 70 and not any(out[i].spans for i in range(80, 160))
    assert all(out[i].base == out[i].spans and out[i].clean == "reach [phone]" for i in range(160, 200))


def planted():
    """(text, kind and place of a span no base pattern knows, or None): no announcing words."""
    rng = random.Random(9)
    num = lambda n: "".join([rng.choice("23456789")] + [rng.choice("0123456789") for _ in range(n - 1)])
    word = lambda: "".join(rng.choice("abcdefghiklmnorstu") for _ in range(rng.randrange(2, 9)))
    part = lambda: str(rng.randrange(256))
    host = lambda: f"{word()}{rng.choice(['', '-' + word()])}.{rng.choice(['com', 'org', 'de', 'example.net'])}"
    mail = lambda: f"{word()}{rng.choice(['', '.' + word(), num(2)])}@{host()}"
    hidden = [lambda: ("email", _spelled(mail(), " at ", " dot ")),
              lambda: ("email", _spelled(mail(), "(at)", "(dot)")), lambda: ("email", _spelled(mail(), " [at] ", " [dot] ")),
              lambda: ("ip", " . ".join(part() for _ in range(4))), lambda: ("ip", "[.]".join(part() for _ in range(4))),
              lambda: ("phone", f"({num(3)}) {num(3)}-{num(4)}"), lambda: ("phone", f"{num(3)}-{num(3)}-{num(4)}"), lambda: ("phone", f"{num(3)}.{num(3)}.{num(4)}")]
    clean = [lambda: f"{word()} at {word()}. {word().title()}", lambda: num(rng.randrange(8, 13)), lambda: f"20{num(2)}-0{num(1)}-1{num(1)}",
             lambda: ", ".join(num(2) for _ in range(4)), lambda: f"{num(2)}.{num(3)}.{num(3)}", lambda: " . ".join("4" + num(2) for _ in range(4))]
    known = [lambda: mail(), lambda: ".".join(part() for _ in range(4)), lambda: f"+1 ({num(3)}) {num(3)}-{num(4)}", lambda: f"+44 {num(2)} {num(4)} {num(4)}"]
    rows = []
    for i in range(800):
        lead = " ".join(word() for _ in range(rng.randrange(1, 8))) + " "
        if i < 300:
            kind, span = rng.choice(hidden)()
            rows.append((lead + span + " " + word(), (kind, len(lead), len(lead) + len(span))))
        else:
            rows.append((lead + rng.choice(clean if i < 600 else known)() + " " + word(), None))
    return rows


def _spelled(address, at, dot):
    local, host = address.split("@")
    return local.replace(".", "_") + at + host.replace(".", dot)


def test_planted_spans_without_announcing_words(spark):
    """The trees must find what no base pattern knows; the answer is the same in any split."""
    prepare(spark)
    rows = planted()
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    answers = []
    for parts in (2, 7):
        got = pii.find(df.repartition(parts)).collect()
        answers.append({r.doc_id: {(pii.KINDS[s.kind], s.start, s.end) for s in r.spans if s not in r.base} for r in got})
    assert answers[0] == answers[1]
    added = {(i, *s) for i, spans in answers[0].items() for s in spans}
    truth = {(i, *span) for i, (_, span) in enumerate(rows) if span}
    hit = {a for a in added if any(a[0] == b[0] and a[1] == b[1] and a[2] < b[3] and b[2] < a[3] for b in truth)}
    print(len(truth), len(added), len(hit), sorted({rows[a[0]][0] for a in added - hit})[:9])
    assert len({a[0] for a in hit}) >= 0.8 * len(truth) and len(hit) >= 0.95 * len(added)


def test_empty(spark):
    prepare(spark)
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    plain = spark.createDataFrame([(1, "nothing here"), (1, "nothing here"), (None, None)], "doc_id long, text string")
    assert [len(r.spans) for r in pii.find(plain).collect()] == [0, 0, 0]


def test_every_base_span_is_learned_from(spark):
    """More spans than any sample held, some of them copies, one at the joint of two pieces."""
    prepare(spark)
    rows = [f"write to user{i % 350}@mail{i % 350}.example.com today" for i in range(400)] + ["word " * 900 + f"x{'y' * k} 10.1.2.{k} z" for k in range(40)]
    marked = pii._marked(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string"))
    known = pii._known(marked).collect()
    assert sum(r.n for r in known if r.kind == 0) == 400 and sum(r.n for r in known if r.kind == 1) == 40
    assert {(r.m, r.before) for r in known if r.kind == 0} == {(f"user{i}@mail{i}.example.com", "write to ") for i in range(350)}
    for r in known:
        if r.kind == 1:
            text = next(t for t in rows if f" {r.m} z" in t)
            at = text.index(r.m)
            assert r.before == text[at - 24:at] and r.around == text[at - 200:at] + "  z"
    seen = pii.examples(pii._known(marked)).where("kind = 0 and label = 1").agg(F.sum("n")).first()[0]
    assert seen >= 400
