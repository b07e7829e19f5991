"""Personal data by candidate gradient boosting (operator 6); DataFrame functions only.

*Base spans* follow fixed patterns per kind (leftmost, not overlapping; matches that fail
their check are dropped) and are always redacted.

*Candidates.*  Wider patterns propose spans that may overlap base spans and each other:
e-mail addresses spelled with "at" and "dot", numbers grouped like cards, phones or IP
addresses in other ways.  Boosted trees score them by format and context features.

*Training examples* are constructed, so that a label never comes from a feature.  Every base
span of the corpus (up to ``LONGEST`` code points) gives positives: the span rewritten in
formats the base patterns do not
know, after its own preceding text and after a neutral word of its surroundings.  Negatives
are look-alikes made beside the same spans: prose with "at", numbers that fail the card
check, lists, amounts, dates, counts, parts above 255.  A candidate of another kind over an
example is negative too.  Candidates found in the corpus are never learned from.  One span
in four, with all made from it, calibrates: each kind's threshold is the lowest score that
keeps ``PRECISION`` there.  Equal examples are counted, so the trees learn from rows of
distinct features with weights.  Candidates that reach it and overlap no base span are added.

Patterns use possessive or bounded repetition and start only at the beginning of a run,
so a text of any length is scanned in linear time with constant stack.

Offsets count code points, ends are exclusive.  Null texts are empty; rows that repeat
stay repeated; a kind without base spans in the corpus has no positives and adds nothing.
The result does not depend on how the rows are split.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrubjay.llm.common import written

KINDS = ("email", "ip", "card", "phone")
LONGEST = 128           # code points of a base span that examples are made from
PIECE = 4096            # code points of the pieces its surroundings are cut from
PRECISION = 0.98

# Fixed patterns.  Each is the plain pattern in its docstring form, made linear:
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   ip    [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+           (runs of 16 to 19 digits only)
#   phone \+[0-9][\x20().0-9-]+[0-9]
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){15,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?(?:@|\(at\)|\[at\]| at ) ?[a-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[a-z0-9-]{2,63}+){1,4}+",
    "ip": r"(?<![0-9.,])[0-9]{1,3}+(?:(?: ?(?:[.,·]|[(\[](?:\.|dot)[)\]]) ?| dot )[0-9]{1,3}+){3}+(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ .\x{a0}-]{0,2}+[0-9]){12,18}+(?![0-9])",
    "phone": r"(?<![0-9A-Za-z.-])\+?\(?[0-9](?:[ ().-]{0,2}+[0-9]){7,14}+(?![0-9A-Za-z])",
}
NEEDS = {"email": "(?i)@|\\bat\\b", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}
ANNOUNCE = {"email": r"(?i)(?:e-?mail|correo|courriel|contact)\W{0,3}$", "ip": r"(?i)\bip(?:v4)?(?: address)?\W{0,3}$",
            "card": r"(?i)(?:card|visa|mastercard|carte|karte|tarjeta)(?: (?:no|number))?\W{0,3}$",
            "phone": r"(?i)(?:phone|tel|telefon|téléphone|teléfono|call|fax|mobile)\W{0,3}$"}
SPAN = "array<struct<kind:int,start:int,end:int>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once (a lambda's argument is not repeated)."""
    return F.get(F.transform(F.array(value), body), 0)


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, b: a + b)


BLOCK = 256


def found(text: Column, pattern: str) -> Column:
    """array<struct(start, end, match, before)> of a pattern's matches.  The pieces between
    matches give the offsets: running totals over blocks of ``BLOCK`` matches, then within
    a block, so a text with very many matches costs no quadratic copying."""
    empty = F.expr("cast(array() as array<int>)")

    def sizes(s: Column) -> Column:
        steps = F.transform(s["matches"], lambda m, i: F.length(m) + F.length(F.get(s["pieces"], i)))
        return F.struct(s["pieces"].alias("pieces"), s["matches"].alias("matches"), steps.alias("steps"))

    def blocks(s: Column) -> Column:
        totals = F.transform(F.sequence(F.lit(0), F.floor(F.size(s["steps"]) / BLOCK).cast("int")),
                             lambda i: _total(F.slice(s["steps"], i * BLOCK + 1, F.lit(BLOCK))))
        begins = F.aggregate(totals, F.struct(F.lit(0).alias("at"), empty.alias("out")), lambda acc, t: F.struct(
            (acc["at"] + t).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.struct(s["pieces"].alias("pieces"), s["matches"].alias("matches"), s["steps"].alias("steps"), begins.alias("begins"))

    def rows(s: Column) -> Column:
        def row(m: Column, i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            piece = F.get(s["pieces"], i)
            start = F.get(s["begins"], block) + _total(F.slice(s["steps"], block * BLOCK + 1, i % BLOCK)) + F.length(piece)
            return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("match"), F.right(piece, F.lit(24)).alias("before"))
        return F.transform(s["matches"], row)

    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.struct(pieces.alias("pieces"), matches.alias("matches"))
    return _let(_let(_let(parts, sizes), blocks), rows)


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    def value(c: Column, i: Column) -> Column:
        digit = c.try_cast("int")
        return F.when(i % 2 == 0, digit).otherwise(digit * 2 - F.when(digit > 4, 9).otherwise(0))
    places = F.transform(F.split(F.reverse(number), ""), value)
    return F.coalesce(F.aggregate(places, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0, F.lit(False))


def small_parts(match: Column, separators: str = r"\.") -> Column:
    """Whether every number of a dotted match is at most 255 (leading zeros allowed)."""
    return F.forall(F.split(match, separators), lambda p: F.regexp_replace(p, "^ *0*+(?=[0-9])| +$", "").rlike(
        "^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _accepts(kind: str, match: Column) -> Column:
    if kind == "ip":
        return small_parts(match)
    if kind == "card":
        return luhn(digits(match))
    if kind == "phone":
        return F.length(digits(match)).between(8, 15)
    return F.lit(True)


def _acceptance(kind: str):
    return lambda m: _accepts(kind, m["match"])


def _span_of(place: int):
    return lambda m: F.struct(F.lit(place).alias("kind"), m["start"].alias("start"), m["end"].alias("end"))


def _guarded(text: Column, kind: str, spans: Column) -> Column:
    """Run a pattern only over texts that hold what it needs."""
    return F.when(text.rlike(NEEDS[kind]), spans)


def base_spans(text: Column) -> Column:
    """array<struct(kind, start, end)> in order of kind, then start."""
    parts = []
    for i, kind in enumerate(KINDS):
        kept = F.filter(found(text, BASE[kind]), _acceptance(kind))
        spans = F.transform(kept, _span_of(i))
        parts.append(F.coalesce(_guarded(text, kind, spans), F.expr(f"cast(array() as {SPAN})")))
    return F.concat(*parts)


def _features_of(i: int, kind: str):
    def row(m: Column) -> Column:
        match, before, number = m["match"], m["before"], digits(m["match"])
        size = F.length(match)
        n = F.length(number)
        share = lambda pattern: (size - F.length(F.regexp_replace(match, pattern, ""))).cast("double")
        flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
        group = lambda pattern: F.length(F.regexp_extract(match, pattern, 1)).cast("double")
        features = F.array(
            F.lit(float(i)), size.cast("double"), n.cast("double"), share("[A-Za-z]"), share("[ ]"), share("[.]"), share("[-]"),
            share("[,]"), share("[()\\[\\]]"), flag(match.startswith("+")), flag(match.contains("@")), flag(luhn(number) & n.between(13, 19)),
            flag(small_parts(match, "[^0-9]+")) if kind == "ip" else F.lit(0.0), flag(before.rlike(ANNOUNCE[kind])),
            flag(before.rlike("[A-Za-z,]\\W{0,2}$")), F.size(F.array_distinct(F.split(number, ""))).cast("double"), flag(match.startswith("0")),
            flag(match.rlike("(?i)[(\\[]at[)\\]]")), flag(match.rlike("(?i)[(\\[ ]dot[)\\] ]")), flag(match.rlike("[.] +[A-Z]")),
            F.size(F.regexp_extract_all(match, F.lit("[0-9]+"), F.lit(0))).cast("double"), group("^[^0-9]*([0-9]+)"), group("([0-9]+)$"),
            group("([A-Za-z]+)$"), flag(match.rlike("(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])")))
        return F.struct(F.lit(i).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), features.alias("f"))
    return row


def candidates(text: Column) -> Column:
    """array<struct(kind, start, end, f)>: proposed spans with features ``f``."""
    out = []
    for i, kind in enumerate(KINDS):
        rows = F.transform(found(text, WIDE[kind]), _features_of(i, kind))
        empty = F.expr("cast(array() as array<struct<kind:int,start:int,end:int,f:array<double>>>)")
        out.append(F.coalesce(_guarded(text, kind, rows), empty))
    return F.concat(*out)


# How a base span (m; its digits d, the national part n, a card's groups of four g) is
# rewritten, and what looks like it but is none (z: random digits, the first not 0; w: three
# words nearby; x: d with another last digit, q: the groups of that).
REWRITTEN = {
    "email": ("concat(l, ' at ', replace(h, '.', ' dot '))", "concat(l, ' (at) ', replace(h, '.', ' (dot) '))", "concat(l, '[at]', replace(h, '.', '[dot]'))",
              "concat(l, ' @ ', h)", "concat(l, ' at ', h)", "concat(l, '(at)', h)", "concat(l, ' [at] ', replace(h, '.', ' [dot] '))"),
    "ip": ("replace(m, '.', ' . ')", "replace(m, '.', '·')", "replace(m, '.', ' .')", "replace(m, '.', '. ')", "replace(m, '.', '[.]')", "replace(m, '.', ' dot ')",
           "replace(m, '.', '(dot)')"),
    "card": ("replace(g, ' ', '.')", "replace(g, ' ', '\u00a0')", "replace(g, ' ', '  ')", "replace(g, ' ', ' - ')", "replace(g, ' ', '--')"),
    "phone": ("concat('(', left(n, 3), ') ', substr(n, 4, 3), '-', substr(n, 7))", "concat_ws('-', left(n, 3), substr(n, 4, 3), substr(n, 7))",
              "concat_ws('.', left(n, 3), substr(n, 4, 3), substr(n, 7))", "concat_ws(' ', left(n, 3), substr(n, 4, 3), substr(n, 7))",
              "concat('(', left(n, 3), ')', substr(n, 4, 3), '-', substr(n, 7))", "concat_ws('-', '1', left(n, 3), substr(n, 4, 3), substr(n, 7))",
              "concat('0', left(n, 3), ' ', substr(n, 4))", "concat_ws(' ', '001', left(n, 3), substr(n, 4, 3), substr(n, 7))"),
}
LOOKALIKE = {
    "email": ("concat(w[0], ' at ', w[1], '. ', initcap(w[2]))", "concat(w[0], ' at ', lower(w[1]), '. ', w[2])", "concat(w[0], ' @ ', w[1], '. ', initcap(w[2]))",
              "concat(w[0], ' at ', substr(z, 1, 2), '.', substr(z, 3, 2))", "concat(w[0], ' at ', w[1], ' . ', initcap(w[2]))"),
    "ip": ("concat_ws(', ', substr(z, 1, 2), substr(z, 3, 2), substr(z, 5, 2), substr(z, 7, 2))", "concat_ws(',', substr(z, 1, 3), substr(z, 4, 3), substr(z, 7, 3), substr(z, 10, 3))",
           "concat_ws(' . ', substr(z, 1, 2), concat('7', substr(z, 3, 2)), substr(z, 5, 2), concat('4', substr(z, 7, 2)))",
           "concat_ws('. ', substr(z, 1, 2), concat('9', substr(z, 3, 2)), substr(z, 5, 2), substr(z, 7, 3))",
           "concat_ws('·', substr(z, 1, 2), concat('3', substr(z, 3, 2)), concat('6', substr(z, 5, 2)), substr(z, 7, 3))"),
    "card": ("x", "replace(q, ' ', '.')", "replace(q, ' ', '\u00a0')", "replace(q, ' ', '  ')", "q", "replace(q, ' ', '-')"),
    "phone": ("left(z, 8)", "left(z, 9)", "left(z, 10)", "left(z, 11)", "left(z, 13)", "concat_ws('-', concat('20', substr(z, 1, 2)), concat('0', substr(z, 3, 1)), concat('1', substr(z, 4, 1)))",
              "concat_ws('.', concat('1', substr(z, 3, 1)), concat('0', substr(z, 4, 1)), concat('19', substr(z, 1, 2)))",
              "concat_ws('.', substr(z, 1, 2), substr(z, 3, 3), substr(z, 6, 3))", "concat_ws(' ', left(z, 1), substr(z, 2, 3), substr(z, 5, 3), substr(z, 8, 3))",
              "concat('19', substr(z, 1, 2), '-', '20', substr(z, 3, 2))", "concat('20', substr(z, 1, 2), '-0', substr(z, 3, 1), '-1', substr(z, 4, 1), ' 1', substr(z, 5, 1))"),
}


def examples(known: DataFrame) -> DataFrame:
    """(kind, label, calibrates, f, n) made from base spans, equal ones counted: ``known`` has
    kind, m (the span), before (the text before it), around (text about it) and their count n."""
    rows = known.withColumnRenamed("n", "n_spans").withColumn("d", digits(F.col("m"))).selectExpr(
        "*", "substring_index(m, '@', 1) as l", "substring_index(m, '@', -1) as h", "right(d, 10) as n", "trim(regexp_replace(d, '(.{4})', '$1 ')) as g",
        "concat(left(d, length(d) - 1), pmod(try_cast(right(d, 1) as int) + 1, 10)) as x", "trim(regexp_replace(x, '(.{4})', '$1 ')) as q",
        "concat('4', translate(sha2(concat(m, around), 256), 'abcdef', '')) as z", "regexp_extract_all(around, '[A-Za-z]{2,12}', 0) as u",
        "if(size(u) < 3, array('word', 'and', 'other'), slice(u, 1 + cast(pmod(xxhash64(m, around), size(u) - 2) as int), 3)) as w",
        "pmod(xxhash64(m, before), 4) = 0 as calibrates").selectExpr("*", "concat(w[0], ' ') as neutral")

    def made(kind: str) -> str:
        parts = [f"struct({c} as ctx, {r} as r, 1.0D as label)" for r in REWRITTEN[kind] for c in ("before", "neutral")]
        return ", ".join(parts + [f"struct(neutral as ctx, {r} as r, 0.0D as label)" for r in LOOKALIKE[kind]])
    cases = " ".join(f"when {i} then array({made(kind)})" for i, kind in enumerate(KINDS))
    one = rows.select("kind", "calibrates", "n_spans", "w", F.explode(F.expr(f"case kind {cases} end")).alias("e")).select(
        "kind", "calibrates", "n_spans", F.col("e.label").alias("label"), F.length("e.ctx").alias("lo"), (F.length("e.ctx") + F.length("e.r")).alias("hi"),
        F.concat(F.col("e.ctx"), F.col("e.r"), F.lit(" "), F.col("w")[1]).alias("t"))
    hit = one.withColumn("c", F.explode(candidates(F.col("t")))).where("c.start < hi and lo < c.end")
    return hit.select(F.col("c.kind").alias("kind"), F.expr("if(c.kind = kind, label, 0.0D)").alias("label"), "calibrates", F.col("c.f").alias("f"), "n_spans") \
        .groupBy("kind", "label", "calibrates", "f").agg(F.sum("n_spans").alias("n"))


def _thresholds(scored: DataFrame) -> dict[int, float]:
    """Lowest score a kind may be accepted at; kinds that never reach ``PRECISION`` accept nothing."""
    out = {}
    # the trees have few leaves, so few scores
    rows = scored.groupBy("kind", "p", "label").agg(F.sum("n").alias("n")).orderBy("kind", F.desc("p"), "label").collect()
    for kind in range(len(KINDS)):
        right = total = 0
        own = [r for r in rows if r.kind == kind]
        for j, r in enumerate(own):
            right, total = right + int(r.label) * r.n, total + r.n
            if (j + 1 == len(own) or own[j + 1].p < r.p) and total >= 5 and right >= PRECISION * total:
                out[kind] = max(r.p, 0.5)
    return out


def _surroundings(text: Column, base: Column) -> Column:
    """array<struct(kind, m, before, around)> of the base spans.  They are cut from pieces of
    ``PIECE`` code points and what a span needs beyond, so a text with very many spans
    is not scanned to its end for each."""
    pieces = F.transform(F.sequence(F.lit(0), F.length(text), F.lit(PIECE)), lambda lo: F.substring(text, lo + 1, F.lit(PIECE + LONGEST + 400)))
    short = F.filter(base, lambda b: b["end"] - b["start"] <= LONGEST)

    def cut(part: Column, s: Column, b: Column) -> Column:
        e = s + b["end"] - b["start"]
        around = F.concat(F.substring(part, F.greatest(s - 199, F.lit(1)), F.least(s, F.lit(200))), F.lit(" "), F.substring(part, e + 1, F.lit(200)))
        return F.struct(b["kind"].alias("kind"), F.substring(part, s + 1, e - s).alias("m"),
                        F.substring(part, F.greatest(s - 23, F.lit(1)), F.least(s, F.lit(24))).alias("before"), around.alias("around"))

    def rows(held: Column) -> Column:
        def row(b: Column) -> Column:
            at = F.floor(F.greatest(b["start"] - 200, F.lit(0)) / PIECE).cast("int")
            return _let(F.get(held, at), lambda part: cut(part, b["start"] - at * PIECE, b))
        return F.transform(short, row)
    return F.when(F.size(short) > 0, _let(pieces, rows))


def _known(marked: DataFrame) -> DataFrame:
    """(kind, m, before, around, n) of all base spans of up to ``LONGEST`` code points."""
    return marked.where("known is not null").select(F.explode("known").alias("k")).groupBy("k").agg(F.count("*").alias("n")).select("k.*", "n")


def _marked(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, base spans, their surroundings (``known``), proposed spans, and a row number."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    spans = rows.select("doc_id", "text", base_spans(F.col("text")).alias("base"))
    return written(spans.select("doc_id", "base", _surroundings(F.col("text"), F.col("base")).alias("known"), candidates(F.col("text")).alias("proposed"))
                   .withColumn("row", F.monotonically_increasing_id()), "pii-spans")


def find(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, ``base`` and ``spans`` (base and added), both
    array<struct(kind, start, end)> in order of kind, then start."""
    marked = _marked(docs)
    known = written(_known(marked), "pii-known")
    # in one order and one piece (distinct features only), so that sums of doubles do not depend on the split
    made = examples(known.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    sample = written(made.repartition(1).sortWithinPartitions("kind", "label", "calibrates", "f").select(
        "kind", "label", "calibrates", F.col("n").cast("double").alias("n"), array_to_vector("f").alias("features")), "pii-examples")
    classes = {(r.calibrates, r.label) for r in sample.groupBy("calibrates", "label").count().collect()}
    added = None
    if {(False, 0.0), (False, 1.0), (True, 1.0)} <= classes:
        trees = GBTClassifier(maxIter=15, maxDepth=4, stepSize=0.2, seed=3, minInstancesPerNode=3, weightCol="n").fit(sample.where("not calibrates"))
        score = lambda df: trees.transform(df).withColumn("p", vector_to_array("probability")[1])
        limits = _thresholds(score(sample.where("calibrates")).select("kind", "label", "p", "n"))
        if limits:
            least = F.element_at(F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))]), F.col("kind"))
            free = marked.where(F.size("proposed") > 0).select("row", "base", F.explode("proposed").alias("c")).where(
                "not exists(base, b -> b.start < c.end and c.start < b.end)").select("row", "c.kind", "c.start", "c.end", array_to_vector("c.f").alias("features"))
            chosen = score(free).where(F.col("p") >= least)
            added = chosen.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    if added is None:
        return marked.select("doc_id", "base", F.col("base").alias("spans"))
    return marked.join(added, "row", "left").select(
        "doc_id", "base", F.array_sort(F.concat("base", F.coalesce("added", F.expr(f"cast(array() as {SPAN})")))).alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets; overlapping spans merge
    into the first."""
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        gap = F.when(inside, F.lit("")).otherwise(F.concat(
            F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.element_at(names, s["kind"] + 1), F.lit("]")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))
    return F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                       lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
