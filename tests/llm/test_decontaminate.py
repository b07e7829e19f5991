import random
import re
from collections import defaultdict

from conftest import SF001

import corpus_pipeline
from scrubjay.llm import decontaminate as D, queries
from scrubjay.llm.common import prepare


def canonical(text):
    """Plain version: [(placeholder or word, value)]."""
    out = []
    raw = [(m.start(), m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
    for i, (at, word) in enumerate(raw):
        body = re.sub(r"^[!-/:-@\[-`{-~\x00-\x1f\x7f]+|[!-/:-@\[-`{-~\x00-\x1f\x7f]+$", "", word)
        if not body:
            continue
        value = "".join(c.lower() if c.isascii() else c for c in body)
        stop = i == 0 or not out or raw[i - 1][1][-1] in ".?!:;\"'()[]" or "\n" in text[raw[i - 1][0] + len(raw[i - 1][1]):at] or word[0] != body[0]
        if re.search("[0-9]", body):
            out.append(("NUM", value))
        elif value in D.UNITS:
            out.append(("UNIT", value))
        elif (("A" <= body[0] <= "Z") or ("À" <= body[0] <= "Þ")) and not stop:
            out.append(("NAME", value))
        else:
            out.append((value, None))
    return out


def windows(text, k=8, plain=5):
    t = canonical(text)
    for i in range(len(t) - k + 1):
        w = t[i:i + k]
        if sum(v is None for _, v in w) >= plain:
            yield i, tuple(c for c, _ in w), [v for _, v in w if v is not None]


def verbatim(text, k=8):
    body = [v or c for c, v in canonical((text or "").casefold())]
    for i in range(len(body) - k + 1):
        yield i, tuple(body[i:i + k])


def stretch(hits, k):
    """Places of the consecutive hits that cover most, among consistent ones."""
    hits, best, most = sorted(hits), [], 0
    for hi in range(1, len(hits) + 1):
        for lo in range(hi):
            seen = defaultdict(set)
            for _, pairs in hits[lo:hi]:
                for a, b in pairs:
                    seen[a].add(b)
            if all(len(v) == 1 for v in seen.values()):
                places = [j for j, _ in hits[lo:hi]]
                size = len({q for j in places for q in range(j, j + k)})
                if size > most:
                    most, best = size, places
                break
    return best


def brute(docs, items, run=13):
    index, plainly, lengths = defaultdict(list), defaultdict(list), {8}
    for item, text in items:
        if item is not None and canonical(text):
            k = min(8, len(canonical(text)))
            lengths.add(k)
            for i, key, slots in windows(text, k):
                index[key].append((item, text, i, slots))
            for i, key in verbatim(text, k):
                plainly[key].append((item, text, i))
    out = []
    for doc, text in docs:
        lines, cover, more = defaultdict(list), defaultdict(set), defaultdict(set)
        for k in lengths:
            for i, key, slots in windows(text, k):
                for item, body, j, theirs in index[key]:
                    lines[item, body, i - j, k].append((j, list(zip(theirs, slots))))
            for i, key in verbatim(text, k):
                for item, body, j in plainly[key]:
                    more[item, body].update(range(j, j + k))
        for (item, body, _, k), hits in lines.items():
            seen = defaultdict(set)
            for _, pairs in hits:
                for a, b in pairs:
                    seen[a].add(b)
            if all(len(v) == 1 for v in seen.values()):
                for j, _ in hits:
                    cover[item, body].update(range(j, j + k))
                    more[item, body].update(range(j, j + k))
            else:
                for j in stretch(hits, k):
                    more[item, body].update(range(j, j + k))
        found = {}
        for (item, body), places in more.items():
            enough = min(run, len(canonical(body)))
            if len(places) >= enough:
                size = len(cover[item, body]) if len(cover[item, body]) >= enough else len(places)
                found[item] = max(found.get(item, 0), size)
        best = min(found, key=lambda i: (-found[i], i)) if found else None
        out.append((doc is not None, doc or 0, bool(found), len(found), best, found.get(best, 0)))
    return sorted(out, key=repr)


def got(spark, docs, items):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, version string, id int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    return d, b, sorted(((r.doc_id is not None, r.doc_id or 0, r.contaminated, r["items"], r.item_id, r.covered) for r in D.report(d, b).collect()), key=repr)


def test_against_brute_force(spark):
    prepare(spark)
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice(["x", "é", "yz"])
    def sentence(n):
        return [rng.choice([word, word, word, word, lambda: str(rng.randrange(50)), lambda: rng.choice(["km", "Euros", "hours"]),
                            lambda: word().capitalize(), lambda: word() + "."])() for _ in range(n)]
    items = [(i, " ".join(sentence(rng.randrange(3, 40)))) for i in range(25)] + [(3, "same words again " * 6), (None, " ".join(sentence(20))), (90, None), (91, "")]
    docs = []
    for i in range(90):
        t = sentence(rng.randrange(0, 40))
        _, body = rng.choice(items)
        body = (body or "").split()
        kind = rng.randrange(4)
        swap = {}
        if kind:
            body = [(swap.setdefault(w, str(rng.randrange(900))) if kind == 1 else str(rng.randrange(900))) if re.fullmatch(r"\d+", w) else w for w in body]
        if kind == 3:
            body = body[rng.randrange(1 + len(body) // 2):]
        docs.append((i, " ".join(t + body + sentence(5))))
    docs += [(200, None), (201, ""), (None, docs[0][1]), (5, docs[6][1])]
    d, b, rows = got(spark, docs, items)
    assert rows == brute(docs, items) and any(r[2] for r in rows) and not all(r[2] for r in rows)
    left = D.drop_contaminated(d, b)
    assert left.columns == d.columns and left.count() == sum(not r[2] for r in rows)


def test_reparameterised_question(spark):
    prepare(spark)
    item = "A train leaves Boston at 40 km per hour and after 3 hours it has gone 120 miles in total so how far is it from home then"
    same = item.replace("40", "55").replace("Boston", "Madrid").replace("120", "165")
    odd = "A man walks 5 km each day and 5 km each night so how many km is it in all for him over the week"
    docs = [(1, "Intro words here. " + item), (2, same), (3, odd.replace("5 km each day", "6 km each day")), (4, odd.replace("5 km", "7 km"))]
    _, _, rows = got(spark, docs, [(1, item), (2, odd)])
    assert [(r[1], r[2]) for r in sorted(rows, key=lambda r: r[1])][:2] == [(1, True), (2, True)]
    assert rows == brute(docs, [(1, item), (2, odd)])


def test_query_and_empty(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").select("item_id", "text").collect()]
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.contaminated, r["items"], r.item_id, r.covered) for r in queries.op7_decontaminate(spark, SF001).collect()), key=repr)
    assert rows == brute(docs, items)
    assert got(spark, [], [(1, "a b c")])[2] == [] and got(spark, [(1, "a b c")], [])[2] == [(True, 1, False, 0, None, 0)]


def test_short_items(spark, tmp_dir):
    """Items of one to seven tokens are found where they stand whole, and only there."""
    prepare(spark)
    items = [(1, "quick brown fox"), (2, "zanzibar"), (3, "please add these many small numbers 7"), (4, "42 km"), (5, "...")]
    docs = [(1, "the Quick, brown FOX ran"), (2, "quick brown dog and fox"), (3, "to Zanzibar!"), (4, "fox"), (5, "quick brown fox"),
            (6, "now please add these many small numbers 9 or so"), (7, "it is 42 km far"), (8, "it is 43 km far"), (9, None), (10, "...")]
    found = query(spark, tmp_dir, docs, items)
    assert {d for d, bad in found.items() if bad} == {1, 3, 5, 6, 7}
    assert got(spark, docs, items)[2] == brute(docs, items)


def query(spark, tmp_dir, docs, items):
    """{doc_id: contaminated} of the query, which the pipeline's stage must agree with."""
    d, b, _ = got(spark, docs, items)
    d.write.parquet(f"{tmp_dir}/documents.parquet")
    b.write.parquet(f"{tmp_dir}/benchmark.parquet")
    found = {r.doc_id: r.contaminated for r in queries.op7_decontaminate(spark, tmp_dir).collect()}
    assert {r.doc_id for r in corpus_pipeline.drop_benchmark(spark, d, tmp_dir).collect()} == {i for i, bad in found.items() if not bad}
    return found


def test_verbatim_copies(spark, tmp_dir):
    """Copies in capitals, title case, other scripts, or full of names and units."""
    prepare(spark)
    items = ["which of the following planets turns slowest about its axis and why does it do so",
             "Die Straße führt über Österreich nach Ägypten und Österreich grüßt die Ärzte der schönen Übung",
             "где находится самая высокая гора в мире и кто первым поднялся на её вершину",
             "Paris London Rome Berlin Madrid Vienna Prague Oslo Dublin Athens Warsaw Lisbon Bern Riga",
             "a man in t s l c m k a in t s l c m k"]
    docs = [(10 * i + j, f"so here it says {change(t)} as we saw") for i, t in enumerate(items) for j, change in enumerate((str, str.upper, str.lower, str.title))]
    docs += [(100, "so here it says " + " ".join(items[0].upper().split()[:12]) + " as we saw"), (101, None), (102, "nothing of the kind")]
    assert query(spark, tmp_dir, docs, list(enumerate(items))) == {d: d < 100 for d, _ in docs}


def test_clash_cuts_an_alignment(spark, tmp_dir):
    """One value changed otherwise than before leaves the consistent stretch beside it."""
    prepare(spark)
    item = ("take 5 red apples from the box and put 7 green pears beside them then give 5 of those to your friend who has 11 already "
            "and count how many there are after 13 more have been added by the aunt")
    once = item.replace("5 red", "9 red")
    edited = once.replace("7", "70").replace("5 of", "50 of").replace("11", "110").replace("13", "130")
    alternating = " ".join(("x y z 5 " * 10).split())
    docs = [(1, once), (2, edited), (3, "well " + edited + " indeed"), (4, " ".join(f"x y z {i}" for i in range(10))), (5, item)]
    assert query(spark, tmp_dir, docs, [(1, item), (2, alternating)]) == {1: True, 2: True, 3: True, 4: False, 5: True}


def test_longest_consistent_stretch():
    rng = random.Random(4)

    def consistent(hits):
        seen = defaultdict(set)
        for h in hits:
            for s in h["slots"]:
                seen[s["item_slots"]].add(s["slots"])
        return all(len(v) == 1 for v in seen.values())
    for _ in range(300):
        hits = [{"item_place": p, "slots": [{"item_slots": rng.randrange(4), "slots": rng.randrange(2)} for _ in range(rng.randrange(3))]}
                for p in sorted(rng.sample(range(40), rng.randrange(1, 12)))]
        runs = [hits[a:b] for a in range(len(hits)) for b in range(a + 1, len(hits) + 1)]
        most = max((len({q for h in r for q in range(h["item_place"], h["item_place"] + 8)}) for r in runs if consistent(r)), default=0)
        kept = D._stretch(rng.sample(hits, len(hits)), 8)
        assert consistent([h for h in hits if h["item_place"] in kept]) and len({q for p in kept for q in range(p, p + 8)}) == most
