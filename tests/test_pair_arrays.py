"""Distances and ratios of many pairs against difflib and the plain dynamic program."""

import random
import time
from difflib import SequenceMatcher

import numpy as np

from scrubjay.config import Weights
from scrubjay.functions import pair_arrays as P
from scrubjay.functions.similarity import levenshtein_distance, pair_scores
from spec_oracle import lev_dp

ALPHABETS = ["ab", "abcdefghij klmno", "abcdefghijklmnopqrstuvwxyz éß0123456789 ", " " + "".join(chr(0x4E00 + i) for i in range(400)),
             "a\U0001F600\ud800b c"]


def _edited(rng, text, edits, letters):
    t = list(text)
    for _ in range(edits):
        kind, at = rng.random(), rng.randrange(len(t) + 1)
        if kind < 0.3:
            t[at:at + 1] = []
        elif kind < 0.6:
            t.insert(at, rng.choice(letters))
        elif kind < 0.9:
            t[at:at + 1] = [rng.choice(letters)]
        else:
            other = rng.randrange(len(t) + 1)
            t[at:at] = t[min(at, other):max(at, other)][:40]
    return "".join(t)


def _pairs(seed, count, sizes):
    rng, out = random.Random(seed), []
    for _ in range(count):
        letters = rng.choice(ALPHABETS)
        text = "".join(rng.choice(letters) for _ in range(rng.choice(sizes)))
        out.append((text, _edited(rng, text, rng.choice([0, 1, 3, 10, 40, 200]), letters) if rng.random() < 0.8
                    else "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 7, 100])))))
    return out


def test_distances_of_many_pairs():
    pairs = _pairs(1, 400, [0, 1, 2, 5, 20, 60, 199, 200, 201, 400, 900])
    expected = [levenshtein_distance(*p) for p in pairs]
    assert P.levenshtein_many(pairs).tolist() == expected
    short = _pairs(2, 60, [0, 1, 9, 30])
    assert P.levenshtein_many(short).tolist() == [lev_dp(*p) for p in short]
    rng = random.Random(3)
    most = np.array([rng.choice([0, 1, 5, 50, 1000]) for _ in pairs])
    for got, want, limit in zip(P.levenshtein_many(pairs, most).tolist(), expected, most.tolist()):
        assert got == want if want <= limit else got in (-1, want)


def test_edits_that_all_lie_at_the_begin():
    """The first edits reach little of the text, though the distance is within the limit."""
    rng, letters = random.Random(12), "abcdefghijklmnopqrstuvwxyz "
    pairs = []
    for k in range(40):
        text = "".join(rng.choice(letters) for _ in range(900))
        pairs.append(("".join(rng.choice(letters) for _ in range(60 + k)) + text[60 + k:], text))
    want = [levenshtein_distance(*p) for p in pairs]
    for limit in (100, 120, 900):
        got = P.levenshtein_many(pairs, np.full(len(pairs), limit)).tolist()
        assert all(g == w if w <= limit else g in (-1, w) for g, w in zip(got, want))
    assert P.levenshtein_many(pairs).tolist() == want


def test_ratios_of_many_pairs_are_difflibs(monkeypatch):
    pairs = _pairs(4, 400, [0, 1, 2, 5, 20, 60, 199, 200, 201, 400, 900])
    for autojunk in (True, False):
        want = [SequenceMatcher(None, *p, autojunk=autojunk).ratio() for p in pairs]
        assert P.ratios_many(pairs, autojunk).tolist() == want
    monkeypatch.setattr(P, "BATCH_RUNS", 500)  # many small batches
    monkeypatch.setattr(P, "BATCH_CHARS", 3000)
    assert P.ratios_many(pairs, False).tolist() == want


def test_scores_of_many_pairs_are_those_of_each():
    weights, rng = Weights(0.3, 0.25, 0.25, 0.2), random.Random(5)
    pairs = [p for p in _pairs(6, 300, [20, 200, 500]) if p[0] and p[1]]
    jac = np.array([rng.choice([0.5, 0.7, 0.9, 1.0]) for _ in pairs])
    shared = np.array([sum(min(a.count(c), b.count(c)) for c in set(a)) for a, b in pairs])
    lev, seq = P.scores_many(weights, 0.6)(pairs, jac, shared)
    for k, (a, b) in enumerate(pairs):
        want = pair_scores(weights, 0.6)(a, b, float(jac[k]), int(shared[k]))
        assert (None if np.isnan(seq[k]) else seq[k]) == want[1]
        assert want[1] is None or lev[k] == want[0]


def test_long_near_copies_take_little_time():
    """A hundred pairs of 20,000 characters with 60 edits: bit-vectors over the whole texts
    took 40 times as long."""
    rng, letters = random.Random(7), "abcdefghijklmnopqrstuvwxyz "
    pairs = []
    for _ in range(100):
        text = "".join(rng.choice(letters) for _ in range(20_000))
        pairs.append((text, _edited(rng, text, 60, letters)))
    began = time.process_time()
    got = P.levenshtein_many(pairs)
    took = time.process_time() - began
    began = time.process_time()
    assert got[0] == levenshtein_distance(*pairs[0])
    assert took < 100 * (time.process_time() - began) / 4
