"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from gradeflow.llm import search
from gradeflow.llm.search import ranked

SCHEMA = "doc_id long, text string, m int, uid string, `a.h` string"


def words(text):
    low = re.sub("[A-Z]", lambda c: c[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, keep=10):
    counted = [(i, Counter(words(t)), len(words(t))) for i, t in docs]
    n, total = sum(size > 0 for *_, size in counted), sum(size for *_, size in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, size in counted:
            if size and i is not None:
                m = 25 + 75 * size * n // total
                score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                            for t in words(text) if t in c)
                if score > 0:
                    found.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(found)[:keep], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [False, True])
def test_operator(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(search, "PIECE_POSTINGS", 40)
        monkeypatch.setattr(search, "ITEM_BYTES", 200)
    rng = random.Random(7)
    pool = [f"w{k}" for k in range(60)] + ["Été", "漢字", "x-y", "THE", "the"]
    docs = [(k, rng.choice([" ", "\n", ", "]).join(rng.choices(pool, k=rng.randint(0, 60)))) for k in range(150)]
    docs += [(200 + k, docs[3][1]) for k in range(30)]                              # ties
    docs += [docs[5], docs[5], (5, "w1 w2"), (300, None), (301, ""), (302, "... !"), (None, "w1 w2 w3"),
             (303, "w5 unseen " * 200_000)]                                         # more than a block
    items = [(k, " ".join(rng.choices(pool, k=rng.randint(1, 12)))) for k in range(20)]
    items += [(50, None), (51, ""), (52, "w1 w1 w1 W2"), (52, "w3"), (None, "w4"), (53, "nowhere")]
    frame = spark.createDataFrame([(i, t, 1, "u", "h") for i, t in docs], SCHEMA).repartition(4)
    tests = spark.createDataFrame(items, "item_id long, text string")
    out = ranked(frame, tests)
    assert out.columns == ["item_id", "rank", "doc_id", "score"] and dict(out.dtypes)["rank"] == "int"
    assert sorted(map(tuple, out.collect()), key=str) == brute(docs, items)
    assert ranked(frame.limit(0), tests).collect() == [] and ranked(frame, tests.limit(0)).collect() == []


def test_strata_below_the_last_place_are_not_visited():
    rng = np.random.default_rng(1)
    strata = []
    for m in range(25, 425, 20):
        tf = rng.integers(1, 4, 100)
        strata.append(search.Stratum(m, np.arange(50) + 1000 * m, np.repeat(np.arange(50), 2), np.tile([0, 1], 50), tf))
    items = search.Items([(0, 0, "a b")])
    best = [search.Best(10)]
    visits = search.search(strata, items, np.array([900, 700]), best)
    everything = sorted((-int(s), int(d)) for x in strata
                        for s, d in zip(x.scores(np.array([0, 1]), np.array([900, 700])), x.doc_ids))
    assert visits < len(strata)
    assert list(zip((-best[0].score).tolist(), best[0].doc.tolist())) == everything[:10]
