"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeflow.llm import negatives
from gradeflow.llm.negatives import Index, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, uid string, q int, `a.h` string"


def brute(rows, anchors):
    sound = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows
             if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v, y) in enumerate(sound):
        if i not in anchors:
            continue
        scored = [(-sum(p * q for p, q in zip(v, w)), j, k, z) for k, (j, w, z) in enumerate(sound) if k != a]
        scored.sort()
        for p, pid, _, z in [s for s in scored if s[3] == y][:5]:
            window = [(-s, j) for s, j, _, z in scored if z != y and 30 * -p <= 100 * -s <= 90 * -p][:10]
            out += [(i, pid, r, j, -p, s) for r, (s, j) in enumerate(window, 1)]
    return sorted(out)


def test_index_finds_all_pairs():
    rng = np.random.default_rng(0)
    for least in (-2**62, 0, 20_000, 50_000, 2**62):
        a, rows = np.floor(256 * rng.normal(0, 0.125, (50, 37))), np.floor(256 * rng.normal(0, 0.125, (200, 37)))
        rows[:40] = a[:40] + 1
        cuts = np.full(50, least, np.int64) + rng.integers(-100, 100, 50)
        index = Index(a, cuts, np.sqrt((rows**2).sum(1)).max())
        anchor, row, score = index.search(rows)
        products = (rows @ a.T).astype(np.int64)
        want = {(j, i, int(products[i, j])) for i in range(200) for j in range(50) if products[i, j] >= cuts[j]}
        assert set(zip(anchor.tolist(), row.tolist(), score.tolist())) == want and len(anchor) == len(want)
        assert least < 50_000 or index.held[-1] < 50  # dimensions are left out


@pytest.mark.parametrize("small", [False, True])
def test_operator(spark, monkeypatch, small):
    if small:  # many indexes and blocks
        monkeypatch.setattr(negatives, "ANCHORS", 3)
        monkeypatch.setattr(negatives, "ROWS", 16)
        monkeypatch.setattr(negatives, "BLOCK_BYTES", 4000)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(20)], rng.randrange(3)) for i in range(300)]
    rows += [(300 + i, rows[20][1], i % 2) for i in range(40)]                  # ties
    rows += [rows[10], rows[10], (20, rows[11][1], 2)]                          # repeated rows and ids
    rows += [(400, None, 1), (401, [0.1, None], 1), (402, [float("nan")] * 20, 1), (403, [float("inf")] * 20, 0),
             (None, rows[3][1], 1), (404, rows[3][1], None), (405, [], 1), (410, rows[4][1][:7], 2), (420, rows[5][1], 9)]
    anchors = {i for i in range(0, 500, 10)}
    frame = spark.createDataFrame([(i, v, y, "u", 1, "h") for i, v, y in rows], SCHEMA).repartition(5)
    rounded = [(r.vec_id, r.embedding, r.label) for r in frame.collect()]       # as floats
    out = hard_negatives(frame, F.col("vec_id") % 10 == 0)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute(rounded, anchors)
    assert len(want) > 1000 and sorted(map(tuple, out.collect())) == want


def test_nothing(spark):
    frame = spark.createDataFrame([(1, [0.5], 1, "u", 1, "h")], SCHEMA)
    assert hard_negatives(frame, F.col("vec_id") == 1).collect() == []
    assert hard_negatives(frame.limit(0), F.col("vec_id") == 1).collect() == []
