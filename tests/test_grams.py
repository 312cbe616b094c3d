"""N-grams counted by blocks, against a count in Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gradeflow.operators import grams, metrics

KINDS = "g string, h long, d array<int>, t array<string>"


def made(rng, rows):
    words = ["a", "b", "é漢", "1:a", "", None]
    out = []
    for k in range(rows):
        t = None if k % 11 == 0 else [rng.choice(words) for _ in range(rng.choice([0, 1, 2, 7, 30]))]
        out.append((rng.choice(["x", "y", None]), rng.choice([2**53 + 1, None]), rng.choice([[1], [1, 2], None]), t))
    return out


def gram(words, plain):
    if len(words) == 1 and plain:
        return words[0]
    return "\x1f".join(w if plain else f"{len(w)}:{w}" for w in words if w is not None)


@pytest.mark.parametrize("n, plain, by", [(1, True, ["g"]), (1, False, []), (2, True, ["g", "h"]), (3, False, ["d", "g"]), (3, True, [])])
def test_counts_are_those_of_single_grams(spark, n, plain, by):
    rows = made(random.Random(n), 400)
    want: dict = {}
    for g, h, d, t in rows:
        values = {"g": g, "h": h, "d": None if d is None else tuple(d)}
        counts = want.setdefault(tuple(values[c] for c in by), Counter())
        for i in range(len(t or []) - n + 1):
            if (found := gram(t[i:i + n], plain)) is not None:
                counts[found] += 1
    df = spark.createDataFrame(rows, KINDS).coalesce(2)
    got = metrics.distinct_n(df, "t", n, by, tokenizer=lambda c: c, plain=plain).collect()
    key = lambda r: tuple(tuple(r[c]) if isinstance(r[c], list) else r[c] for c in by)
    assert {key(r): (r["distinct_ngrams"], r["total_ngrams"]) for r in got} == {k: (len(c), sum(c.values())) for k, c in want.items()}
    sketched = metrics.distinct_sketches(df, "t", n, by, tokenizer=lambda c: c, plain=plain).collect()
    assert {key(r): r["total_ngrams"] for r in sketched} == {k: sum(c.values()) for k, c in want.items()}


def test_blocks_combine_and_nothing_is_nothing(spark, monkeypatch):
    df = spark.createDataFrame([("x", ["a", "b"] * 500)] * 50 + [("y", None)], "g string, _tokens array<string>").coalesce(1)
    rows = grams.gram_counts(df, 3, ["g"], True).collect()
    assert sorted((r["g"], r["_gram"] or "", r["_n"]) for r in rows) == [
        ("x", "", 0), ("x", "a\x1fb\x1fa", 499 * 50), ("x", "b\x1fa\x1fb", 499 * 50), ("y", "", 0)]
    none = df.limit(0).select("g", F.col("_tokens").alias("t"))
    assert [tuple(r) for r in metrics.distinct_n(none, "t", 2, tokenizer=lambda c: c).collect()] == [(0, 0, 0.0)]
    assert metrics.distinct_sketches(none, "t", 2, tokenizer=lambda c: c).first()["total_ngrams"] == 0
    batch = df.toArrow().to_batches()[0]
    monkeypatch.setattr(grams, "BLOCK", 2500)
    assert [b.num_rows for b in grams._blocks(batch)] == [2] * 24 + [3]


def test_grams_are_dealt_before_they_are_hashed(spark):
    df = spark.range(10).select(F.lit("one two three four").alias("t"))
    plan = metrics.distinct_n(df, "t", 3, [])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [_gram") < plan.index("RepartitionByExpression") < plan.index("MapInArrow")
    assert "Generate" not in plan
