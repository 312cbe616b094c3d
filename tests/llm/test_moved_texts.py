"""What near deduplication moves: texts stay where they were read, and unlike members of a group are not paired."""

import random

import numpy as np

from gradeflow.llm import near
from gradeflow.llm.common import written


def words(rng, n):
    return [f"w{rng.randrange(10**9)}" for _ in range(n)]


def recorded(monkeypatch):
    """Plans and frames of the tables that near dedup writes."""
    seen = []

    def keep(df, name):
        out = written(df, name)
        seen.append((name, df._jdf.queryExecution().executedPlan().toString(), out))
        return out

    monkeypatch.setattr(near, "written", keep)
    return seen


def test_sets_are_made_without_moving_texts(spark, monkeypatch):
    rng = random.Random(1)
    base = [words(rng, 60) for _ in range(6)]
    docs = spark.createDataFrame([(2 * i + k, " ".join(b[:60 - k])) for i, b in enumerate(base) for k in range(2)], "doc_id long, text string")
    seen = recorded(monkeypatch)
    assert near.near_duplicates(docs).where("kept").count() == 6
    plans = [plan for name, plan, _ in seen if name == "sets"]
    assert plans and not any("Exchange" in plan or "Join" in plan for plan in plans)


def test_unlike_members_of_a_large_group_are_not_paired(spark, monkeypatch):
    rng = random.Random(2)
    rare, frequent = [words(rng, 30) for _ in range(20)], [words(rng, 65) for _ in range(5)]
    docs = spark.createDataFrame([(5 * i + k, " ".join(words(rng, 5) + a + b)) for i, a in enumerate(rare)
                                  for k, b in enumerate(frequent)], "doc_id long, text string")
    seen = recorded(monkeypatch)
    assert near.near_duplicates(docs, leaf=0).where("kept").count() == 100
    assert sum(out.count() for name, _, out in seen if name == "cross") == 0


def test_parities_bound_the_tokens_that_differ():
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 2**64, n, np.uint64) for n in (0, 5, 900, 3000)]
    sets += [np.concatenate([s[len(s) // 4:], rng.integers(0, 2**64, 7, np.uint64)]) for s in sets]
    bits = near.parities(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            differ = len(np.setxor1d(a, b))
            assert np.bitwise_count((bits[i] ^ bits[j]).view(np.uint64)).sum() <= differ
    assert np.bitwise_count((bits[2] ^ bits[6]).view(np.uint64)).sum() > 150


def test_few_bytes_come_to_the_driver(spark, monkeypatch):
    """The table of slots comes packed: a sparse one is far smaller than its 32 MB."""
    rng = random.Random(4)
    base = [words(rng, 30) for _ in range(200)]
    docs = spark.createDataFrame([(2 * i + k, " ".join(b[:30 - k])) for i, b in enumerate(base) for k in range(2)], "doc_id long, text string")
    sizes, arrow = [], type(docs).toArrow

    def to_arrow(df):
        out = arrow(df)
        sizes.append(out.nbytes)
        return out

    monkeypatch.setattr(type(docs), "toArrow", to_arrow)
    assert near.near_duplicates(docs).where("kept").count() == 200
    assert sizes and max(sizes) < 2 << 20
