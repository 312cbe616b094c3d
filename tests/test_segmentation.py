"""Dictionary segmentation against trying every cut."""

import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from gradeflow.functions.segmentation import Dictionary, dictionary_tokenizer, tokens_of, word_costs
from gradeflow.functions.text import preprocess
from gradeflow.operators import metrics, rouge

WORDS = {"北京": 50.0, "北京大学": 20.0, "大学": 60.0, "大学生": 15.0, "学生": 40.0, "生": 9.0, "前来": 8.0, "来": 30.0, "应聘": 5.0}


def costs(words):
    total = sum(words.values())
    return {w: math.floor(1000 * (math.log(total) - math.log(n))) for w, n in words.items()}, math.floor(1000 * math.log(total))


def brute(run, known, unknown):
    """Least cost over all cuts into known words and single characters; longer words first on ties."""
    options = []
    for k in range(len(run)):
        for at in combinations(range(1, len(run)), k):
            parts = [run[a:b] for a, b in zip((0, *at), (*at, len(run)))]
            if all(p in known or len(p) == 1 for p in parts):
                options.append((sum(known.get(p, unknown) for p in parts), [-len(p) for p in parts], parts))
    return min(options)[2]


def test_best_path():
    rng = random.Random(3)
    for _ in range(150):
        words = {"".join(rng.choices("天地人", k=rng.randint(1, 4))): float(rng.randint(1, 9)) for _ in range(8)}
        known, unknown = costs(words)
        dictionary = Dictionary([*known.items(), (None, unknown)])
        run = "".join(rng.choices("天地人山", k=rng.randint(1, 9)))
        assert dictionary.cut(run) == brute(run, known, unknown)


def test_tokens_of_unclean_text(spark):
    known, unknown = costs(WORDS)
    dictionary = Dictionary([*known.items(), (None, unknown)])
    assert tokens_of("北京大学生前来应聘!", dictionary) == ["北京", "大学生", "前来", "应聘", "!"]
    assert tokens_of("Été 2024, x_y 北京42é", dictionary) == ["Été", "2024", ",", "x", "_", "y", "北京", "42é"]
    assert tokens_of(None, dictionary) == [] and tokens_of(" \n", dictionary) == []
    found = {r["word"]: r["cost"] for r in word_costs(spark.createDataFrame(list(WORDS.items()), "word string, freq double")).collect()}
    assert found == {**known, None: unknown}


def test_tokenizer_in_metrics(spark):
    cut = dictionary_tokenizer(WORDS)
    df = spark.createDataFrame([(1, "北京大学生"), (2, "大学生 2024"), (3, None)], "i int, t string")
    rows = {r["i"]: r["w"] for r in df.select("i", cut(F.col("t")).alias("w")).collect()}
    assert rows == {1: ["北京", "大学生"], 2: ["大学生", "2024"], 3: []}
    assert metrics.distinct_n(df, "t", 1, tokenizer=cut, plain=False).first()["distinct_1"] == 0.75
    assert df.where("i = 2").select(preprocess(F.col("t"), tokenizer=cut).alias("w")).first()["w"] == ["大学生"]
    pair = spark.createDataFrame([("北京大学生", "大学生来")], "h string, r string")
    assert rouge.rouge(pair, "h", "r", tokenizer=cut).first()["rouge_1_p"] == 0.5
    with pytest.raises(ValueError):
        dictionary_tokenizer(WORDS, limit=3)
    nothing = dictionary_tokenizer({"x": 0.0})
    assert df.where("i = 1").select(nothing(F.col("t")).alias("w")).first()["w"] == list("北京大学生")


def test_long_run():
    dictionary = Dictionary([("人", 10), ("人人", 15), (None, 99)])
    assert dictionary.cut("人" * 20_001) == ["人人"] * 10_000 + ["人"]


def test_words_of_a_batch_are_not_held_together(spark):
    import tracemalloc

    import pyarrow as pa

    cut = dictionary_tokenizer(WORDS)
    texts = pa.array([None, "", *["a1 b2 " * 2000] * 400])
    tracemalloc.start()
    counts = [len(words) for part in cut.func(iter([texts])) for words in part]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts == [0, 0, *[4000] * 400]
    assert peak < 30_000_000  # one word takes about 60 bytes, all 1.6 million of them 90 MB
    df = spark.createDataFrame([(i, "x " * (i * 5000 % 70_001)) for i in range(60)], "i int, t string").coalesce(1)
    assert [r["n"] for r in df.select("i", F.size(cut(F.col("t"))).alias("n")).orderBy("i").collect()] == [i * 5000 % 70_001 for i in range(60)]
