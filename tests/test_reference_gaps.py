"""Result layouts, weight trees as tables, samples per data set, and responses that are sent again."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from gradeflow import sinks, sources
from gradeflow.operators import metrics, rollup, sampling, scoring
from gradeflow.sinks import layout
from gradeflow.sources.weights import flatten_weights, weights_frame
from gradeflow.streaming.latest import changes


def test_chunks_are_numbered_without_gaps(spark, tmp_path):
    root = f"{tmp_path}/out"
    df = spark.range(23).select((22 - F.col("id")).alias("k"), F.lit(None).cast("string").alias("a.b"), F.lit("é\n").alias("t")).repartition(5)
    files = sinks.write_chunks(df, root, "part", 10, ["k"])
    assert [os.path.basename(f) for f in files] == ["part_0000.json", "part_0001.json", "part_0002.json"]
    read = [json.load(open(f"{root}/part_{i:04d}.json", encoding="utf-8")) for i in range(3)]
    assert [r["k"] for part in read for r in part] == list(range(23)) and [len(p) for p in read] == [10, 10, 3]
    assert read[0][0] == {"k": 0, "a.b": None, "t": "é\n"}
    sinks.write_chunks(df.where("k < 5"), root, "part", 10)  # fewer chunks: the others go
    assert sorted(f for f in os.listdir(root) if not f.startswith(".")) == ["part_0000.json"]
    assert sinks.write_chunks(df.limit(0), f"{tmp_path}/none") == []
    with pytest.raises(ValueError):
        sinks.write_chunks(df, root, chunk_rows=0)


def test_a_failed_layout_leaves_nothing(spark, tmp_path):
    texts = spark.createDataFrame([(0, "a"), (1, "b")], "_file int, value string")
    with pytest.raises(OSError):
        layout._publish(texts, {0: "x.json", 1: "y.json", 2: "z.json"}, f"{tmp_path}/broken")
    assert [f for f in os.listdir(f"{tmp_path}/broken") if not f.startswith(".")] == []
    boom = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("boom"))).otherwise("x").alias("t"))
    with pytest.raises(Exception, match="boom"):
        sinks.write_chunks(boom, f"{tmp_path}/failed")
    assert not os.path.exists(f"{tmp_path}/failed")


def test_score_tree_round_trip(spark, tmp_path):
    rows = [("m 1", "d=a", 0.5, 1, 2), ("m 1", "é%b", 0.0, 0, 3), ("007", "d=a", 1.0, 4, 4)]
    made = spark.createDataFrame(rows, "model string, dataset string, overall double, correct_count long, total_count long")
    files = sinks.write_score_tree(made, f"{tmp_path}/tree")
    assert len(files) == 3 and json.load(open(f"{tmp_path}/tree/m 1/d=a/statistical_analysis/result_stats.json"))["total_count"] == 2
    back = {(r["model"], r["dataset"]): r["score"] for r in sources.read_scores(spark, f"{tmp_path}/tree").collect()}
    assert back == {(m, d): 100 * x for m, d, x, *_ in rows}
    for bad in (made.union(made), made.withColumn("model", F.lit("a/b")), made.withColumn("dataset", F.lit(""))):
        with pytest.raises(ValueError):
            sinks.write_score_tree(bad, f"{tmp_path}/bad")


def random_tree(rng, depth, prefix=""):
    out = {}
    for k in range(rng.randint(1, 4)):
        name = f"{prefix}{k}"
        if depth > 1 and rng.random() < 0.7:
            out[name] = {"weight": rng.choice([0.0, 0.3, 1.0]), "children": random_tree(rng, depth - 1, name + ".")}
        else:
            out[f"d{rng.randrange(12)}" if f"d{rng.randrange(12)}" not in out else name] = {"weight": rng.choice([0.0, 0.5, 2.0])}
    return out


def test_tree_as_a_table(spark):
    rng = random.Random(2)
    rows = [(f"m{m}", f"d{d}", rng.choice([None, float("nan"), rng.random() * 100])) for m in range(3) for d in range(12)]
    scores = spark.createDataFrame(rows, "model string, dataset string, score double")
    for _ in range(3):
        nodes = flatten_weights(random_tree(rng, 5))
        want = {(r["model"], r["path"]): r["score"] for r in rollup.weighted_mean_rollup(scores, nodes).collect()}
        got = {(r["model"], r["path"]): r["score"] for r in rollup.rollup_table(scores, weights_frame(spark, nodes)).collect()}
        known = {k: v for k, v in want.items() if v is not None and v == v}
        assert set(got) == set(known) and all(abs(got[k] - known[k]) < 1e-9 for k in got)
    nodes = weights_frame(spark, flatten_weights({"a": {"children": {"d0": 1.0, "d1": 3.0}}}))
    two = nodes.withColumn("model", F.lit("m0")).union(nodes.withColumn("weight", F.lit(1.0)).withColumn("model", F.lit("m1")))
    flat = spark.createDataFrame([(m, d, s) for m in ("m0", "m1") for d, s in (("d0", 0.0), ("d1", 100.0))], scores.schema)
    own = {r["model"]: r["score"] for r in rollup.rollup_table(flat, two, by=("model",)).where("level = 1").collect()}
    assert own == {"m0": 75.0, "m1": 50.0}


def test_a_tree_with_very_many_nodes(spark):
    nodes = spark.range(20_000).selectExpr("concat('g', id % 100, ' / n', id) AS path", "concat('g', id % 100) AS parent_path", "2 AS level",
                                           "1.0D AS weight", "concat('d', id % 50) AS dataset")
    tops = spark.range(100).selectExpr("concat('g', id) AS path", "CAST(NULL AS string) AS parent_path", "1 AS level", "1.0D AS weight",
                                       "CAST(NULL AS string) AS dataset")
    scores = spark.range(50).selectExpr("'m' AS model", "concat('d', id) AS dataset", "CAST(id AS double) AS score")
    out = rollup.rollup_table(scores, nodes.union(tops))
    assert out.count() == 20_100 and {r["score"] for r in out.where("path = 'g7'").collect()} == {7.0}


def test_samples_of_each_data_set(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 20)).alias("s")).repartition(6)
    sizes = {"hot": 700, "s1": 10, "s2": 10_000, "s4": -1, "s5": 0}
    got = {r["s"]: sorted(r["ids"]) for r in sampling.sample_each(df, "s", sizes, ["id"], 5).groupBy("s").agg(F.collect_list("id").alias("ids")).collect()}
    for name, n in sizes.items():
        own = df.where(F.col("s") == name)
        n = own.count() if n == -1 else n
        want = sorted(r["id"] for r in own.orderBy(sampling.sample_key(["id"], 5), "id").limit(n).collect())
        assert got.get(name, []) == want
    assert set(got) == {"hot", "s1", "s2", "s4"}
    assert sampling.sample_each(df, "s", 3, ["id"]).groupBy("s").count().where("count <> 3").count() == 0
    assert sampling.sample_each(df.limit(0), "s", 3, ["id"]).count() == 0


SAMPLES = "question_id string, correct_answer string"
SENT = "question_id string, model string, sent int, response string"


def test_a_response_counts_once(spark):
    samples = spark.createDataFrame([("q1", "A"), ("q2", "B")], SAMPLES)
    rows = [("q1", "m", 1, "答案是B"), ("q1", "m", 2, "答案是A"), ("q1", "m", 2, "答案是A"), ("q2", "m", 1, "答案是B"), ("q2", "n", 5, "答案是C")]
    sent = spark.createDataFrame(rows, SENT)
    last = scoring.score_results(samples, sent, last_by=["sent"])
    assert sorted(tuple(r) for r in metrics.accuracy(last, ["model"]).collect()) == [("m", 1.0, 2, 2), ("n", 0.0, 0, 1)]
    with pytest.raises(Exception, match="duplicate key"):
        scoring.score_results(samples, sent).collect()
    assert scoring.score_results(samples, sent, check_unique=False).count() == 5


@pytest.mark.parametrize("keep_for", [None, "1 hour"])
def test_a_file_sent_twice_changes_nothing(spark, tmp_path, keep_for):
    rng = random.Random(8)
    samples = spark.createDataFrame([(f"q{k}", "ABCD"[k % 4]) for k in range(12)], SAMPLES)
    rows = [(f"q{rng.randrange(12)}", f"m{rng.randrange(2)}", rng.randrange(10), f"答案是{rng.choice('ABCD')}") for _ in range(60)]
    for name, part in (("a", rows[:25]), ("b", rows[20:]), ("c", rows[:45])):
        with open(f"{tmp_path}/{name}.json", "w") as out:
            out.writelines(json.dumps(dict(zip(("question_id", "model", "sent", "response"), r))) + "\n" for r in part)
    stream = spark.readStream.schema(SENT).option("maxFilesPerTrigger", 1).json(str(tmp_path))
    found = changes(scoring.score_results(samples, stream), keep_for=keep_for)
    name = f"changes_{'kept' if keep_for is None else 'timed'}"
    writer = found.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/state")
    if keep_for is None:
        writer.trigger(availableNow=True).start().awaitTermination(120)
    else:  # with time-outs a stream goes on by itself
        job, until = writer.start(), time.time() + 90
        while time.time() < until and sum(p["numInputRows"] for p in job.recentProgress) < 110:
            time.sleep(1)
        job.stop()
    got = {r["model"]: (r["c"], r["t"]) for r in spark.table(name).groupBy("model").agg(F.sum("correct").alias("c"), F.sum("total").alias("t")).collect()}
    last: dict = {}
    for q, m, at, said in rows:
        mine = str(at), said[-1]
        last[q, m] = max(last.get((q, m), mine), mine)
    want = {m: (sum(a == "ABCD"[int(q[1:]) % 4] for (q, x), (_, a) in last.items() if x == m), sum(x == m for _, x in last)) for m in ("m0", "m1")}
    assert got == want


def _scored(spark, folder, name, rows):
    """A stream over scored rows, in files of their own that arrive one by one."""
    kind = "item long, model string, site long, sent int, predicted_answer string, is_correct boolean"
    spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").json(f"{folder}/{name}")
    return spark.readStream.schema(kind).json(f"{folder}/{name}")


def test_many_keys_share_few_states(spark, tmp_path):
    big = 2**53 + 1  # beside a null, pandas would make it a double
    rows = [(k, f"m{k % 2}", [None, big, big + 1][k % 3], s, "A", (k + s) % 2 == 0) for k in range(300) for s in (1, 2)]
    found = changes(_scored(spark, tmp_path, "in", rows), ("item", "model"), ("model", "site"), buckets=5)
    writer = found.writeStream.format("memory").queryName("few_states").option("checkpointLocation", f"{tmp_path}/state")
    job = writer.trigger(availableNow=True).start()
    job.awaitTermination(120)
    assert sum(p["stateOperators"][0]["numRowsUpdated"] for p in job.recentProgress if p["stateOperators"]) <= 5
    got = {(r["model"], r["site"]): (r["c"], r["t"]) for r in
           spark.table("few_states").groupBy("model", "site").agg(F.sum("correct").alias("c"), F.sum("total").alias("t")).collect()}
    want: dict = {}
    for k in range(300):
        at = f"m{k % 2}", [None, big, big + 1][k % 3]
        c, t = want.get(at, (0, 0))
        want[at] = c + (k % 2 == 0), t + 1
    assert got == want


def test_forgotten_keys_count_as_new(spark, tmp_path):
    found = changes(_scored(spark, tmp_path, "in", [(1, "m", 0, 5, "A", True), (2, "m", 0, 5, "A", True)]), ("item", "model"), keep_for="2 seconds", buckets=1)
    job = found.writeStream.format("memory").queryName("forgotten").option("checkpointLocation", f"{tmp_path}/state").start()

    def total():
        return spark.table("forgotten").agg(F.sum("total")).first()[0]

    def wait_for(done):
        until = time.time() + 60
        while not done() and time.time() < until:
            time.sleep(0.5)

    wait_for(lambda: total() == 2)
    wait_for(lambda: job.lastProgress["stateOperators"][0]["numRowsTotal"] == 0)
    _scored(spark, tmp_path, "in", [(1, "m", 0, 1, "B", False)])
    wait_for(lambda: total() == 3)
    job.stop()
    assert total() == 3


def test_doubles_as_json_writers_print_them(spark):
    import struct

    from gradeflow.functions.canonical import canonical_json
    from gradeflow.functions.numbers import float_text

    rng = random.Random(1)
    values = [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(20_000)]
    values += [rng.random() * 10 ** rng.randint(-8, 22) for _ in range(20_000)] + [round(rng.random() * 100, rng.randint(0, 4)) for _ in range(3000)]
    values += [k * 5e-324 for k in range(1, 200)] + [2.0**k for k in range(-1074, 1024, 5)]
    values += [-0.0, 0.0, 1e-4, 1e-5, 1e15, 1e16, 1e22, 1e23, 2e23, 9007199254740993.0, float("nan"), float("inf"), float("-inf")]
    rows = spark.createDataFrame([(x,) for x in values], "x double").select("x", float_text(F.col("x")).alias("t")).collect()
    assert [(r["x"], r["t"]) for r in rows if json.dumps(r["x"]) != r["t"]] == []
    nested = spark.createDataFrame([([0.1, None, 1e300], {"b": 2.5, "a": -0.0})], "v array<double>, m map<string,double>")
    text = nested.select(canonical_json(F.struct("v", "m"), nested.schema).alias("t")).first()["t"]
    assert text == json.dumps({"v": [0.1, None, 1e300], "m": {"b": 2.5, "a": -0.0}}, sort_keys=True)


def test_tools_share_one_aggregation(spark):
    rows = [("m", "A", "A", True), ("m", "B", "A", False), ("n", "D", "A", False), ("n", None, "B", None)]
    results = spark.createDataFrame(rows, "model string, predicted_answer string, correct_answer string, is_correct boolean")
    both = metrics.measure(results, ["Accuracy", "Mutual", "nobody_knows"], ["model"])
    assert both.columns == ["model", "overall", "correct_count", "total_count", "recall_1", "recall_2", "mrr"]
    assert both._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    alone = {r["model"]: tuple(r)[1:] for r in metrics.mutual_metrics(results, ["model"]).collect()}
    assert {r["model"]: tuple(r)[4:] for r in both.collect()} == alone
    assert metrics.measure(results, ["nobody_knows"]).first()["total_count"] == 4
    analysed = {r["model"]: r for r in metrics.analyze_single_choice(results, ["Accuracy", "Mutual"], ["model"]).collect()}
    assert analysed["m"]["recall_2"] == 1.0 and analysed["n"]["mrr"] is None and "without" in analysed["n"]["summary"]
    with pytest.raises(ValueError):
        metrics.register_tool("Mutual", metrics.mutual())


def test_sketches_of_parts(spark):
    rows = [("a", 0, "one two three four"), ("a", 1, "two three four five"), ("b", 0, "one"), (None, 0, "x y z"), (None, 1, None)]
    docs = spark.createDataFrame(rows, "lang string, part int, text string")
    want = sorted(map(str, metrics.distinct_n(docs, "text", 3, ["lang"]).collect()))
    parts = metrics.distinct_sketches(docs, "text", 3, ["lang", "part"])
    assert sorted(map(str, metrics.distinct_united(parts, 3, ["lang"]).collect())) == want  # few values are counted exactly
    assert metrics.distinct_united(metrics.distinct_sketches(docs.limit(0), "text", 3), 3).first().distinct_3 == 0.0
