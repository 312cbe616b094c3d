import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from gradeflow.operators import (
    dialogues, formatting, inference, metrics, ranking, rollup, rouge, sampling, scoring,
)
from gradeflow.functions import prompts
from gradeflow.sources.documents import stop_word_filter
from gradeflow.sources.weights import flatten_weights, weights_frame


def test_news_formatting_and_rejects(spark):
    rows = [
        (0, ["1", " T one ", '"Body, one"']), (1, ["3", '"T"', "B"]), (2, ["0", "T", "B"]),
        (3, ["5", "T", "B"]), (4, ["1.0", "T", "B"]), (5, ["", "T", "B"]), (6, ["2", "T"]),
        (7, ["2", '""', "B"]), (8, ["+4", "T", "B\nC"]), (9, ["x", "T", "B"]),
        (10, ["99999999999999", "T", "B"]), (11, ["２", "T", "B"]),
    ]
    df = spark.createDataFrame(rows, "id long, raw_data array<string>")
    every = formatting.format_news_all(df, keep=["id"])
    good = {r["id"]: r for r in formatting.accepted(every).collect()}
    assert {i: r["correct_answer"] for i, r in good.items()} == {0: "A", 1: "C", 8: "D", 11: "B"}
    scene = "Title: T one\nDescription: Body, one"
    assert good[0]["scene"] == scene
    assert good[0]["question_id"] == hashlib.sha256(scene.encode()).hexdigest()
    assert good[0]["other_info"].asDict() == {
        "dataset_name": "agnews", "title": "T one", "description": "Body, one", "original_label": 1}
    assert list(good[0]["options"]) == ["A", "B", "C", "D"]
    reasons = {r["id"]: r["reject_reason"] for r in formatting.rejects(every).collect()}
    assert reasons == {2: "label", 3: "label", 4: "label", 5: "label", 6: "description",
                       7: "title", 9: "label", 10: "label"}


def test_option_letters_wrap_after_52(spark):
    sizes = [0, 1, 26, 27, 52, 53, 110]
    df = spark.createDataFrame([([f"o{i}" for i in range(n)],) for n in sizes], "o array<string>")
    out = [r[0] for r in df.select(formatting.options_to_letters(F.col("o"))).collect()]
    letters = formatting.ALPHABET
    for n, got in zip(sizes, out):
        want = {}
        for i in range(n):
            want[letters[i % 52]] = f"o{i}"
        assert got == want and list(got) == list(want)


def test_flatten_and_unpack(spark):
    df = spark.createDataFrame(
        [(1, (1, ("x", [1, 2])), ["a", "b"]), (2, None, None)],
        "id int, dialogue_annotation struct<a:int,b:struct<c:string,d:array<int>>>, dialogues array<string>",
    )
    flat = formatting.flatten_annotations(df, keep=["id"])
    assert flat.columns == ["id", "a", "b.c", "b.d", "turn_count"]
    assert [tuple(r) for r in flat.orderBy("id").collect()] == [(1, 1, "x", [1, 2], 2), (2, None, None, None, 0)]
    wide = formatting.unpack_lists(flat)
    assert wide.columns == ["id", "a", "b.c", "turn_count", "b.d_0", "b.d_1"]
    assert [tuple(r) for r in wide.orderBy("id").collect()] == [(1, 1, "x", 2, 1, 2), (2, None, None, 0, None, None)]


def test_clean_cells_drops_blank_rows(spark):
    df = spark.createDataFrame([([" a ", None],), (["\u3000", ""],), ([],)], "raw_data array<string>")
    assert [r[0] for r in formatting.clean_cells(df).collect()] == [["a", ""]]


def test_score_results_joins_by_key(spark):
    samples = spark.createDataFrame(
        [("q1", "A"), ("q2", "B"), ("q3", "c")], "question_id string, correct_answer string")
    responses = spark.createDataFrame(
        [("q1", "m", "答案是A"), ("q1", "n", None), ("q2", "m", '{"error":"x"}'), ("q3", "m", "c")],
        "question_id string, model string, response string")
    out = scoring.score_results(samples, responses)
    got = {(r["question_id"], r["model"]): (r["predicted_answer"], r["is_correct"]) for r in out.collect()}
    # A lower-case gold letter never equals an upper-cased prediction.
    assert got == {("q1", "m"): ("A", True), ("q1", "n"): ("UNKNOWN", False),
                   ("q2", "m"): ("UNKNOWN", False), ("q3", "m"): ("C", False)}
    missing = scoring.score_results(samples, responses.filter("question_id = 'q1'"), how="left")
    assert missing.filter("question_id = 'q2'").first()["is_correct"] is None


def test_score_results_can_insist_on_unique_samples(spark):
    samples = spark.createDataFrame([("q", "A"), ("q", "A")], "question_id string, correct_answer string")
    responses = spark.createDataFrame([("q", "A")], "question_id string, response string")
    assert scoring.score_results(samples, responses, check_unique=False).count() == 2
    with pytest.raises(Exception, match="duplicate key"):
        scoring.score_results(samples, responses).collect()


def test_pick_option(spark):
    rows = [("q", "B", -1.0), ("q", "B", -1.0), ("q", "A", -1.0), ("q", "C", -1.5), ("r", "C", -0.1)]
    df = spark.createDataFrame(rows, "question_id string, option string, logprob double")
    mean = scoring.pick_option(scoring.option_scores(df, how="mean")).orderBy("question_id").collect()
    assert [tuple(r) for r in mean] == [("q", "A", -1.0), ("r", "C", -0.1)]
    total = scoring.pick_option(scoring.option_scores(df, how="sum")).orderBy("question_id").collect()
    assert [tuple(r) for r in total] == [("q", "A", -1.0), ("r", "C", -0.1)]
    placed = spark.createDataFrame([("q", "A", 2, 1.0), ("q", "B", 1, 1.0)],
                                   "question_id string, option string, pos int, score double")
    assert scoring.pick_option(placed, position="pos").first()["option"] == "B"


def test_accuracy(spark):
    df = spark.createDataFrame([("m", True), ("m", None), ("n", False)], "model string, is_correct boolean")
    out = {r["model"]: tuple(r)[1:] for r in metrics.accuracy(df, ["model"]).collect()}
    assert out == {"m": (0.5, 1, 2), "n": (0.0, 0, 1)}
    assert tuple(metrics.accuracy(df.limit(0)).first()) == (0.0, 0, 0)
    report = {r["model"]: r for r in metrics.analyze_single_choice(df, ["F1"], ["model"]).collect()}
    assert report["m"]["overall"] is None and report["m"]["summary"].startswith("Skipped")
    assert report["n"]["overall"] == 0.0 and report["n"]["total_count"] == 1
    assert metrics.analyze_single_choice(df.limit(0)).first()["summary"] == "Skipped: no results"


def test_mutual_metrics(spark):
    pairs = [("A", "A"), ("A", "B"), ("A", "C"), ("UNKNOWN", "D"), ("A", "x"), ("z", "z"), (None, None)]
    df = spark.createDataFrame(pairs, "predicted_answer string, correct_answer string")
    got = metrics.mutual_metrics(df).first()
    assert got["recall_1"] == pytest.approx(3 / 7)
    assert got["recall_2"] == pytest.approx(4 / 7)
    assert got["mrr"] == pytest.approx((1 + 0.5 + 1 / 3 + 0.25 + 0 + 1 + 1) / 7)
    assert tuple(metrics.mutual_metrics(df.limit(0)).first()) == (0.0, 0.0, 0.0)


def test_distinct_n_and_k(spark):
    df = spark.createDataFrame(
        [("g", "a b c d"), ("g", "a b c d"), ("g", "a"), ("empty", ""), ("empty", None)], "k string, t string")
    out = {r["k"]: tuple(r)[1:] for r in metrics.distinct_n(df, "t", 3, ["k"]).collect()}
    assert out == {"g": (2, 4, 0.5), "empty": (0, 0, 0.0)}
    rough = metrics.distinct_n(df, "t", 3, ["k"], approximate=True).collect()
    assert {r["k"]: r["distinct_3"] for r in rough} == {"g": 0.5, "empty": 0.0}
    docs = spark.createDataFrame([(1, ["a", "b", "a", "b"]), (2, ["a"]), (3, [])], "i int, t array<string>")
    rows = [tuple(r) for r in docs.orderBy("i").select(*metrics.distinct_k(F.col("t"), [1, 2])).collect()]
    assert rows == [(4, 2, 0.5, 2 / 3), (1, 1, 1.0, 0.0), (None, None, 0.0, 0.0)]


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b, 1):
            row[j] = last[j - 1] + 1 if x == y else max(last[j], row[j - 1])
    return row[-1]


def test_lcs_against_the_table_method():
    rng = random.Random(4)
    for _ in range(300):
        a = [rng.choice("abcdefgh") for _ in range(rng.randrange(40))]
        b = [rng.choice("abcdxyz") for _ in range(rng.randrange(40))]
        assert rouge.lcs_length(a, b) == slow_lcs(a, b)


def test_rouge_against_brute_force(spark):
    rng = random.Random(5)
    words = ["the", "cat", "sat", "on", "mat", "dog"]
    pairs = [(i, " ".join(rng.choices(words, k=rng.randrange(30))), " ".join(rng.choices(words, k=rng.randrange(30))))
             for i in range(60)]
    pairs += [(60, "", "a b"), (61, None, None), (62, "今天天气", "今天 天气"), (63, "x " * 3000, "x y " * 2000)]
    df = spark.createDataFrame(pairs, "i int, h string, r string")
    found = {r["i"]: r for r in rouge.rouge(df, "h", "r", keep=("i",)).collect()}
    sets = {r["i"]: r for r in rouge.rouge(df, "h", "r", keep=("i",), counting="distinct").collect()}

    def grams(tokens, n):
        return [tuple(tokens[i:i + n]) for i in range(len(tokens) - n + 1)]

    def check(row, name, overlap, a, b):
        assert row[f"{name}_p"] == pytest.approx(overlap / a if a else 0)
        assert row[f"{name}_r"] == pytest.approx(overlap / b if b else 0)
        assert row[f"{name}_f"] == pytest.approx(2 * overlap / (a + b) if overlap else 0)

    for i, h, r in pairs:
        a, b = (list(x.replace(" ", "")) if x and x[0] == "今" else (x or "").split() for x in (h, r))
        for n in (1, 2):
            left, right = grams(a, n), grams(b, n)
            both = sum(min(left.count(g), right.count(g)) for g in set(left))
            check(found[i], f"rouge_{n}", both, len(left), len(right))
            check(sets[i], f"rouge_{n}", len(set(left) & set(right)), len(set(left)), len(set(right)))
        if i < 63:
            check(found[i], "rouge_l", slow_lcs(a, b), len(a), len(b))
    assert found[63]["rouge_l_p"] == pytest.approx(2000 / 3000)


def test_sample_n_is_exact_and_independent_of_partitions(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    order = sorted(range(1000), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
    for n in (0, 1, 37, 999, 1000, 1500):
        want = sorted(order[:n])
        for parts in (1, 7):
            small = sampling.sample_n(df.repartition(parts), n, ["k"])
            large = sampling.sample_n(df.repartition(parts), n, ["k"], single_task_rows=-1)
            assert sorted(r["k"] for r in small.collect()) == want
            assert sorted(r["k"] for r in large.collect()) == want
    assert sampling.sample_n(df, -1, ["k"]).count() == 1000


def test_sample_widens_a_band_that_misses(spark, monkeypatch):
    """Even cuts far from the right place must end in the exact sample."""
    monkeypatch.setattr(sampling.math, "sqrt", lambda n: -2.6)
    df = spark.range(500).withColumnRenamed("id", "k")
    order = sorted(range(500), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
    for n in (1, 100, 333):
        got = sampling.sample_n(df, n, ["k"], single_task_rows=-1)
        assert sorted(r["k"] for r in got.collect()) == sorted(order[:n])


def test_take_in_lanes(spark):
    df = spark.range(1000).select((F.lit(1000) - F.col("id")).alias("k")).repartition(13)
    for limit in (10**9, -1):
        got = sampling.take(df, 5, ["k"], single_task_rows=limit).collect()
        assert [r["k"] for r in got] == [1, 2, 3, 4, 5]
    assert sampling.take(df, -1, ["k"]).count() == 1000


def test_head_biased_cap(spark):
    rows = [(f, i) for f, n in [("a", 150), ("b", 100), ("c", 40), ("d", 0), ("e", 3)] for i in range(n)]
    df = spark.createDataFrame(rows, "_source_file string, _row_index long").repartition(5)
    got = sampling.head_biased_cap(df, 2).collect()
    held = []
    for name in "abcde":
        for row in [r for r in rows if r[0] == name]:
            held.append(row)
            if len(held) > 200:
                break
    assert sorted(tuple(r) for r in got) == sorted(held)
    assert sampling.head_biased_cap(df, -1).count() == len(rows)


def test_dialogue_hashes(spark):
    turns = [[("user", 'say "hi"\n'), ("assistant", "é \x07")], [("user", "x")], []]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(turns)] + [(3, None)],
                               "k long, dialogues array<struct<role:string,content:string>>")
    want = [
        hashlib.sha256(json.dumps([{"role": r, "content": c} for r, c in t], sort_keys=True,
                                  ensure_ascii=False).encode()).hexdigest()
        for t in [*turns, []]
    ]
    got = [r["hash"] for r in dialogues.with_dialogue_hash(df).orderBy("k").collect()]
    assert got == want and want[-1].startswith("4f53cda1")
    long = df.select("k", F.posexplode("dialogues").alias("n", "t")).select("k", "n", "t.*")
    by_turn = {r["k"]: (r["hash"], r["turn_count"]) for r in dialogues.hash_turns(long, "k", "n").collect()}
    assert by_turn == {0: (want[0], 2), 1: (want[1], 1)}
    formatted = dialogues.empty_format(df).orderBy("k").collect()
    assert [r["other_info"]["hash"] for r in formatted] == want


def test_hash_turns_across_arrow_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = [(k, n, "user", f"t{k}-{n}") for k in range(5) for n in range(k * 4 + 1)]
        df = spark.createDataFrame(rows, "k long, n long, role string, content string").repartition(3)
        got = {r["k"]: (r["hash"], r["turn_count"]) for r in dialogues.hash_turns(df, "k", "n").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in range(5):
        turns = [{"role": "user", "content": f"t{k}-{n}"} for n in range(k * 4 + 1)]
        text = json.dumps(turns, sort_keys=True)
        assert got[k] == (hashlib.sha256(text.encode()).hexdigest(), len(turns))


def test_dedup_by_hash(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b")], "k long, hash string")
    assert sorted(r["k"] for r in dialogues.dedup_by_hash(df, "k").collect()) == [1, 2]
    groups = {r["hash"]: (r["k"], r["copies"]) for r in dialogues.duplicate_groups(df, "k").collect()}
    assert groups == {"a": (1, 2), "b": (2, 1)}


def test_apply_model_keeps_large_ids_beside_nulls(spark):
    df = spark.createDataFrame([(2**53 + 1, "a"), (None, "b")], "i long, prompt string")
    got = inference.apply_model(df, lambda: (lambda prompts: prompts)).collect()
    assert {(r["i"], r["response"]) for r in got} == {(2**53 + 1, "a"), (None, "b")}


def test_hash_turns_with_null_and_large_keys(spark):
    rows = [(2**53, 1, "a"), (2**53 + 1, 1, "a"), (None, 1, "a"), (None, 2, "b")]
    df = spark.createDataFrame(rows, "k long, n int, content string").withColumn("role", F.lit("u"))
    got = {r["k"]: r["turn_count"] for r in dialogues.hash_turns(df, "k", "n").collect()}
    assert got == {2**53: 1, 2**53 + 1: 1, None: 2}


def test_head_biased_cap_counts_rows_that_are_there(spark):
    rows = [("a", i) for i in range(0, 600, 2)] + [("b", i) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "_source_file string, _row_index long").repartition(3)
    got = sorted(tuple(r) for r in sampling.head_biased_cap(df, 1).collect())
    assert got == [("a", i) for i in range(0, 202, 2)] + [("b", 1)]


def test_stop_word_filter_with_repeated_keys(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (1, ["c"]), (None, ["b"])], "k int, t array<string>")
    words = spark.createDataFrame([("b",)], "word string")
    got = sorted((r["t"] for r in stop_word_filter(df, ["k"], "t", words).collect()))
    assert got == [[], ["a"], ["c"]]


def test_prompt_template_of_unsupported_fields(spark):
    df = spark.createDataFrame([("x",)], "scene string")
    for template in ('{"answer": "{scene}"}', "{a.b}", "{scene!r}"):
        with pytest.raises(ValueError):
            prompts.render_prompt(df, template)


def test_apply_model_batches_groups_and_failures(spark):
    df = spark.createDataFrame(
        [(i, f"p{i}", "hot" if i % 2 else "cold") for i in range(20)], "i int, prompt string, params string"
    ).repartition(2)

    def load():
        def fn(prompts):
            assert len(prompts) <= 3
            if "p7" in prompts:
                raise RuntimeError("no luck")
            return [p.upper() for p in prompts]

        return fn

    rows = inference.apply_model(df, load, batch_size=3, group_key="params").collect()
    assert len(rows) == 20
    failed = [r for r in rows if r["error"]]
    assert any(r["i"] == 7 for r in failed) and {r["params"] for r in failed} == {"hot"}
    assert all(r["response"] is None and r["error"] == "no luck" for r in failed)
    assert all(r["response"] == r["prompt"].upper() for r in rows if not r["error"])
    short = inference.apply_model(df, lambda: (lambda prompts: []), batch_size=5)
    assert inference.responses_of(short).count() == 0


TREE = {
    "A": {"weight": 2.0, "children": {
        "x": {"weight": 1.0, "children": {"d1": {"weight": 1.0}, "d2": {"weight": 3.0}}},
        "y": {"children": {"d3": {}}},
        "z": {"weight": 5.0, "children": {"gone": {"weight": 1.0}}}}},
    "B": {"weight": 1.0, "children": {"x": {"weight": 0.0, "children": {"d1": {"weight": 1.0}}}}},
    "d2": {"weight": 1.0},
}


def brute_rollup(tree, scores, path=()):
    out = {}
    for name, node in tree.items():
        here = path + (name,)
        if node.get("children"):
            below = brute_rollup(node["children"], scores, here)
            out.update(below)
            pairs = [(below[here + (c,)], n.get("weight", 1.0)) for c, n in node["children"].items()]
            pairs = [(s, w) for s, w in pairs if s is not None and s == s]
            total = sum(w for _, w in pairs)
            out[here] = sum(s * w for s, w in pairs) / total if total > 0 else None
        else:
            out[here] = scores.get(name)
    return out


def test_rollup_against_recursion(spark):
    nodes = flatten_weights(TREE)
    by_model = {"m": {"d1": 10.0, "d2": 50.0, "d3": 30.0}, "n": {"d1": None, "d2": 20.0},
                "o": {"elsewhere": 1.0}, "p": {"d1": float("nan"), "d2": 4.0}}
    rows = [(m, d, s) for m, ds in by_model.items() for d, s in ds.items()]
    scores = spark.createDataFrame(rows, "model string, dataset string, score double")
    got = {(r["model"], r["path"]): r["score"] for r in rollup.weighted_mean_rollup(scores, nodes).collect()}
    assert len(got) == 4 * len(nodes)
    for model, ds in by_model.items():
        for path, want in brute_rollup(TREE, ds).items():
            have = got[model, " / ".join(path)]
            assert have == want or have == pytest.approx(want, nan_ok=True), (model, path)
    doubled = json.loads(json.dumps(TREE).replace("1.0", "2.0").replace("3.0", "6.0").replace("5.0", "10.0"))
    scaled = {(r["model"], r["path"]): r["score"]
              for r in rollup.weighted_mean_rollup(scores, flatten_weights(doubled)).collect()}
    assert scaled["m", "A / x"] == got["m", "A / x"]


def test_rollup_quotes_dataset_names(spark):
    tree = {"A": {"children": {"it's \\ \"odd\"": {"weight": 1e-07}, "100%": {"weight": 3}}}}
    names = list(tree["A"]["children"])
    scores = spark.createDataFrame([("m", names[0], 8.0)], "model string, dataset string, score double")
    got = {r["name"]: r["score"] for r in rollup.weighted_mean_rollup(scores, flatten_weights(tree)).collect()}
    assert got == {"A": pytest.approx(8.0), names[0]: 8.0, names[1]: None}


def test_older_tree_form(spark):
    tree = {"top": {"sub_tasks": {"d1": 2.0, "t": {"weight": 1.0, "d2": 1.0, "d3": 3.0}, "open": {"weight": 9.0}}}}
    nodes = flatten_weights(tree)
    assert [(n.name, n.weight, n.dataset) for n in nodes] == [
        ("top", 1.0, None), ("d1", 2.0, "d1"), ("t", 1.0, None), ("d2", 1.0, "d2"), ("d3", 3.0, "d3"),
        ("open", 9.0, None)]
    scores = spark.createDataFrame([("m", "d1", 10.0), ("m", "d2", 20.0), ("m", "d3", 40.0)],
                                   "model string, dataset string, score double")
    got = {r["path"]: r["score"] for r in rollup.weighted_mean_rollup(scores, nodes).collect()}
    assert got["top / t"] == 35.0 and got["top / open"] is None
    assert got["top"] == pytest.approx((10 * 2 + 35) / 3)
    assert {r[0] for r in rollup.datasets_in(weights_frame(spark, nodes)).collect()} == {"d1", "d2", "d3"}


def test_minmax(spark):
    rows = [("a", "two", 10.0), ("b", "two", 30.0), ("c", "two", 15.0), ("d", "two", None),
            ("a", "same", 5.0), ("b", "same", 5.0), ("a", "one", 7.0), ("b", "one", None), ("a", "none", None)]
    df = spark.createDataFrame(rows, "model string, dataset string, score double")
    scaled = rollup.minmax_by_dataset(df)
    got = {(r["model"], r["dataset"]): r["score"] for r in scaled.collect()}
    assert got == {("a", "two"): 0.0, ("b", "two"): 100.0, ("c", "two"): 25.0, ("d", "two"): None,
                   ("a", "same"): 50.0, ("b", "same"): 50.0, ("a", "one"): 7.0}
    summary = [tuple(r) for r in rollup.normalization_summary(scaled, 2).collect()]
    assert summary == [("one", 7.0, 7.0, 7.0), ("same", 50.0, 50.0, 50.0)]
    summary = [tuple(r) for r in rollup.normalization_summary(scaled, 2, raw=df).collect()]
    assert summary == [("one", 7.0, 7.0, 7.0)]
    covered = {r["model"]: (r["valid"], r["missing"]) for r in rollup.coverage(df).collect()}
    assert covered == {"a": (3, 1), "b": (2, 1), "c": (1, 0), "d": (0, 1)}


def level_rows(spark, rows):
    return spark.createDataFrame(
        [(p, path, path.split(" / "), path.count("/") + 1, m, s) for p, path, m, s in rows],
        "pos int, path string, parts array<string>, level int, model string, score double")


def test_mark_top2(spark):
    rows = [(0, "tie", m, s) for m, s in [("a", 5.0), ("b", 5.0), ("c", 4.0)]]
    rows += [(1, "plain", m, s) for m, s in [("a", 1.0), ("b", 3.0), ("c", 2.0), ("d", 2.0)]]
    rows += [(2, "zero", m, s) for m, s in [("a", 0.0), ("b", None), ("c", -1.0)]]
    rows += [(3, "single", "a", 9.0)]
    got = {(r["path"], r["model"]): r["mark"] for r in ranking.mark_top2(level_rows(spark, rows)).collect()}
    assert got == {("tie", "a"): 1, ("tie", "b"): 1, ("tie", "c"): 0, ("plain", "a"): 0, ("plain", "b"): 1,
                   ("plain", "c"): 2, ("plain", "d"): 2, ("zero", "a"): 0, ("zero", "b"): 0,
                   ("zero", "c"): 0, ("single", "a"): 1}


def test_leaderboard(spark):
    dims = ["Basic_Capabilities", "Emotional_Intelligence", "Companionship_Ability", "Values_and_Safety"]
    board = {"tie_b": (50, 50, 50, 70.0), "tie_a": (50, 50, 50, 69.99), "top": (90, 80, 70, None),
             "half": (10, None, 10, 90.0), "low": (-5, 0, 0, 100.0), "over": (300, 300, 300, 100.0)}
    rows = [(i, d, m, None if s is None else float(s))
            for m, v in board.items() for i, (d, s) in enumerate(zip(dims, v))]
    for buckets in (1, 4096):
        out = ranking.leaderboard(level_rows(spark, rows), buckets=buckets).collect()
        got = sorted(((r["position"], r["model"], r["status"]) for r in out), key=lambda r: (r[0] is None, r[0]))
        assert got == [(1, "over", "Normal"), (2, "top", "Normal"), (3, "tie_a", "Gray"),
                       (4, "tie_b", "Normal"), (5, "low", "Normal"), (None, "half", "Incomplete")]
    totals = {r["model"]: r["total"] for r in out}
    assert totals["top"] == pytest.approx(90 * 0.3 + 80 * 0.4 + 70 * 0.3) and totals["half"] is None


def test_level_table_order_and_spans(spark):
    rows = [(1, "A / x", "m", 0.0), (1, "A / x", "n", None), (2, "A / y", "m", 12.345), (2, "A / y", "n", 0.0),
            (4, "B / x", "m", None), (4, "B / x", "n", None), (6, "C / x", "m", 1.0), (6, "C / x", "n", 2.0)]
    levels = level_rows(spark, rows)
    table = ranking.level_table(levels, 2)
    assert table.columns == ["pos", "path", "m", "n"]
    assert [tuple(r) for r in table.collect()] == [
        (2, "A / y", "12.35", "0.00"), (4, "B / x", "N/A", "N/A"), (6, "C / x", "1.00", "2.00"),
        (1, "A / x", "0.00", "N/A")]
    report = ranking.order_report_rows(levels, 2)
    assert [r["pos"] for r in report.collect()] == [2, 4, 6, 1]
    spans = {tuple(r) for r in ranking.merge_spans(report).collect()}
    assert spans == {(0, 0, "A", 1), (0, 1, "B", 1), (0, 2, "C", 1), (0, 3, "A", 1),
                     (1, 0, "y", 1), (1, 1, "x", 3)}


def test_metrics_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(i % 3, f"w{i % 7} w{i % 5} w{i % 2}") for i in range(200)], "k int, t string")
    runs = [sorted(map(tuple, metrics.distinct_n(df.repartition(p), "t", 2, ["k"]).collect())) for p in (1, 5, 9)]
    assert runs[0] == runs[1] == runs[2]


def test_count_rows(spark):
    counted, seen = metrics.count_rows(spark.range(17).toDF("x"))
    counted.collect()
    assert seen.get["rows"] == 17


def test_rows_with_null_keys_stay(spark):
    from gradeflow.operators.dialogues import dedup_by_hash

    df = spark.createDataFrame([(1, "a"), (2, "a"), (None, "a"), (None, "b"), (3, None)], "k long, hash string")
    assert sorted(dedup_by_hash(df, "k").collect(), key=str) == sorted([(1, "a"), (None, "b"), (3, None)], key=lambda r: f"Row(k={r[0]}, hash={r[1]!r})")
