import json
import os

import pytest
from pyspark.sql import functions as F

from gradeflow import sinks, sources
from gradeflow.functions import text
from gradeflow.operators import metrics, rollup
from gradeflow.plans import evaluation, reporting
from gradeflow.registry import Registry, analyzers, formatters, loaders, run_analyzers, tasks
from gradeflow.sources import delimited
from gradeflow.sources.weights import flatten_weights
from gradeflow.streaming import read_responses, running_accuracy

NEWS_ROWS = [
    '"1","First title","Body, with comma"', '"3","Second ""quoted"" title","line one\nline two"',
    '"4","Third"," padded \\ backslash "', '"1","Fourth","x"', '"9","Bad label","y"',
]


def write(path, content, encoding="utf-8"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding=encoding, newline="") as out:
        out.write(content)
    return str(path)


def test_csv_header_default_quotes_and_provenance(spark, tmp_path):
    path = write(f"{tmp_path}/in/a b+c.csv", "\n".join(NEWS_ROWS) + "\n\n , ,\n")
    write(f"{tmp_path}/in/deep/b.csv", "h,h,h\n2,T,B\n")
    write(f"{tmp_path}/in/notes.txt", "1,2,3\n")
    rows = sources.read_csv(spark, [f"{tmp_path}/in", path, f"{tmp_path}/missing.csv", f"{tmp_path}/in/notes.txt"])
    got = sorted(rows.collect(), key=lambda r: r["_row_index"])
    assert [r["raw_data"][0] for r in got] == ["3", "4", "1", "9"]
    assert got[0]["raw_data"] == ["3", 'Second "quoted" title', "line one\nline two"]
    assert got[1]["raw_data"][2] == "padded \\ backslash"
    assert [r["_row_index"] for r in got] == [0, 1, 2, 3]
    assert got[0]["_source_file"].endswith("/in/a b+c.csv")
    everything = sources.read_csv(spark, f"{tmp_path}/in", recursive=True, skip_header=False, sep=",")
    assert everything.count() == 7
    samples = rows.transform(formatters.get("AGNewsFormatter"))
    assert sorted(r["correct_answer"] for r in samples.collect()) == ["A", "C", "D"]


def test_csv_sniffs_the_delimiter(spark, tmp_path):
    write(f"{tmp_path}/s.csv", "a;b;c\n1;x, y;z\n2;p, q;r\n")
    got = sources.read_csv(spark, f"{tmp_path}/s.csv").orderBy("_row_index").collect()
    assert [r["raw_data"] for r in got] == [["1", "x, y", "z"], ["2", "p, q", "r"]]
    assert delimited.sniff_delimiter("") == ","
    latin = write(f"{tmp_path}/l.csv", "h,h\né,ü\n", encoding="latin-1")
    assert sources.read_csv(spark, latin, encoding="iso-8859-1", sep=",").first()["raw_data"] == ["é", "ü"]


def test_csv_of_single_lines(spark, tmp_path):
    path = write(f"{tmp_path}/l.csv", 'h,h\n"1","a ""b"", c"\n\n , \n2,"x\\y"\n3\n')
    rows = sources.read_csv(spark, path, multi_line=False, sep=",", width=2).orderBy("_row_index")
    assert [(r["_row_index"], r["raw_data"]) for r in rows.collect()] == [
        (0, ["1", 'a "b", c']), (3, ["2", "x\\y"]), (4, ["3", ""])]
    unnumbered = sources.read_csv(spark, path, multi_line=False, sep=",", width=2, row_index=False)
    assert sorted(r["raw_data"] for r in unnumbered.collect()) == [
        ["1", 'a "b", c'], ["2", "x\\y"], ["3", ""]]


def test_ragged_rows_and_delimiters_of_each_file(spark, tmp_path):
    body = "".join("1\n" for _ in range(70)) + '2,"x, ""y""",z,w\n'
    write(f"{tmp_path}/r/a.csv", "h\n" + body)
    write(f"{tmp_path}/d/a.csv", "h,h,h\n1,a,b\n2,c,d\n")
    write(f"{tmp_path}/d/b.csv", "h;h;h\n1;e;f\n2;g;h\n")
    write(f"{tmp_path}/t/a.tsv", "h\n" + "1\n" * 70 + "2\tx\ty\tz\n")
    for how in ({}, {"row_index": False}, {"multi_line": False}, {"multi_line": False, "row_index": False}):
        cells = [r["raw_data"] for r in sources.read_csv(spark, f"{tmp_path}/r", sep=",", **how).collect()]
        assert len(cells) == 71 and ["2", 'x, "y"', "z", "w"] in cells
        both = [r["raw_data"] for r in sources.read_csv(spark, f"{tmp_path}/d", **how).collect()]
        assert sorted(both) == [["1", "a", "b"], ["1", "e", "f"], ["2", "c", "d"], ["2", "g", "h"]]
    for row_index in (True, False):
        cells = [r["raw_data"] for r in sources.read_tsv(spark, f"{tmp_path}/t", row_index=row_index).collect()]
        assert len(cells) == 71 and ["2", "x", "y", "z"] in cells


def test_copies_of_a_text_are_questions_of_their_own(spark, tmp_path):
    write(f"{tmp_path}/news.csv", "1,T,D\n" * 2 + "2,U,E\n")
    config = {"class": "CSVDataLoader", "paths": [f"{tmp_path}/news.csv"], "skip_header": False, "sep": ",",
              "formatter_name": "AGNewsFormatter"}
    samples = evaluation.load_samples(spark, [config])
    assert samples.select("question_id").distinct().count() == 3
    answers = samples.select("question_id", F.lit("m").alias("model"), F.lit("news").alias("dataset"), F.lit("A").alias("response"))
    assert evaluation.evaluate(samples, answers).metrics.select("correct_count", "total_count").first()[1] == 3
    plain = {k: v for k, v in config.items() if k != "formatter_name"}
    assert evaluation.load_samples(spark, [dict(plain, num=2)]).count() == 2
    assert evaluation.load_samples(spark, [dict(plain, num=1, first=True)]).first()["_row_index"] == 0


def test_csv_without_files(spark, tmp_path):
    assert sources.read_csv(spark, f"{tmp_path}/nothing").count() == 0


def test_tsv_keeps_quotes(spark, tmp_path):
    write(f"{tmp_path}/t.tsv", 'h\th\th\n1\t"open\tx\\y\n\n \t\t \n2\ta "b" c\t\n')
    rows = sources.read_tsv(spark, f"{tmp_path}/t.tsv").orderBy("_row_index")
    got = [r["raw_data"] for r in rows.collect()]
    assert got == [["1", '"open', "x\\y"], ["2", 'a "b" c', ""]]
    # Blank rows are dropped, but counted.
    assert [r["_row_index"] for r in rows.collect()] == [0, 3]
    plain = sources.read_tsv(spark, f"{tmp_path}/t.tsv", row_index=False, width=3).collect()
    assert sorted(r["raw_data"] for r in plain) == sorted(got)
    quoted = [r["raw_data"] for r in sources.read_csv(spark, f"{tmp_path}/q.tsv", suffix="tsv").collect()]
    assert quoted == []
    write(f"{tmp_path}/q.tsv", 'h\th\n1\t"a\tb"\n')
    got = sources.read_csv(spark, f"{tmp_path}/q.tsv", suffix="tsv").collect()
    assert [r["raw_data"] for r in got] == [["1", "a\tb"]]


def test_json_documents(spark, tmp_path):
    write(f"{tmp_path}/a.json", '[{"q": "x", "n": 1},\n {"q": "y"}]')
    write(f"{tmp_path}/b.json", '{"q": "z", "n": 3}')
    write(f"{tmp_path}/c.json", '{"q": broken')
    write(f"{tmp_path}/d.json", "{'q': 'single quotes'}")
    write(f"{tmp_path}/e.json", '{"q": "two"}\n{"q": "values"}\n')
    write(f"{tmp_path}/f.json", '[{"q": "x"}] trailing')
    write(f"{tmp_path}/g.json", "\n[]\n")
    odd = write(f"{tmp_path}/odd/x.json", '{"odd name": 1, "q": null}')
    assert sources.read_json(spark, odd, "`odd name` int, q string").first()["odd name"] == 1
    got = sources.read_json(spark, str(tmp_path), "q string, n int")
    rows = sorted((r["q"], r["n"], r["_row_index"]) for r in got.collect())
    assert rows == [("x", 1, 0), ("y", None, 1), ("z", 3, 0)]


def test_jsonl_skips_bad_lines_and_files(spark, tmp_path):
    write(f"{tmp_path}/a.jsonl", '{"q": "x"}\nnot json\n\n{"q": "y", "extra": 1}\n{"q": "z"} x\n{"q": "a"},{"q": "b"}\n3\n')
    write(f"{tmp_path}/math.jsonl", '{"q": "skip"}\n')
    got = sources.read_jsonl(spark, str(tmp_path), "q string", exclude_path_patterns=["math.jsonl"])
    assert sorted(r["q"] for r in got.collect()) == ["x", "y"]
    nothing = sources.read_jsonl(spark, f"{tmp_path}/absent", "q string")
    assert nothing.dtypes == [("q", "string"), ("_source_file", "string")] and nothing.count() == 0
    # Counting does not touch any field, and must still see only good lines.
    assert got.count() == 2


def test_line_labels_survive_splits(spark, tmp_path):
    lines = [json.dumps({"q": f"q{i}"}) if i % 9 else "broken" for i in range(700)]
    write(f"{tmp_path}/PIQA/x.jsonl", "\n".join(lines) + "\n")
    write(f"{tmp_path}/PIQA/x-labels.lst", "\n".join(f" {i} " for i in range(700)) + "\n")
    write(f"{tmp_path}/PIQA/y.jsonl", '{"q": "other"}\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "10")
    try:
        numbered = sources.read_numbered_lines(spark, f"{tmp_path}/PIQA/x.jsonl")
        assert numbered.rdd.getNumPartitions() > 1
        assert all(r["value"] == lines[r["line_no"]] for r in numbered.collect())
        got = sources.read_jsonl(spark, f"{tmp_path}/PIQA", "q string", labelled_paths="PIQA")
        labels = {r["q"]: r["label"] for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert labels.pop("other") is None
    assert labels == {f"q{i}": str(i) for i in range(700) if i % 9}


def test_parquet_val_and_raw(spark, tmp_path):
    df = spark.range(10).select("id", (F.col("id") * 2).alias("v")).coalesce(1)
    for name in ("train", "val"):
        df.write.parquet(f"{tmp_path}/{name}")
    (part,) = [f for f in os.listdir(f"{tmp_path}/val") if f.endswith(".parquet")]
    os.rename(f"{tmp_path}/val/{part}", f"{tmp_path}/train/my-val-0.parquet")
    both = sources.read_parquet(spark, f"{tmp_path}/train")
    only = sources.read_parquet(spark, f"{tmp_path}/train", val=True, raw=True)
    assert both.count() == 20 and only.count() == 10
    row = only.filter("raw_data.id = 4").first()
    assert row["raw_data"]["v"] == 8 and row["_row_index"] == 4 and "my-val-0" in row["_source_file"]


def test_stop_words(spark, tmp_path):
    path = write(f"{tmp_path}/stop.txt", "the \nof\nthe\n")
    words = sources.read_stop_words(spark, path)
    assert sorted(sources.stop_word_list(words)) == ["of", "the"]
    assert sources.read_stop_words(spark, f"{tmp_path}/none.txt").count() == 0
    with pytest.raises(ValueError):
        sources.stop_word_list(words, limit=1)
    df = spark.createDataFrame([(1, ["the", "b", "a", "b"]), (2, ["of"]), (3, [])], "k int, t array<string>")
    by_join = sources.stop_word_filter(df, ["k"], "t", words).orderBy("k").collect()
    by_list = df.withColumn("t", text.remove_stop_words(F.col("t"), ["the", "of"])).orderBy("k").collect()
    assert [r["t"] for r in by_join] == [r["t"] for r in by_list] == [["b", "a", "b"], [], []]


def test_score_tree(spark, tmp_path):
    files = {
        ("m 1+", "d1"): '{"overall": 0.12345, "correct_count": 3}', ("m 1+", "d2"): '{"text": "0.5", "x": 1}',
        ("m 1+", "d3"): '{"a": 1}', ("m2", "d1"): "{broken", ("m2", "d2"): "{}", ("m2", "d4"): '{"a": true}',
        ("m4", "d1"): '{"a": 0.5} {"b": 1}', ("m3", "d1"): '{"a": 1e-1, "b": [1, 2]}', ("m3", "d2"): "[1]", ("m3", "d3"): '{"a": null}',
    }
    for (model, dataset), content in files.items():
        write(f"{tmp_path}/{model}/{dataset}/statistical_analysis/result_stats.json", content)
    scores = sources.read_scores(spark, str(tmp_path))
    assert scores.count() == len(files)
    got = {(r["model"], r["dataset"]): r["score"] for r in sources.valid_scores(scores).collect()}
    assert got == {("m 1+", "d1"): 12.35, ("m 1+", "d3"): 100.0, ("m3", "d1"): 10.0}
    assert sources.read_scores(spark, f"{tmp_path}/nothing").count() == 0
    models, datasets = rollup.discover(scores)
    assert models.count() == 4 and datasets.count() == 4


def test_metric_and_score_files_round_trip(spark, tmp_path):
    results = spark.createDataFrame(
        [("m", "d", True), ("m", "d", False), ("n", "e f", True)], "model string, dataset string, is_correct boolean")
    sinks.write_metrics(metrics.accuracy(results, ["model", "dataset"]), f"{tmp_path}/metrics")
    scores = sources.read_scores(spark, f"{tmp_path}/metrics", layout="partitioned")
    assert {tuple(r) for r in scores.collect()} == {("m", "d", 50.0), ("n", "e f", 100.0)}
    sinks.write_scores(scores, f"{tmp_path}/scores")
    back = sources.read_scores_json(spark, f"{tmp_path}/scores", lines=True)
    assert {tuple(r) for r in back.collect()} == {("m", "d", 50.0), ("n", "e f", 100.0)}
    whole = write(f"{tmp_path}/scores.json", '{\n "b": {"x": 1.5, "y": null},\n "a": {"x": 2}\n}')
    assert {tuple(r) for r in sources.read_scores_json(spark, whole).collect()} == {
        ("b", "x", 1.5), ("b", "y", None), ("a", "x", 2.0)}


def test_result_chunks(spark, tmp_path):
    df = spark.range(1000).select(
        F.col("id").cast("string").alias("question_id"), F.lit("词").alias("raw_answer"),
        F.when(F.col("id") < 900, "hot").otherwise("cold").alias("model"), F.lit("d").alias("dataset"))
    sinks.write_results(df, f"{tmp_path}/out", chunk_rows=100)
    back = spark.read.json(f"{tmp_path}/out")
    assert back.count() == 1000 and back.select("question_id").distinct().count() == 1000
    sizes = back.groupBy(F.col("_metadata.file_path")).count().collect()
    assert max(r["count"] for r in sizes) <= 100
    assert "词" in back.first()["raw_answer"]


def test_json_sink_checks_the_name(spark, tmp_path):
    df = spark.createDataFrame([(1, "é")], "a int, b string")
    sinks.write_json(df, f"{tmp_path}/x.jsonl")
    assert spark.read.json(f"{tmp_path}/x.jsonl").first()["b"] == "é"
    with pytest.raises(ValueError):
        sinks.write_json(df, f"{tmp_path}/x.csv")
    sinks.preview(df)


def test_reports(spark, tmp_path):
    tree = {"Basic_Capabilities": {"children": {"d1": {}}}, "Emotional_Intelligence": {"children": {"d2": {}}},
            "Companionship_Ability": {"children": {"d3": {}}}, "Values_and_Safety": {"children": {"d4": {}}}}
    rows = [(m, f"d{i}", float(10 * i + j)) for j, m in enumerate("abc") for i in range(1, 5)]
    scores = reporting.keep(spark.createDataFrame(rows, "model string, dataset string, score double"), "s")
    nodes = sources.load_weights(spark, tree)
    for normalized in (False, True):
        done = reporting.report(scores, nodes, normalized)
        assert [r["model"] for r in done.ranking.orderBy("position").collect()] == ["c", "b", "a"]
    out = sinks.write_level_tables(done.level_scores, f"{tmp_path}/levels")
    assert spark.read.parquet(out[0]).count() == 4
    sinks.write_leaderboard(done.level_scores, f"{tmp_path}/board")
    assert spark.read.parquet(f"{tmp_path}/board").count() == 3


def test_weights_from_yaml(spark, tmp_path):
    pytest.importorskip("yaml")
    path = write(f"{tmp_path}/w.yaml", "A:\n  weight: 0.5\n  children:\n    d:\n      weight: 2\nB: {}\n")
    nodes = sources.load_weights(spark, path)
    assert [(n.path, n.weight, n.level, n.is_leaf) for n in nodes] == [
        ("A", 0.5, 1, False), ("A / d", 2.0, 2, True), ("B", 1.0, 1, True)]
    assert sources.weights_frame(spark, flatten_weights({"x": {}})).first()["dataset"] == "x"


def test_registries(spark):
    reg = Registry("thing")
    reg.register("a")(len)
    with pytest.raises(ValueError, match="already"):
        reg.register("a")(len)
    with pytest.raises(ValueError, match="known: \\['a'\\]"):
        reg.get("b")
    assert "CSVDataLoader" in loaders and "SingleChoiceTask" in tasks and "single_choice" in analyzers
    df = spark.createDataFrame([(True,)], "is_correct boolean")
    assert list(run_analyzers(df, ["single_choice", "nope"])) == ["single_choice"]


def test_configured_evaluation(spark, tmp_path):
    write(f"{tmp_path}/news.csv", "\n".join(NEWS_ROWS) + "\n")
    config = {"class": "CSVDataLoader", "paths": [f"{tmp_path}/news.csv"], "skip_header": False,
              "formatter_name": "AGNewsFormatter", "num": 300, "sep": ","}
    samples = evaluation.load_samples(spark, [config])
    assert sorted(r["correct_answer"] for r in samples.collect()) == ["A", "A", "C", "D"]
    assert evaluation.load_samples(spark, [dict(config, num=2)]).count() == 2

    def load():
        return lambda prompts: ["B" if "Second" in p else "选A吧，答案是A" for p in prompts]

    done = evaluation.evaluate_model(samples, "{scene}\n{option_A}", load, "m", "news")
    assert tuple(done.metrics.first()) == ("m", "news", 0.5, 2, 4)
    answers = done.results.select("question_id", "model", "dataset", F.col("raw_answer").alias("response"))
    again = evaluation.evaluate(samples, answers)
    assert tuple(again.metrics.first()) == ("m", "news", 0.5, 2, 4)
    record = sinks.summary_record(done.results, done.metrics, ["SingleChoiceTask"]).first()
    assert record["total_samples"] == 4 and record["tasks_run"] == ["SingleChoiceTask"]
    assert json.loads(record["metrics"][0])["correct_count"] == 2
    nothing = evaluation.evaluate(samples.limit(0), answers)
    assert nothing.metrics.count() == 0


def test_streamed_responses(spark, tmp_path):
    samples = spark.createDataFrame([("q1", "A"), ("q2", "B")], "question_id string, correct_answer string")
    write(f"{tmp_path}/in/1.json", '{"question_id":"q1","model":"m","response":"A"}\n')
    write(f"{tmp_path}/in/2.json", '{"question_id":"q2","model":"m","response":"答案是C"}\n')
    stream = running_accuracy(samples, read_responses(spark, f"{tmp_path}/in", files_per_trigger=1))
    job = (stream.writeStream.outputMode("complete").format("memory").queryName("streamed")
           .option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start())
    job.awaitTermination()
    assert tuple(spark.table("streamed").first()) == ("m", 0.5, 1, 2)


def test_names_and_nulls_survive_files(spark, tmp_path):
    from gradeflow.sinks import write_json, write_metrics
    from gradeflow.sources.scores import read_scores

    metrics = spark.createDataFrame([("007", "1e3", 0.5, 1, 2)], "model string, dataset string, overall double, correct_count long, total_count long")
    write_metrics(metrics, f"{tmp_path}/m")
    row = read_scores(spark, f"{tmp_path}/m", layout="partitioned").first()
    assert (row.model, row.dataset, row.score) == ("007", "1e3", 50.0)
    write_json(spark.createDataFrame([(1, None)], "a long, b string"), f"{tmp_path}/x.jsonl")
    assert spark.read.text(f"{tmp_path}/x.jsonl").first().value == '{"a":1,"b":null}'
