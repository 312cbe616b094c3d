"""One query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeflow import sinks, sources
from gradeflow.functions import answers, logits, prompts, text
from gradeflow.operators import (
    dialogues, formatting, inference, metrics, ranking, rollup, rouge, sampling, scoring,
)
from gradeflow.plans import evaluation, reporting
from gradeflow.registry import formatters, run_analyzers
from gradeflow.storage import new_folder
from gradeflow.streaming import read_responses, running_accuracy

from . import views
from .views import table, texts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

TEMPLATE = (
    "Read the article and name its class.\n\n{scene}\n\n{question_text}\n\n"
    "A. {option_A}\nB. {option_B}\nC. {option_C}\nD. {option_D}\nE. {option_E}\n\nAll:\n{options}\n"
    "{{letter}}: {missing}"
)
STOP_WORDS = ["the", "of", "and", "la", "de", "en", "und", "die"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Fix the digits of floating sums whose order of addition Spark does not fix."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


def digest(col: Column, name: str = "digest") -> Column:
    """A whole text as one comparable value."""
    return F.md5(col).alias(name)


# --- Sources -------------------------------------------------------------------------


@query
def parquet_scan(spark: SparkSession, sf: str) -> DataFrame:
    rows = sources.read_parquet(spark, f"{sf}/documents.parquet")
    name = F.element_at(F.split("_source_file", "/"), -1)
    return rows.select("doc_id", name.alias("file_name"), F.col("_row_index").alias("row_index"))


@query
def csv_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "csv")
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string"), "lang", "text")
    docs.write.options(
        header="true", quoteAll="true", escape='"',
        ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false",
    ).csv(path)
    rows = sources.read_csv(spark, path, sep=",", width=3)
    cell = lambda i: F.get("raw_data", F.lit(i))
    return rows.select(
        cell(0).cast("long").alias("doc_id"), cell(1).alias("lang"), digest(cell(2))
    )


@query
def tsv_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "tsv")
    line = F.concat_ws(
        "\t", F.col("doc_id").cast("string"), F.col("lang"),
        F.concat(F.lit('"'), F.regexp_replace("text", "[\t\r\n]", " ")),
    )
    table(spark, sf, "documents").select(line).write.text(path)
    rows = sources.read_tsv(spark, path, suffix="txt", skip_header=False, width=3)
    cell = lambda i: F.get("raw_data", F.lit(i))
    return rows.select(
        cell(0).cast("long").alias("doc_id"), cell(1).alias("lang"), digest(cell(2))
    )


@query
def jsonl_scan(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "jsonl")
    docs = table(spark, sf, "documents")
    good = F.to_json(F.struct("doc_id", "lang", "text"))
    broken = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("{broken "), "lang"))
    lines = F.explode(F.array_compact(F.array(good, broken)))
    docs.select(lines.alias("value")).write.text(path)
    rows = sources.read_jsonl(spark, path, "doc_id long, lang string, text string", suffix="txt")
    return rows.select("doc_id", "lang", digest(F.col("text")))


@query
def json_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations written as one JSON array per file, then read back."""
    path = new_folder(spark, "json")
    turns = table(spark, sf, "conversations")
    body = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    opening = F.when(F.col("turn") == 0, "[").otherwise(",")
    lines = turns.select("conv_id", "turn", F.concat(opening, body).alias("value"))
    closing = turns.groupBy("conv_id").agg((F.max("turn") + 1).alias("turn"))
    lines = lines.unionByName(closing.withColumn("value", F.lit("]")))
    ordered = lines.repartition("conv_id").sortWithinPartitions("conv_id", "turn")
    ordered.withColumnRenamed("conv_id", "part").drop("turn").write.partitionBy("part").text(path)
    schema = "conv_id long, turn long, role string, text string"
    rows = sources.read_json(spark, path, schema, recursive=True, suffix="txt")
    return rows.select(
        "conv_id", "turn", "role", digest(F.col("text")), F.col("_row_index").alias("row_index")
    )


@query
def line_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Records and labels in files side by side, matched by line number."""
    path = new_folder(spark, "lines")
    record = F.to_json(F.struct("doc_id", "text"))
    record = F.when(F.col("doc_id") % 7 == 0, "{broken").otherwise(record)
    sides = F.array(
        F.struct(F.lit("records").alias("side"), record.alias("value")),
        F.struct(F.lit("labels").alias("side"), F.col("lang").alias("value")),
    )
    docs = texts(spark, sf, "documents", "doc_id").select("doc_id", F.inline(sides))
    ordered = docs.sortWithinPartitions("side", "doc_id").select("side", "value")
    ordered.write.partitionBy("side").text(path)

    def lines(side: str, suffix: str) -> DataFrame:
        read = sources.read_numbered_lines(spark, f"{path}/side={side}", "txt")
        stem = F.regexp_replace("_source_file", f"side={side}/(.*)[.]txt$", f"$1{suffix}")
        return read.withColumn("_source_file", stem)

    labelled = sources.attach_line_labels(lines("records", ".jsonl"), lines("labels", "-labels.lst"))
    return sources.parse_json_lines(labelled, "doc_id long, text string", ["label"]).select(
        "doc_id", "label"
    )


@query
def capped_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = sources.read_parquet(spark, f"{sf}/documents.parquet")
    return sampling.head_biased_cap(rows, 3).select("doc_id")


@formatters.register("DocumentsFormatter")
def _documents_formatter(df: DataFrame) -> DataFrame:
    return views.questions_of(df)


@query
def configured_samples(spark: SparkSession, sf: str) -> DataFrame:
    config = {
        "class": "ParquetDataLoader", "paths": [f"{sf}/documents.parquet", f"{sf}/absent.parquet"],
        "formatter_name": "DocumentsFormatter", "num": 150, "seed": 11,
    }
    return evaluation.load_samples(spark, [config]).select("question_id", "correct_answer")


@query
def row_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    questions = views.questions_of(docs)
    picked = sampling.sample_n(questions, 250, ["question_id"])
    return metrics.stage_counts({"read": docs, "formatted": questions, "sampled": picked})


@query
def score_files(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "metrics")
    sinks.write_metrics(metrics.accuracy(views.results(spark, sf), ["model", "dataset"]), path)
    return sources.valid_scores(sources.read_scores(spark, path, layout="partitioned"))


@query
def score_document(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "scores")
    sinks.write_scores(sources.valid_scores(views.scores(spark, sf)), path)
    return sources.read_scores_json(spark, path, lines=True)


@query
def result_files(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "results")
    slim = views.results(spark, sf).select("question_id", "model", "dataset", "is_correct")
    sinks.write_results(slim, path, chunk_rows=500)
    back = spark.read.schema(slim.schema).json(path)
    files = back.groupBy("model", F.col("_metadata.file_path").alias("_file")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_correct").alias("correct")
    )
    return files.groupBy("model").agg(
        F.sum("n").alias("n"), F.sum("correct").alias("correct"),
        (F.max("n") <= 500).alias("chunks_fit"),
    )


# --- Formatting ----------------------------------------------------------------------


@query
def news_samples(spark: SparkSession, sf: str) -> DataFrame:
    return views.samples(spark, sf).select(
        "doc_id", "question_id", "correct_answer", "category", "subcategory",
        F.col("other_info.original_label").cast("long").alias("original_label"),
        F.col("options")["B"].alias("option_b"),
        F.length("scene").cast("long").alias("scene_length"),
    )


@query
def rejected_rows(spark: SparkSession, sf: str) -> DataFrame:
    label = F.concat(F.lit(" "), (F.col("doc_id") % 6).cast("string"), F.lit("\t"))
    out = formatting.rejects(views.formatted(table(spark, sf, "documents"), label))
    return out.select("doc_id", "reject_reason")


@query
def cleaned_cells(spark: SparkSession, sf: str) -> DataFrame:
    cells = F.split("text", "\n").alias("raw_data")
    rows = formatting.clean_cells(texts(spark, sf, "documents", "doc_id").select("doc_id", cells))
    return rows.select("doc_id", digest(F.array_join("raw_data", "|")))


@query
def option_letters(spark: SparkSession, sf: str) -> DataFrame:
    lettered = texts(spark, sf, "documents", "doc_id").select(
        "doc_id", formatting.options_to_letters(F.split("text", "\n")).alias("o")
    )
    pairs = F.transform(F.map_entries("o"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return lettered.select(
        "doc_id", F.size("o").cast("long").alias("letters"), digest(F.array_join(pairs, "|"))
    )


@query
def dialogue_hash(spark: SparkSession, sf: str) -> DataFrame:
    return dialogues.with_dialogue_hash(views.dialogue_lines(spark, sf)).select("doc_id", "hash")


@query
def dialogue_hash_turns(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").withColumnRenamed("text", "content")
    return dialogues.hash_turns(turns, "conv_id", "turn")


@query
def flat_annotations(spark: SparkSession, sf: str) -> DataFrame:
    notes = F.struct(
        F.struct("quality", "toxic").alias("labels"), F.struct(F.struct("lang").alias("text")).alias("meta")
    )
    docs = views.dialogue_lines(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    flat = formatting.flatten_annotations(
        docs.withColumn("dialogue_annotation", notes), keep=["doc_id"]
    )
    return flat.select(
        "doc_id", F.col("`labels.quality`").alias("quality"), F.col("`labels.toxic`").alias("toxic"),
        F.col("`meta.text.lang`").alias("lang"), F.col("turn_count").cast("long").alias("turn_count"),
    )


@query
def unpacked_lists(spark: SparkSession, sf: str) -> DataFrame:
    return formatting.unpack_lists(table(spark, sf, "embeddings"))


@query
def response_content(spark: SparkSession, sf: str) -> DataFrame:
    said = F.col("text")
    failed = F.to_json(F.struct(F.lit("timeout").alias("error"), said.alias("detail")))
    response = (
        F.when(F.col("turn") % 3 == 0, views.envelope(said))
        .when(F.col("turn") % 3 == 1, said)
        .otherwise(failed)
    )
    turns = texts(spark, sf, "conversations", "conv_id", "turn")
    return turns.select("conv_id", "turn", digest(answers.extract_content(response)))


@query
def duplicate_hashes(spark: SparkSession, sf: str) -> DataFrame:
    hashed = dialogues.with_dialogue_hash(views.dialogue_lines(spark, sf))
    return dialogues.duplicate_groups(hashed, "doc_id")


@query
def deduplicated(spark: SparkSession, sf: str) -> DataFrame:
    hashed = dialogues.with_dialogue_hash(views.dialogue_lines(spark, sf))
    return dialogues.dedup_by_hash(hashed, "doc_id").select("doc_id", "lang")


# --- Prompts -------------------------------------------------------------------------


@query
def prompt_render(spark: SparkSession, sf: str) -> DataFrame:
    asked = evaluation.prompts(views.samples(spark, sf), TEMPLATE)
    return asked.select(
        "doc_id", F.length("prompt").cast("long").alias("prompt_length"), digest(F.col("prompt"))
    )


@query
def chat_request(spark: SparkSession, sf: str) -> DataFrame:
    body = prompts.to_chat_request(F.col("text"), "judge", {"max_tokens": 16, "stream": False})
    return texts(spark, sf, "documents", "doc_id").select("doc_id", digest(body))


@query
def generation_groups(spark: SparkSession, sf: str) -> DataFrame:
    pair = lambda *kv: F.create_map(*[F.lit(x) for x in kv])
    overrides = (
        F.when(F.col("doc_id") % 3 == 0, pair("temperature", "0.7"))
        .when(F.col("doc_id") % 3 == 1, pair("top_p", "0.5", "max_new_tokens", "64"))
    )
    defaults = {"temperature": "0.1", "top_p": "0.95"}
    key = prompts.generation_group_key(defaults, overrides)
    docs = table(spark, sf, "documents").select(key.alias("params"))
    return docs.groupBy("params").agg(F.count(F.lit(1)).alias("n"))


@query
def model_responses(spark: SparkSession, sf: str) -> DataFrame:
    def load():
        return lambda prompts: ["ABCD"[len(p) % 4] for p in prompts]

    docs = texts(spark, sf, "documents", "doc_id").select("doc_id", F.col("text").alias("prompt"))
    answered = inference.apply_model(docs, load, batch_size=64)
    return answered.select("doc_id", "response", "error")


@query
def model_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    def load():
        return lambda prompts: [f"答案是{'ABCD'[len(p) % 4]}" for p in prompts]

    done = evaluation.evaluate_model(
        views.samples(spark, sf), "{scene}", load, model="length", dataset="documents"
    )
    return rounded(done.metrics, "overall")


# --- Answers -------------------------------------------------------------------------


@query
def choice_answers(spark: SparkSession, sf: str) -> DataFrame:
    docs = texts(spark, sf, "documents", "doc_id")
    return docs.select("doc_id", answers.extract_choice(F.col("text")).alias("answer"))


def _reading_response() -> Column:
    turn = F.col("turn") % 4
    said = F.col("text")
    return (
        F.when(turn == 0, F.concat(F.lit("　答案是： "), said))
        .when(turn == 1, F.concat(F.lit('根据文本，"'), said, F.lit('"。')))
        .when(turn == 2, F.concat(F.lit('"'), said, F.lit('"\n')))
        .otherwise(said)
    )


@query
def reading_answers(spark: SparkSession, sf: str) -> DataFrame:
    turns = texts(spark, sf, "conversations", "conv_id", "turn")
    return turns.select("conv_id", "turn", answers.extract_reading(_reading_response()).alias("answer"))


@query
def answers_by_task(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("role") == "assistant", "reading_comprehension").otherwise("choice")
    turns = texts(spark, sf, "conversations", "conv_id", "turn")
    return turns.select(
        "conv_id", "turn", answers.extract_answer(_reading_response(), kind).alias("answer")
    )


@query
def parsed_scores(spark: SparkSession, sf: str) -> DataFrame:
    events = texts(spark, sf, "events", "event_id")
    return events.select(
        "event_id",
        answers.parse_score(F.col("props")).cast("long").alias("score"),
        answers.parse_score(F.col("event_type")).cast("long").alias("no_score"),
        answers.parse_score(F.col("props"), 10, 50).cast("long").alias("wide_score"),
    )


@query
def scored_results(spark: SparkSession, sf: str) -> DataFrame:
    questions = views.samples(spark, sf)
    scored = scoring.score_results(questions, views.responses(questions), check_unique=True)
    return scored.select("doc_id", "model", "predicted_answer", "is_correct")


def _token_logprobs(spark: SparkSession, sf: str) -> DataFrame:
    at = F.col("pos")
    option = F.when(at < 10, "A").when(at < 25, "B").when(at < 45, "C").otherwise("D")
    long = texts(spark, sf, "embeddings", "vec_id").select(
        F.col("vec_id").alias("question_id"), F.posexplode("embedding").alias("pos", "logprob")
    )
    return long.withColumn("option", option)


@query
def picked_by_mean(spark: SparkSession, sf: str) -> DataFrame:
    scored = scoring.option_scores(_token_logprobs(spark, sf), how="mean")
    return rounded(scoring.pick_option(scored), "score")


@query
def picked_by_sum(spark: SparkSession, sf: str) -> DataFrame:
    scored = scoring.option_scores(_token_logprobs(spark, sf), how="sum")
    return rounded(scoring.pick_option(scored), "score")


@query
def classified(spark: SparkSession, sf: str) -> DataFrame:
    labels = [f"class_{i}" for i in range(64)]
    made = texts(spark, sf, "embeddings", "vec_id").select(
        "vec_id", logits.classify_logits(F.col("embedding"), labels).alias("c")
    )
    out = made.select(
        "vec_id", F.col("c.label").alias("label"), F.col("c.score").alias("score"),
        F.size("c.logits").cast("long").alias("logits"),
    )
    return rounded(out, "score")


# --- Metrics -------------------------------------------------------------------------


@query
def accuracy_by_model(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.accuracy(views.results(spark, sf), ["model"]), "overall")


@query
def accuracy_by_run(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.accuracy(views.results(spark, sf), ["model", "dataset"]), "overall")


@query
def label_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Two-class variant: is a document's toxicity told by its quality label?"""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    judged = docs.select("lang", (F.col("quality") != F.col("toxic")).alias("is_correct"))
    return rounded(metrics.accuracy(judged, ["lang"]), "overall")


@query
def single_choice_analysis(spark: SparkSession, sf: str) -> DataFrame:
    scored = views.results(spark, sf)
    known = F.when((F.col("dataset") != "src3") | (F.col("model") != "m1"), F.col("is_correct"))
    reports = run_analyzers(scored.withColumn("is_correct", known), ["single_choice", "unheard_of"])
    return rounded(reports["single_choice"], "overall").withColumn(
        "summary", F.split("summary", ":")[0]
    )


@query
def mutual_by_model(spark: SparkSession, sf: str) -> DataFrame:
    found = metrics.mutual_metrics(views.results(spark, sf), ["model"])
    return rounded(found, "recall_1", "recall_2", "mrr")


@query
def distinct_trigrams(spark: SparkSession, sf: str) -> DataFrame:
    docs = texts(spark, sf, "documents", "doc_id")
    return rounded(metrics.distinct_n(docs, "text", 3, ["lang"]), "distinct_3")


@query
def distinct_words(spark: SparkSession, sf: str) -> DataFrame:
    docs = texts(spark, sf, "documents", "doc_id")
    return rounded(metrics.distinct_n(docs, "text", 1), "distinct_1")


@query
def distinct_per_document(spark: SparkSession, sf: str) -> DataFrame:
    docs = texts(spark, sf, "documents", "doc_id").select(
        "doc_id", text.preprocess(F.col("text")).alias("tokens")
    )
    out = docs.select("doc_id", *metrics.distinct_k(F.col("tokens"), [1, 2, 3]))
    return rounded(out, "distinct_1", "distinct_2", "distinct_3")


def _against_benchmark(spark: SparkSession, sf: str) -> DataFrame:
    """Each document with one benchmark item as its reference."""
    items = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("ref"))
    docs = texts(spark, sf, "documents", "doc_id").select(
        "doc_id", F.pmod("doc_id", F.lit(items.count())).alias("item_id"), F.col("text").alias("hyp")
    )
    return docs.join(items, "item_id")


@query
def rouge_pairs(spark: SparkSession, sf: str) -> DataFrame:
    out = rouge.rouge(_against_benchmark(spark, sf), "hyp", "ref", keep=("doc_id",))
    out = out.drop("rouge_l_f", "rouge_l_p", "rouge_l_r")
    return rounded(out, *[c for c in out.columns if c != "doc_id"])


@query
def rouge_distinct_pairs(spark: SparkSession, sf: str) -> DataFrame:
    out = rouge.rouge(
        _against_benchmark(spark, sf), "hyp", "ref", keep=("doc_id",), counting="distinct"
    )
    out = out.drop("rouge_l_f", "rouge_l_p", "rouge_l_r")
    return rounded(out, *[c for c in out.columns if c != "doc_id"])


@query
def rouge_l_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts of every document; too slow as SQL, checked by brute force in the tests."""
    out = rouge.rouge(_against_benchmark(spark, sf), "hyp", "ref", keep=("doc_id",))
    return rounded(out.select("doc_id", "rouge_l_f", "rouge_l_p", "rouge_l_r"),
                   "rouge_l_f", "rouge_l_p", "rouge_l_r")


@query
def rouge_l_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Each turn against the turn before it."""
    turns = texts(spark, sf, "conversations", "conv_id", "turn")
    turns = turns.select("conv_id", "turn", F.col("text").alias("hyp"))
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("hyp").alias("ref"))
    pairs = turns.join(before, ["conv_id", "turn"])
    out = rouge.rouge(pairs, "hyp", "ref", keep=("conv_id", "turn"))
    return rounded(out.select("conv_id", "turn", "rouge_l_f", "rouge_l_p", "rouge_l_r"),
                   "rouge_l_f", "rouge_l_p", "rouge_l_r")


@query
def arriving_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """The responses once more, read as a stream of files."""
    path, state = new_folder(spark, "arriving"), new_folder(spark, "arriving-state")
    schema = "question_id string, model string, response string"
    questions = views.samples(spark, sf)
    views.responses(questions).select("question_id", "model", "response").write.json(path)
    asked = questions.select("question_id", "correct_answer")
    running = running_accuracy(asked, read_responses(spark, path, schema))
    name = "arriving_" + state.rsplit("-", 1)[-1]
    job = (
        running.writeStream.outputMode("complete").format("memory").queryName(name)
        .option("checkpointLocation", state).trigger(availableNow=True).start()
    )
    job.awaitTermination()
    return rounded(spark.table(name), "overall")


# --- Samples -------------------------------------------------------------------------


@query
def sampled(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return sampling.sample_n(docs, 100, ["doc_id"]).select("doc_id", "lang")


@query
def sampled_below_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """A sample drawn by a hash threshold, as on tables too large for a top-k."""
    events = table(spark, sf, "events").select("event_id", "event_type")
    return sampling.sample_n(events, 4000, ["event_id"], seed=7, single_task_rows=1000)


@query
def first_rows(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    return sampling.take(docs, 50, ["n_chars", "doc_id"], single_task_rows=10)


@query
def united_samples(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", digest(F.col("text")))
    items = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("doc_id"), digest(F.col("text"))
    )
    return sampling.union_samples([docs, items])


# --- Text ----------------------------------------------------------------------------


@query
def cleaned_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = texts(spark, sf, "pages", "page_id")
    pages = pages.select("page_id", text.clean_text(F.col("html")).alias("clean"))
    return pages.select("page_id", F.length("clean").cast("long").alias("n"), digest(F.col("clean")))


@query
def document_tokens(spark: SparkSession, sf: str) -> DataFrame:
    docs = texts(spark, sf, "documents", "doc_id").select(
        "doc_id", text.preprocess(F.col("text"), STOP_WORDS).alias("tokens")
    )
    return docs.select(
        "doc_id", F.size("tokens").cast("long").alias("n"), digest(F.array_join("tokens", " "))
    )


@query
def document_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    docs = texts(spark, sf, "documents", "doc_id")
    docs = docs.select("doc_id", text.tokenize(F.col("text")).alias("t"))
    grams = docs.select("doc_id", text.ngrams(F.col("t"), 3).alias("g"))
    joined = F.array_join(F.transform("g", lambda g: F.array_join(g, " ")), "|")
    return grams.select("doc_id", F.size("g").cast("long").alias("n"), digest(joined))


@query
def filtered_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Turn tokens without any word that occurs in the benchmark."""
    path = new_folder(spark, "words")
    table(spark, sf, "benchmark").select(F.explode(text.tokenize(F.col("text")))).write.text(path)
    words = sources.read_stop_words(spark, path)
    turns = texts(spark, sf, "conversations", "conv_id", "turn").select(
        "conv_id", "turn", text.tokenize(F.col("text")).alias("tokens")
    )
    kept = sources.stop_word_filter(turns, ["conv_id", "turn"], "tokens", words)
    return kept.select(
        "conv_id", "turn", F.size("tokens").cast("long").alias("n"),
        digest(F.array_join("tokens", " ")),
    )


@query
def page_names(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    formatter = F.concat(
        F.element_at(F.split("url", "/"), 3),
        F.when(F.col("page_id") % 3 == 0, "Formatter").when(F.col("page_id") % 3 == 1, "_format").otherwise(""),
    )
    remote = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("remote-"), "page_id"))
    return pages.select(
        "page_id", text.safe_name(F.col("url")).alias("file_name"),
        text.dataset_name(formatter).alias("dataset"),
        text.model_name(remote, F.split("url", "[?#]")[0], F.lit("local")).alias("model"),
    )


@query
def printed_scores(spark: SparkSession, sf: str) -> DataFrame:
    value = F.when(F.col("event_type") != "error", F.col("value"))
    events = texts(spark, sf, "events", "event_id")
    return events.select(
        "event_id", text.format_score(value).alias("printed"),
        text.round2(value / 3).alias("third"),
    )


# --- Scores and reports --------------------------------------------------------------


@query
def minmax_scores(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.minmax_by_dataset(views.kept_scores(spark, sf))


@query
def scaled_summary(spark: SparkSession, sf: str) -> DataFrame:
    scaled = rollup.minmax_by_dataset(views.kept_scores(spark, sf))
    return rounded(rollup.normalization_summary(scaled), "avg_score")


@query
def score_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return rollup.coverage(views.scores(spark, sf))


@query
def scored_datasets(spark: SparkSession, sf: str) -> DataFrame:
    """Data sets with scores, and whether the weight tree names them."""
    named = rollup.datasets_in(sources.weights_frame(spark, views.NODES))
    _, found = rollup.discover(views.scores(spark, sf))
    return found.join(named.withColumn("in_tree", F.lit(True)), "dataset", "left").select(
        "dataset", F.coalesce("in_tree", F.lit(False)).alias("in_tree")
    )


def _levels(spark: SparkSession, sf: str, normalized: bool = True) -> reporting.Report:
    return reporting.report(views.kept_scores(spark, sf), views.NODES, normalized)


@query
def rollup_levels(spark: SparkSession, sf: str) -> DataFrame:
    levels = _levels(spark, sf, normalized=False).level_scores
    out = levels.select(
        F.col("pos").cast("long").alias("pos"), "path", "model", "score"
    )
    return rounded(out, "score")


@query
def top_two_marks(spark: SparkSession, sf: str) -> DataFrame:
    marked = ranking.mark_top2(_levels(spark, sf).level_scores)
    return marked.select("path", "model", F.col("mark").cast("long").alias("mark"))


@query
def model_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    board = _levels(spark, sf).ranking
    return rounded(board, "total", *ranking.RANKED_DIMENSIONS, ranking.GATE_DIMENSION)


@query
def leaderboard_files(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "leaderboard")
    sinks.write_leaderboard(_levels(spark, sf).level_scores, path)
    board = spark.read.parquet(path)
    return rounded(board, "total", *ranking.RANKED_DIMENSIONS, ranking.GATE_DIMENSION)


@query
def level_files(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "levels")
    written = sinks.write_level_tables(_levels(spark, sf).level_scores, path)
    return spark.read.parquet(written[2]).drop("pos")


@query
def level_two_table(spark: SparkSession, sf: str) -> DataFrame:
    out = ranking.level_table(_levels(spark, sf).level_scores, 2, views.MODELS)
    return out.withColumn("pos", F.col("pos").cast("long"))


@query
def report_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = ranking.order_report_rows(_levels(spark, sf).level_scores, 3)
    return rows.select(F.col("pos").cast("long").alias("pos"), "path", "goes_last")


@query
def report_spans(spark: SparkSession, sf: str) -> DataFrame:
    rows = ranking.order_report_rows(_levels(spark, sf).level_scores, 3)
    spans = ranking.merge_spans(rows)
    return spans.select(
        F.col("depth").cast("long").alias("depth"), F.col("first_row").cast("long").alias("first_row"),
        "value", F.col("span").cast("long").alias("span"),
    )


@query
def summary_record(spark: SparkSession, sf: str) -> DataFrame:
    questions = views.samples(spark, sf)
    done = evaluation.evaluate(questions, views.responses(questions), by=["model"])
    counts = done.metrics.select("model", "correct_count", "total_count")
    record = sinks.summary_record(done.results, counts, ["SingleChoiceTask"])
    return record.select(
        "total_samples", F.array_join("tasks_run", ",").alias("tasks_run"),
        F.array_join("metrics", "\n").alias("metrics"),
    )
