"""Queries over files cut at any byte, chosen layouts, deeper trees, samples per set, and repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gradeflow import sinks, sources
from gradeflow.functions.canonical import canonical_json
from gradeflow.functions.segmentation import dictionary_tokenizer
from gradeflow.functions.text import tokenize
from gradeflow.operators import metrics, rollup, sampling, scoring
from gradeflow.storage import keep, new_folder
from gradeflow.streaming import read_responses
from gradeflow.streaming.latest import changes

from . import views
from .queries import digest, query, rounded
from .views import table, texts

# path, weight, data set: five levels, a data set without scores, and leaves at three depths.
FIVE_LEVELS = [
    ("A", 1.0, None), ("B", 0.5, None), ("src7", 1.0, "src7"),
    ("A/x", 0.6, None), ("A/y", 0.4, None), ("A/src6", 0.2, "src6"), ("B/none", 1.0, None),
    ("A/x/p", 1.0, None), ("A/x/q", 2.0, None), ("A/y/r", 1.0, None), ("B/none/never_run", 1.0, "never_run"),
    ("A/x/p/i", 1.0, None), ("A/x/p/j", 0.5, None), ("A/x/q/k", 1.0, None), ("A/y/r/l", 1.0, None),
    ("A/x/p/i/src0", 1.0, "src0"), ("A/x/p/i/src1", 0.5, "src1"), ("A/x/p/j/src2", 1.0, "src2"), ("A/x/p/j/src3", 0.0, "src3"),
    ("A/x/q/k/src4", 1.0, "src4"), ("A/x/q/k/src12", 2.0, "src12"), ("A/y/r/l/src5", 1.0, "src5"), ("A/y/r/l/src13", 1.0, "src13"),
]


def _quoted(cell):
    return F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))


@query
def csv_split(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts as quoted cells, line breaks and all; row numbers follow the files' order."""
    path = new_folder(spark, "csv-split")
    docs = texts(spark, sf, "documents", "doc_id").select("doc_id", "lang", "text").sortWithinPartitions("doc_id")
    line = F.concat_ws(",", F.col("doc_id").cast("string"), "lang", _quoted(F.col("text")))
    docs.select(line).write.text(path)
    rows = sources.read_csv(spark, path, sep=",", skip_header=False, suffix="txt")
    out = rows.select(F.get("raw_data", F.lit(0)).cast("long").alias("doc_id"), F.get("raw_data", F.lit(1)).alias("lang"),
                      digest(F.get("raw_data", F.lit(2))), "_source_file", "_row_index")
    place = F.row_number().over(Window.partitionBy("_source_file").orderBy("doc_id")) - 1
    return out.select("doc_id", "lang", "digest", (F.col("_row_index") == place).alias("in_order"))


@query
def csv_ragged(spark: SparkSession, sf: str) -> DataFrame:
    """A record's cells are the lines of a document, so every record has its own width."""
    path = new_folder(spark, "csv-ragged")
    cells = F.array_join(F.transform(F.split("text", "\n"), _quoted), ",")
    table(spark, sf, "documents").select(F.concat_ws(",", F.col("doc_id").cast("string"), cells)).write.text(path)
    rows = sources.read_csv(spark, path, sep=",", skip_header=False, suffix="txt")
    filled = F.filter(F.slice("raw_data", 2, F.size("raw_data") - 1), lambda c: c != "")
    return rows.select(F.get("raw_data", F.lit(0)).cast("long").alias("doc_id"), F.size(filled).cast("long").alias("cells"),
                       F.size("raw_data").cast("long").alias("width"), digest(F.array_join(filled, "|")))


@query
def csv_delimiters(spark: SparkSession, sf: str) -> DataFrame:
    """Three kinds of files in one folder, each with a delimiter of its own."""
    path = new_folder(spark, "csv-delimiters")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").cast("string").alias("day"))
    kind = F.col("o_orderkey") % 3
    cells = [F.col(c).cast("string") for c in ("o_orderkey", "o_custkey", "day")]
    line = F.when(kind == 0, F.concat_ws(";", *cells)).when(kind == 1, F.concat_ws("|", *cells)).otherwise(F.concat_ws(",", *cells))
    orders.select(kind.alias("kind"), line.alias("value")).write.partitionBy("kind").text(path)
    rows = sources.read_csv(spark, path, skip_header=False, recursive=True, suffix="txt")
    cell = lambda i: F.get("raw_data", F.lit(i))
    return rows.select(cell(0).cast("long").alias("o_orderkey"), cell(1).cast("long").alias("o_custkey"), cell(2).alias("day"))


@query
def json_split(spark: SparkSession, sf: str) -> DataFrame:
    """All documents of a source as one JSON array."""
    path = new_folder(spark, "json-split")
    docs = table(spark, sf, "documents").select(F.col("source").alias("part"), "doc_id", F.to_json(F.struct("doc_id", "source", "text")).alias("body"))
    first = docs.groupBy("part").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    opening, closing = F.when(F.col("doc_id") == F.col("first"), "[").otherwise(","), F.when(F.col("doc_id") == F.col("last"), "]").otherwise("")
    lines = docs.join(F.broadcast(first), "part").select("part", "doc_id", F.concat(opening, "body", closing).alias("value"))
    ordered = lines.repartition("part").sortWithinPartitions("part", "doc_id")
    ordered.select("part", "value").write.partitionBy("part").text(path)
    rows = sources.read_json(spark, path, "doc_id long, source string, text string", recursive=True, suffix="txt")
    return rows.select("doc_id", "source", digest(F.col("text")), F.col("_row_index").alias("row_index"))


@query
def excluded_files(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "excluded")
    docs = table(spark, sf, "documents").select("lang", F.to_json(F.struct("doc_id")).alias("value"))
    docs.write.partitionBy("lang").text(path)
    return sources.read_jsonl(spark, path, "doc_id long", recursive=True, suffix="txt", exclude_path_patterns=["lang=fr", "lang=de"]).select("doc_id")


@query
def json_written(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{new_folder(spark, 'json-written')}/docs.json"
    sinks.write_json(table(spark, sf, "documents").select("doc_id", "lang", "text"), path)
    return spark.read.schema("doc_id long, lang string, text string").json(path).select("doc_id", "lang", digest(F.col("text")))


@query
def chunk_files(spark: SparkSession, sf: str) -> DataFrame:
    """Numbered arrays of 300 documents in order."""
    path = new_folder(spark, "chunks")
    sinks.write_chunks(table(spark, sf, "documents").select("doc_id", "lang", "text"), path, "part", 300, ["doc_id"])
    rows = sources.read_json(spark, path, "doc_id long, lang string, text string")
    return rows.select("doc_id", "lang", digest(F.col("text")), F.element_at(F.split("_source_file", "/"), -1).alias("file"),
                       F.col("_row_index").alias("row_index"))


@query
def score_tree(spark: SparkSession, sf: str) -> DataFrame:
    path = new_folder(spark, "score-tree")
    sinks.write_score_tree(metrics.accuracy(views.results(spark, sf), ["model", "dataset"]), path)
    return sources.valid_scores(sources.read_scores(spark, path))


@query
def rollup_five_levels(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(p, p.rpartition("/")[0] or None, p.count("/") + 1, w, d) for p, w, d in FIVE_LEVELS]
    nodes = spark.createDataFrame(rows, "path string, parent_path string, level int, weight double, dataset string")
    return rounded(rollup.rollup_table(views.scores(spark, sf), nodes).select("model", "path", "score"), "score")


@query
def samples_per_dataset(spark: SparkSession, sf: str) -> DataFrame:
    sizes = {"src0": 5, "src1": 40, "src2": -1, "src3": 1_000_000, "src4": 17}
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return sampling.sample_each(docs, "source", sizes, ["doc_id"], 3)


def _sent_again(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Every response; every third also with an earlier, wrong one; every fifth twice."""
    questions = views.samples(spark, sf)
    said = views.responses(questions).select("question_id", "model", F.lit(2).alias("sent"), "response")
    number = F.conv(F.substring("question_id", 1, 6), 16, 10).cast("long")
    earlier = said.where(number % 3 == 0).withColumn("sent", F.lit(1)).withColumn("response", F.lit("答案是：E"))
    return questions, said.union(earlier).union(said.where(number % 5 == 0))


@query
def repeated_responses(spark: SparkSession, sf: str) -> DataFrame:
    questions, sent = _sent_again(spark, sf)
    return rounded(metrics.accuracy(scoring.score_results(questions, sent, last_by=["sent"]), ["model"]), "overall")


@query
def arriving_twice(spark: SparkSession, sf: str) -> DataFrame:
    """The same responses as a stream; counts are sums of changes."""
    path, state, out = (new_folder(spark, f"twice{x}") for x in ("", "-state", "-out"))
    questions, sent = _sent_again(spark, sf)
    sent.write.json(path)
    stream = read_responses(spark, path, "question_id string, model string, sent int, response string")
    found = changes(scoring.score_results(questions.select("question_id", "correct_answer"), stream))
    job = (found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
           .trigger(availableNow=True).start())
    job.awaitTermination()
    sums = spark.read.parquet(out).groupBy("model").agg(F.sum("correct").alias("correct_count"), F.sum("total").alias("total_count"))
    return rounded(sums.withColumn("overall", F.col("correct_count") / F.col("total_count")), "overall")


@query
def segmented_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns without their spaces, cut into words again by the benchmark's words and single letters."""
    items = table(spark, sf, "benchmark").select(F.explode(tokenize(F.lower("text"))).alias("word")).where("word rlike '^[a-z]+$'")
    letters = spark.range(26).select(F.char(F.col("id") + 97).alias("word"))
    words = items.groupBy("word").agg(F.count("*").alias("freq")).union(letters.withColumn("freq", F.lit(1)))
    cut = dictionary_tokenizer(words, unspaced="[a-z]+")
    run = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    turns = texts(spark, sf, "conversations", "conv_id", "turn").select("conv_id", "turn", cut(run).alias("w"))
    squares = F.aggregate("w", F.lit(0).cast("long"), lambda a, w: a + F.length(w) * F.length(w))
    return turns.select("conv_id", "turn", F.size("w").cast("long").alias("n"), squares.alias("squares"))


@query
def unclean_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of raw pages: digits, accents and marks included."""
    cut = dictionary_tokenizer({"的": 1.0})
    pages = texts(spark, sf, "pages", "page_id").select("page_id", cut(F.col("html")).alias("w"))
    return pages.select("page_id", F.size("w").cast("long").alias("n"), digest(F.array_join("w", " ")))


@query
def all_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Every registered tool over the same results in one aggregation; one name is unknown."""
    found = metrics.measure(views.results(spark, sf), ["Accuracy", "Mutual", "unheard_of"], ["model", "dataset"])
    return rounded(found, "overall", "recall_1", "recall_2", "mrr")


@query
def hashed_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Content hashes of records that hold doubles."""
    rows = table(spark, sf, "embeddings").select("vec_id", F.struct("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).alias("r"))
    return rows.select("vec_id", F.sha2(canonical_json(F.col("r"), rows.schema["r"].dataType), 256).alias("hash"))


@query
def distinct_sketched(spark: SparkSession, sf: str) -> DataFrame:
    """Stored sketches of four parts, united, next to the exact counts."""
    docs = texts(spark, sf, "documents", "doc_id")
    parts = keep(metrics.distinct_sketches(docs.withColumn("part", F.expr("pmod(doc_id, 4)")), "text", 3, ["lang", "part"]), "sketches")
    guess = metrics.distinct_united(parts, 3, ["lang"]).select(F.col("lang").alias("of"), F.col("distinct_ngrams").alias("guess"))
    exact = metrics.distinct_n(docs, "text", 3, ["lang"])
    return exact.join(guess, exact.lang.eqNullSafe(guess.of)).select(
        "lang", "distinct_ngrams", "total_ngrams", F.expr("abs(guess - distinct_ngrams) <= 0.02 * distinct_ngrams").alias("close"))
