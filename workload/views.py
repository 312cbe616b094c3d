"""Frames the queries share, derived from the given tables by plain arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeflow.operators.formatting import NEWS, accepted, format_classification
from gradeflow.operators.metrics import accuracy
from gradeflow.operators.rollup import scores_from_metrics
from gradeflow.operators.scoring import score_results
from gradeflow.sizes import spread
from gradeflow.sources.weights import flatten_weights
from gradeflow.storage import keep, new_folder

MODELS = ["m0", "m1", "m2", "m3", "m4"]
LANG_LABEL = {"en": "1", "fr": "2", "de": "3", "es": "4"}
NEXT_LETTER = {"A": "B", "B": "C", "C": "D", "D": "A"}

# Data sets for which the last model has no score.
UNSCORED = ["src12", "src13", "src14", "src15"]

# A weight tree over the twenty sources: one source under two parents, two leaves
# without scores, and one inner node without any scored child.
TREE = {
    "Basic_Capabilities": {"weight": 1.0, "children": {
        "Understanding": {"weight": 1.0, "children": {
            "src0": {"weight": 1.0}, "src1": {"weight": 0.5}, "src2": {}}},
        "Reasoning": {"weight": 0.55, "children": {
            "src3": {"weight": 1.0}, "src4": {"weight": 1.0}, "src5": {"weight": 2.0}}},
        "Generation": {"weight": 0.15, "children": {
            "src6": {"weight": 1.0}, "no_such_set": {"weight": 1.0}}}}},
    "Emotional_Intelligence": {"weight": 1.0, "children": {
        "Recognition": {"weight": 0.3, "children": {
            "src7": {"weight": 1.0}, "src8": {"weight": 1.0}, "src9": {"weight": 1.0}}},
        "Response": {"weight": 0.7, "children": {
            "src10": {"weight": 1.0}, "src11": {"weight": 1.0}, "src12": {"weight": 1.0}}}}},
    "Companionship_Ability": {"weight": 1.0, "children": {
        "Memory": {"weight": 0.6, "children": {"src13": {"weight": 1.0}, "src14": {"weight": 1.0}}},
        "Response": {"weight": 0.4, "children": {"src15": {"weight": 1.0}, "src12": {"weight": 0.5}}}}},
    "Values_and_Safety": {"weight": 1.0, "children": {
        "Values": {"weight": 0.4, "children": {"src16": {"weight": 1.0}, "src17": {"weight": 1.0}}},
        "Safety": {"weight": 0.6, "children": {"src18": {"weight": 1.0}, "src19": {"weight": 1.0}}},
        "Open": {"weight": 1.0, "children": {"never_run": {"weight": 1.0}}}}},
}
NODES = flatten_weights(TREE)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str, *key: str) -> DataFrame:
    """A table whose rows are costly to work on, over all cores."""
    return spread(table(spark, sf, name), *key)


def choose(key: Column, mapping: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), key)


def formatted(docs: DataFrame, label: Column | None = None) -> DataFrame:
    """All documents as topic questions; the language is the gold class."""
    return format_classification(
        docs, NEWS,
        label=choose(F.col("lang"), LANG_LABEL) if label is None else label,
        title=F.col("source"), description=F.col("text"),
        id_parts=[F.col("doc_id")], keep=["doc_id", "lang", "source"],
    )


def questions_of(docs: DataFrame) -> DataFrame:
    return accepted(formatted(docs))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return questions_of(texts(spark, sf, "documents", "doc_id"))


def wording(letter: Column, doc_id: Column) -> Column:
    """The letter in one of eight wordings; the last two give no answer."""
    form = F.pmod(doc_id, F.lit(8))
    return (
        F.when(form == 0, F.concat(F.lit("答案是：\n"), letter))
        .when(form == 1, F.concat(F.lit("选择: "), F.lower(letter)))
        .when(form == 2, F.concat(F.lit("这是"), letter, F.lit("选项")))
        .when(form == 3, F.concat(F.lit("Thinking aloud\r\n  "), letter, F.lit(" \nDone")))
        .when(form == 4, F.concat(F.lit("会选择选项"), letter))
        .when(form == 5, F.concat(F.lit("The best choice is ("), F.lower(letter), F.lit(").")))
        .when(form == 6, F.lit("No option fits, 选A吧"))
        .otherwise(F.lit(" \n"))
    )


def envelope(content: Column) -> Column:
    message = F.struct(F.struct(content.alias("content")).alias("message"))
    return F.to_json(F.struct(F.array(message).alias("choices")))


def responses(questions: DataFrame) -> DataFrame:
    """One response per sample and model; every second block of eight is an envelope."""
    doc = F.col("doc_id")
    gold = F.col("correct_answer")
    asked = questions.select(
        "question_id", "doc_id", "source", "correct_answer",
        F.posexplode(F.array(*[F.lit(m) for m in MODELS])).alias("m", "model"),
    )
    right = F.pmod(doc * 7 + F.col("m") * 3, F.lit(10)) < F.col("m") + 5
    picked = F.when(right, gold).otherwise(choose(gold, NEXT_LETTER))
    said = asked.withColumn("letter", picked).withColumn("said", wording(F.col("letter"), doc))
    wrapped = F.when(F.floor(doc / 8) % 2 == 1, envelope(F.col("said"))).otherwise(F.col("said"))
    return said.select(
        "question_id", "model", F.col("source").alias("dataset"), wrapped.alias("response")
    )


def results(spark: SparkSession, sf: str) -> DataFrame:
    questions = samples(spark, sf)
    return score_results(questions, responses(questions))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Percent scores by model and source, null where the last model has none."""
    scored = scores_from_metrics(accuracy(results(spark, sf), ["model", "dataset"]))
    absent = (F.col("model") == MODELS[-1]) & F.col("dataset").isin(UNSCORED)
    return scored.withColumn("score", F.when(~absent, F.col("score")))


def kept_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The scores as a written table, as reports read them."""
    return keep(scores(spark, sf), "scores")


def dialogue_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as dialogues: each line is a turn, user and assistant in turn."""
    turns = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.struct(
            F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"), x.alias("content")
        ),
    )
    docs = texts(spark, sf, "documents", "doc_id")
    return docs.select("doc_id", "lang", turns.alias("dialogues"))
