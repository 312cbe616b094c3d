"""Training-data pipeline: language, exact copies, near copies, test items, token round trip."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeflow.llm import bpe, contamination, exact, langid, near
from gradeflow.llm.common import remove_scratch, scratch_count, scratch_since, unread, written

# Mean probability of the predicted language below which a text is rejected: this part of the way
# from a guess among the learned languages to certainty, 0.4 for four languages.
LEAST_SURE = 0.2

# Scratch folders of stages whose result may still be unwritten.
_held: list = []

# Models, similarity links and token ids cannot be written in SQL; tests use brute force.
ORACLE_SQL = None


def stage(step):
    """A stage whose scratch tables go when the next stage starts.

    A stage's result has been written by then, as stages are applied to one another's written
    results; tables that ``docs`` itself still reads stay. Columns of ``docs`` are returned under
    their own names, whatever these are.
    """
    @functools.wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        gone = unread(_held, docs)
        remove_scratch(gone)
        _held[:] = [f for f in _held if f not in gone]
        before = scratch_count()
        out = step(spark, docs, sf_dir)
        _held.extend(scratch_since(before))
        return out

    return run_step


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a clear language, go.

    The least score is ``LEAST_SURE`` of the way from 1 / languages to 1; a single language rejects
    nothing. Labels teach from the rows that are not held out, or from all rows if none of those
    is labelled. Where no row is labelled, nothing can be told apart and every document with a
    letter stays.
    """
    network, languages = langid.fit(docs.where(~langid.held_out()))
    if not languages:
        network, languages = langid.fit(docs)
    if not languages:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    marked = langid.identify(docs, network, languages, carry=True)
    return marked.where((F.col("lang_pred") != "und") & (F.col("score") >= least_score(len(languages)))).select("row.*")


def least_score(languages: int) -> float:
    return 1 / languages + LEAST_SURE * (1 - 1 / languages) if languages > 1 else 0.0


@stage
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id stays."""
    own = {c: f"_own_{c}" for c in docs.columns if c in ("keep_id", "group_size", "kept", "text_sha256")}
    kept = exact.exact_dedup(docs.withColumnsRenamed(own)).where("kept")
    return kept.select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar documents, the one with the smallest id stays."""
    gone = near.near_duplicates(docs).where("not kept and doc_id is not null").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a test item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination.contaminated(docs, items, carry=True).where("not contaminated").select("row.*")


@stage
def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and digests of the ids and of what they decode to."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode(docs, ranks, public_tokenizers.PATTERN).drop("decoded")


STAGES = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("near dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written and read again.

    The written rows go once the next stage has read them.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last: list = []
    for name, step in STAGES[:-1]:
        out = step(spark, docs, sf_dir)
        before = scratch_count()
        docs = written(out, name.replace(" ", "-"))
        remove_scratch(last)
        last = scratch_since(before)
    return STAGES[-1][1](spark, docs, sf_dir)
