"""Scoring responses (R5) and options."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.answers import extract_choice, extract_content
from ..registry import tasks


def require_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fail the job if ``keys`` repeat.

    The window needs the exchange and sort that a sort-merge join on the same keys
    needs anyway, so the check adds no shuffle to that join.
    """
    count = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    message = F.concat(F.lit("duplicate key: "), F.to_json(F.struct(*keys)))
    checked = F.when(F.col("_copies") == 1, F.lit(True)).otherwise(
        F.raise_error(message).cast("boolean")
    )
    return df.withColumn("_copies", count).filter(checked).drop("_copies")


def last_responses(responses: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One response per key: the last by ``order``; equal ones by their whole content.

    ``max_by`` combines in the tasks that read, so a key that was sent very often moves one row
    from each.
    """
    rest = [c for c in responses.columns if c not in key]
    whole = F.struct(*[F.col(f"`{c}`") for c in rest])
    at = F.struct(*[F.col(f"`{c}`") for c in order], F.to_json(whole).alias("_content"))
    last = responses.groupBy(*key).agg(F.max_by(whole, at).alias("_last"))
    return last.select(*key, *[F.col("_last")[c].alias(c) for c in rest])


def score_columns(df: DataFrame, response: str = "response", extract=extract_choice) -> DataFrame:
    """R5 where sample and response already share a row."""
    answered = df.withColumn("raw_answer", extract_content(F.col(response)))
    answered = answered.withColumn("predicted_answer", extract(F.col("raw_answer")))
    return _mark_correct(answered.drop(response))


def _mark_correct(df: DataFrame) -> DataFrame:
    gold = F.coalesce(F.col("correct_answer"), F.lit(""))
    return df.withColumn("is_correct", F.col("predicted_answer") == gold)


@tasks.register("SingleChoiceTask")
def score_results(
    samples: DataFrame,
    responses: DataFrame,
    on: Sequence[str] = ("question_id",),
    response: str = "response",
    extract=extract_choice,
    how: str = "inner",
    check_unique: bool = True,
    run: Sequence[str] = ("model", "dataset"),
    last_by: Sequence[str] | None = None,
) -> DataFrame:
    """Responses joined to their samples, with predicted answer and correctness.

    The prediction is made on the response side before the join, so that a plan which
    only needs correctness shuffles a letter, not the text.  A sample key that repeats
    would multiply rows and so falsify every count, and so would a question that a run
    answers twice (``run`` names a run, by those of its columns that the responses have):
    the job fails, unless ``check_unique=False`` says that this is wanted.  With
    ``last_by`` the last response by these columns counts, ties by content, and the others do
    not.  On a stream only samples are checked; see ``streaming.latest`` for what is sent again.
    """
    left = require_unique(samples, on) if check_unique else samples
    right = responses.withColumn("raw_answer", extract_content(F.col(response)))
    right = right.withColumn("predicted_answer", extract(F.col("raw_answer"))).drop(response)
    whose = [*on, *(c for c in run if c in right.columns and c not in on)]
    if last_by is not None:
        right = last_responses(right, whose, last_by)
    joined = left.join(right, list(on), how)
    if check_unique and last_by is None and not joined.isStreaming:
        # Rows already stand by ``on`` here, so the check adds no shuffle to a join that shuffles.
        joined = require_unique(joined, whose)
    return _mark_correct(joined)


def option_scores(
    token_logprobs: DataFrame,
    key: Sequence[str] = ("question_id",),
    option: str = "option",
    logprob: str = "logprob",
    how: str = "mean",
) -> DataFrame:
    """One score per option, the mean or the sum of its token log-probabilities."""
    combine = {"mean": F.avg, "sum": F.sum}[how]
    return token_logprobs.groupBy(*key, option).agg(combine(logprob).alias("score"))


def pick_option(
    scores: DataFrame,
    key: Sequence[str] = ("question_id",),
    option: str = "option",
    position: str | None = None,
) -> DataFrame:
    """The option with the highest score; the first option wins ties.

    "First" is by ``position`` where the table has one, else by option name.
    ``min_by`` combines map-side, so a question with very many options still sends
    one row per task.
    """
    ordering = F.struct(-F.col("score"), F.col(position or option))
    return scores.groupBy(*key).agg(
        F.min_by(option, ordering).alias(option), F.max("score").alias("score")
    )
