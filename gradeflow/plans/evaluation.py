"""One evaluation as a single lazy plan: load, sample, prompt, respond, score, measure."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.prompts import render_prompt
from ..operators.inference import apply_model
from ..operators.metrics import accuracy
from ..operators.sampling import union_samples
from ..operators.scoring import score_columns, score_results
from .loading import load


@dataclass(frozen=True)
class Evaluation:
    results: DataFrame
    metrics: DataFrame


def load_samples(spark: SparkSession, configs: Sequence[dict]) -> DataFrame:
    """Samples of all configured loaders together."""
    return union_samples([load(spark, c) for c in configs])


def prompts(samples: DataFrame, template: str) -> DataFrame:
    """Samples with their ``prompt``."""
    return samples.withColumn("prompt", render_prompt(samples, template))


def evaluate(
    samples: DataFrame,
    responses: DataFrame,
    by: Sequence[str] = ("model", "dataset"),
    on: Sequence[str] = ("question_id",),
    **scoring,
) -> Evaluation:
    """Score recorded responses of any number of models and measure each run."""
    results = score_results(samples, responses, on=on, **scoring)
    return Evaluation(results, accuracy(results, by))


def evaluate_model(
    samples: DataFrame,
    template: str,
    load_model: Callable[[], Callable[[list[str]], Sequence[str]]],
    model: str,
    dataset: str,
    batch_size: int = 32,
) -> Evaluation:
    """Prompt a model function over the samples and score its answers.

    The answers keep their sample's columns, so scoring needs no join.
    """
    asked = apply_model(prompts(samples, template), load_model, batch_size=batch_size)
    named = asked.withColumn("model", F.lit(model)).withColumn("dataset", F.lit(dataset))
    results = score_columns(named)
    return Evaluation(results, accuracy(results, ["model", "dataset"]))
