"""Scoring responses while they arrive.

Extraction and scoring are stateless, so a stream of responses joins a static sample
table row by row; the running accuracy is an ordinary streaming aggregate whose state
is one row per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ..operators.metrics import accuracy
from ..operators.scoring import score_results

RESPONSE_SCHEMA = "question_id string, model string, response string"


def read_responses(
    spark: SparkSession, path: str, schema: str = RESPONSE_SCHEMA, files_per_trigger: int = 1000
) -> DataFrame:
    """JSON-lines responses from files as they are added to a folder."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def running_accuracy(samples: DataFrame, responses: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Accuracy so far; write it in ``complete`` or ``update`` mode."""
    return accuracy(score_results(samples, responses), by)
