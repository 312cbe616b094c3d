"""Running a user's model function over a table of prompts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

ANSWER = "response string, error string"


def apply_model(
    df: DataFrame,
    load: Callable[[], Callable[[list[str]], Sequence[str]]],
    prompt: str = "prompt",
    batch_size: int = 32,
    group_key: str | None = None,
) -> DataFrame:
    """Add ``response`` and ``error`` columns by calling the model on batches of prompts.

    ``load`` runs once per task and returns ``fn(list of prompts) -> list of texts``;
    only the function's code travels, not a loaded model.  A batch that raises gives
    rows with the message in ``error`` and a null response.  With ``group_key`` no
    batch mixes different generation parameters; rows are sorted by it inside their
    partition, so a frequent key is not forced into one task.

    Only the prompt (and the group key) crosses to Python; all other columns stay
    where they are, with their exact values.
    """
    if group_key:
        df = df.sortWithinPartitions(group_key)

    def answers(fn, prompts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            texts = list(fn(prompts))
            if len(texts) != len(prompts):
                raise ValueError(f"{len(texts)} responses for {len(prompts)} prompts")
            return [(text, None) for text in texts]
        except Exception as failure:  # a failing batch must not fail the job
            return [(None, str(failure))] * len(prompts)

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        fn = load()
        for prompts, groups in batches:
            out: list[tuple[str | None, str | None]] = []
            rows = zip(groups.to_pylist(), prompts.to_pylist())
            for _, members in groupby(rows, key=lambda row: row[0]):
                texts = [text for _, text in members]
                for start in range(0, len(texts), batch_size):
                    out += answers(fn, texts[start : start + batch_size])
            responses, errors = zip(*out) if out else ((), ())
            yield pa.StructArray.from_arrays(
                [pa.array(responses, pa.string()), pa.array(errors, pa.string())], ["response", "error"]
            )

    # Not deterministic as far as the optimizer goes: the model is asked once per row.
    ask = F.arrow_udf(run, ANSWER, _scalar_iterator()).asNondeterministic()
    group = F.col(group_key).cast("string") if group_key else F.lit("")
    answered = df.withColumn("_answer", ask(F.col(prompt), group))
    return answered.select(*df.columns, "_answer.response", "_answer.error")


def _scalar_iterator():
    from pyspark.sql.functions import ArrowUDFType

    return ArrowUDFType.SCALAR_ITER


def responses_of(df: DataFrame) -> DataFrame:
    """The usable answers: rows whose model call did not fail."""
    return df.filter(F.col("error").isNull()).drop("error")
