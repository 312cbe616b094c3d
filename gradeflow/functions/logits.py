"""Classifier output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .text import bind


def classify_logits(logits: Column, id2label: Sequence[str]) -> Column:
    """Softmax and arg-max over one array: ``struct<label, score, logits>``.

    The winner's softmax is 1 / sum(exp(x - max)); the first index wins ties.
    """
    labels = F.array(*[F.lit(x) for x in id2label])

    def pick(values: Column, top: Column) -> Column:
        norm = F.aggregate(
            values, F.lit(0.0), lambda acc, x: acc + F.exp((x - top).cast("double"))
        )
        index = F.array_position(values, top).cast("int")
        return F.struct(
            F.try_element_at(labels, index).alias("label"),
            (F.lit(1.0) / norm).alias("score"),
            values.alias("logits"),
        )

    return bind(logits, lambda v: bind(F.array_max(v), lambda top: pick(v, top)))
