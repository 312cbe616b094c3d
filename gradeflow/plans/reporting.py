"""Scores to reports: normalise, roll up, rank."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.ranking import leaderboard
from ..operators.rollup import minmax_by_dataset, weighted_mean_rollup
from ..sources.weights import Node
from ..storage import keep

__all__ = ["Report", "keep", "report"]


@dataclass(frozen=True)
class Report:
    level_scores: DataFrame
    ranking: DataFrame


def report(scores: DataFrame, nodes: list[Node], normalized: bool = False, **ranking) -> Report:
    """Level scores and ranking from raw or min-max scaled scores."""
    used = minmax_by_dataset(scores) if normalized else scores
    levels = weighted_mean_rollup(used, nodes)
    return Report(levels, leaderboard(levels, **ranking))
