"""Writers (K1-K8).  All write in parallel; files are named by Spark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..operators.ranking import leaderboard, level_table, mark_top2, model_names
from .layout import write_chunks, write_score_tree  # noqa: F401

CHUNK_ROWS = 5000


def write_results(
    df: DataFrame,
    path: str,
    chunk_rows: int = CHUNK_ROWS,
    by: Sequence[str] = ("model", "dataset"),
    mode: str = "overwrite",
) -> None:
    """K1: result rows as JSON lines under ``model=/dataset=``, at most ``chunk_rows`` per file.

    Rebalancing brings the rows of a run together and, by their measured size, splits a
    run that holds most of the rows over several tasks; files come out nearly full.
    """
    (
        df.hint("rebalance", *by)
        .write.mode(mode)
        .partitionBy(*by)
        .option("maxRecordsPerFile", chunk_rows)
        .option("ignoreNullFields", "false")
        .json(path)
    )


def write_metrics(metrics: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K2: one JSON object per model and data set, ``overall`` first."""
    value = F.to_json(F.struct("overall", "correct_count", "total_count"))
    rows = metrics.select("model", "dataset", value.alias("value"))
    rows.write.mode(mode).partitionBy("model", "dataset").text(path)


def write_scores(scores: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K3: one ``{model: {dataset: score}}`` object per line.

    A line holds one model's scores, one entry per data set.
    """
    entries = F.array_sort(F.collect_list(F.struct("dataset", "score")))
    per_model = scores.groupBy("model").agg(F.map_from_entries(entries).alias("_scores"))
    per_model.select(F.to_json(F.create_map("model", "_scores"))).write.mode(mode).text(path)


def write_level_tables(level_scores: DataFrame, path: str, mode: str = "overwrite") -> list[str]:
    """K4: one Parquet table per tree level with text scores, and one with the top-two marks."""
    names = model_names(level_scores)
    levels = [r[0] for r in level_scores.select("level").distinct().orderBy("level").collect()]
    written = []
    for level in levels:
        target = f"{path}/level_{level}"
        level_table(level_scores, level, names).write.mode(mode).parquet(target)
        written.append(target)
    mark_top2(level_scores).write.mode(mode).partitionBy("level").parquet(f"{path}/marks")
    return written + [f"{path}/marks"]


def write_leaderboard(level_scores: DataFrame, path: str, mode: str = "overwrite", **options) -> None:
    """K5: ranked and incomplete models, told apart by ``status``."""
    leaderboard(level_scores, **options).write.mode(mode).partitionBy("status").parquet(path)


def summary_record(results: DataFrame, metrics: DataFrame, tasks_run: Sequence[str]) -> DataFrame:
    """K6: one row with sample count, tasks, and metrics as JSON.

    ``metrics`` has one row per run; those rows are what the record lists.
    """
    listed = metrics.agg(
        F.array_sort(F.collect_list(F.to_json(F.struct(*metrics.columns), {"ignoreNullFields": "false"}))).alias("metrics")
    )
    tasks = F.array(*[F.lit(t) for t in tasks_run]).cast("array<string>").alias("tasks_run")
    total = results.agg(F.count(F.lit(1)).alias("total_samples"))
    both = total.unionByName(listed, allowMissingColumns=True)
    return both.agg(
        F.max("total_samples").alias("total_samples"),
        F.first("metrics", ignorenulls=True).alias("metrics"),
    ).select("total_samples", tasks, "metrics")


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """K7: rows as JSON lines; the path has to end in ``.json`` or ``.jsonl``."""
    if not path.endswith((".json", ".jsonl")):
        raise ValueError("the path must end in .json or .jsonl")
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def preview(df: DataFrame, rows: int = 2) -> None:
    """K8: print the first records."""
    df.show(rows, truncate=False, vertical=True)
