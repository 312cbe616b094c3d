"""Time the headline queries: median of three runs each, whole results computed.

Settings: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 3), BENCH_QUERIES (comma-separated names, or "all").
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gradeflow import local_session  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

HEADLINE = [
    "news_samples", "prompt_render", "choice_answers", "scored_results", "accuracy_by_model",
    "accuracy_by_run", "mutual_by_model", "distinct_trigrams", "distinct_per_document",
    "rouge_pairs", "rouge_l_pairs", "cleaned_pages", "document_tokens", "dialogue_hash",
    "dialogue_hash_turns", "duplicate_hashes", "sampled", "sampled_below_threshold", "classified",
    "picked_by_mean", "parsed_scores", "model_responses", "rollup_levels", "model_leaderboard",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)

    def run(name: str) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    medians = {name: round(statistics.median(run(name) for _ in range(runs)), 3) for name in names}
    print(json.dumps({
        "metric": "total of median query times", "value": round(sum(medians.values()), 3),
        "unit": "sec", "queries": medians, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": cpus, "runs": runs, "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
