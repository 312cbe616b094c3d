"""Grouped metrics (A1-A5, A10)."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions.text import ngram_keys, tokenize
from ..registry import analyzers
from .grams import gram_counts, spread_grams

Columns = Sequence[str]
log = logging.getLogger(__name__)


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def accuracy(results: DataFrame, by: Columns = ()) -> DataFrame:
    """A1: share of correct rows; a missing ``is_correct`` counts as wrong, no rows as 0."""
    sums = results.groupBy(*by).agg(
        F.count_if(F.col("is_correct")).alias("correct_count"),
        F.count(F.lit(1)).alias("total_count"),
    )
    overall = _ratio(F.col("correct_count"), F.col("total_count")).alias("overall")
    return sums.select(*by, overall, "correct_count", "total_count")


@dataclass(frozen=True)
class Partial:
    """A metric as aggregates that combine before the shuffle, and what is made of them.

    ``aggregates`` are named by the metric itself; ``finish`` makes its output columns of them.
    """

    aggregates: Mapping[str, Callable[[], Column]]
    finish: Mapping[str, Callable[[], Column]]


def _mean(value: Column) -> Column:
    return F.coalesce(F.avg(value), F.lit(0.0))


# Evaluation tools by name; a name that is not listed falls back to accuracy.
TOOLS: dict[str, Partial] = {
    "Accuracy": Partial(
        {"_correct": lambda: F.count_if(F.col("is_correct")), "_total": lambda: F.count(F.lit(1))},
        {"overall": lambda: _ratio(F.col("_correct"), F.col("_total")), "correct_count": lambda: F.col("_correct"),
         "total_count": lambda: F.col("_total")},
    ),
}


def register_tool(name: str, tool: Partial) -> None:
    if name in TOOLS:
        raise ValueError(f"evaluation tool {name!r} is already registered")
    TOOLS[name] = tool


def _chosen(names: Sequence[str]) -> dict[str, Partial]:
    out = {}
    for name in names or ("Accuracy",):
        if name not in TOOLS:
            log.warning("evaluation tool %r is not registered; accuracy is used", name)
        known = name if name in TOOLS else "Accuracy"
        out[known] = TOOLS[known]
    return out


def _measure(results: DataFrame, tools: Sequence[Partial], by: Columns) -> DataFrame:
    parts = {n: f for t in tools for n, f in t.aggregates.items()}
    sums = results.groupBy(*by).agg(*[f().alias(n) for n, f in parts.items()])
    outputs = {n: f for t in tools for n, f in t.finish.items()}
    return sums.select(*by, *[f().alias(n) for n, f in outputs.items()])


def measure(results: DataFrame, tools: Sequence[str] = ("Accuracy",), by: Columns = ()) -> DataFrame:
    """A1-A3: the columns of all named tools, from one pass and one shuffle.

    A name that is not registered is logged and stands for accuracy; each tool is used once,
    and an aggregate that several tools name is computed once.
    """
    return _measure(results, list(_chosen(tools).values()), by)


def analyze_single_choice(
    results: DataFrame, tools: str | Sequence[str] = "Accuracy", by: Columns = ()
) -> DataFrame:
    """A2: the metrics of each run, or null metrics and a reason where a run has unscored rows.

    The check and the metrics share one aggregation.  With no group columns and no
    rows there is nothing to analyse, which is reported in the same way.
    """
    names = [tools] if isinstance(tools, str) else list(tools)
    unscored = Partial({"_unscored": lambda: F.count_if(F.col("is_correct").isNull()), "_rows": lambda: F.count(F.lit(1))},
                       {"_unscored": lambda: F.col("_unscored"), "_rows": lambda: F.col("_rows")})
    made = _measure(results, [*_chosen(names).values(), unscored], by)
    usable = (F.col("_unscored") == 0) & (F.col("_rows") > 0)
    summary = (F.when(F.col("_rows") == 0, F.lit("Skipped: no results"))
               .when(F.col("_unscored") > 0, F.lit("Skipped: rows without is_correct"))
               .otherwise(F.lit(f"Calculated {names} metrics")))
    values = [c for c in made.columns if c not in (*by, "_unscored", "_rows")]
    return made.select(*by, *[F.when(usable, F.col(c)).alias(c) for c in values], summary.alias("summary"))


@analyzers.register("single_choice")
def single_choice(results: DataFrame) -> DataFrame:
    by = [c for c in ("model", "dataset") if c in results.columns]
    return analyze_single_choice(results, by=by)


def mutual_metrics(
    results: DataFrame,
    by: Columns = (),
    predicted: str = "predicted_answer",
    gold: str = "correct_answer",
) -> DataFrame:
    """A3: recall@1, recall@2 and MRR of single answers over the options A-D.

    A wrong answer next to the gold letter counts as rank two; any other wrong
    answer as the gold letter's own position.  Equal values are a hit even when
    they are not option letters.
    """
    return _measure(results, [mutual(predicted, gold)], by)


def mutual(predicted: str = "predicted_answer", gold: str = "correct_answer") -> Partial:
    """A3 as a tool."""

    def marks() -> tuple[Column, Column, Column]:
        letters = F.array(*[F.lit(x) for x in "ABCD"])
        pred_at = F.array_position(letters, F.col(predicted))
        gold_at = F.array_position(letters, F.col(gold))
        hit = F.col(predicted).eqNullSafe(F.col(gold))
        near = (pred_at > 0) & (gold_at > 0) & (F.abs(pred_at - gold_at) <= 1)
        rank = F.when(hit, 1.0).when(near, 0.5).when(gold_at > 0, F.lit(1.0) / gold_at).otherwise(0.0)
        return hit, near, rank

    return Partial(
        {"_recall_1": lambda: _mean(F.when(marks()[0], 1.0).otherwise(0.0)),
         "_recall_2": lambda: _mean(F.when(marks()[0] | marks()[1], 1.0).otherwise(0.0)),
         "_mrr": lambda: _mean(marks()[2])},
        {"recall_1": lambda: F.col("_recall_1"), "recall_2": lambda: F.col("_recall_2"), "mrr": lambda: F.col("_mrr")},
    )


register_tool("Mutual", mutual())


def distinct_n(
    df: DataFrame,
    text: str,
    n: int,
    by: Columns = (),
    tokenizer=tokenize,
    plain: bool = True,
    approximate: bool = False,
) -> DataFrame:
    """A4: different n-grams over all n-grams, across all texts of a group.

    N-grams are first counted per (group, n-gram): blocks combine repeats before the
    shuffle, and a group holding most of the corpus is spread over its n-grams.  The
    second step only adds up counts.  A group without any n-gram scores 0.
    """
    tokens = df.select(*by, tokenizer(F.col(text)).alias("_tokens"))
    grams = gram_counts(tokens, n, by, plain)
    if approximate:
        sums = grams.groupBy(*by).agg(
            F.approx_count_distinct("_gram").alias("distinct_ngrams"),
            F.sum("_n").alias("total_ngrams"),
        )
    else:
        counts = spread_grams(grams, df).groupBy("_gram", *by).agg(F.sum("_n").alias("_n"))
        sums = counts.groupBy(*by).agg(
            F.count("_gram").alias("distinct_ngrams"), F.sum("_n").alias("total_ngrams")
        )
    score = _ratio(F.col("distinct_ngrams"), F.col("total_ngrams"))
    return sums.select(
        *by, "distinct_ngrams", F.coalesce("total_ngrams", F.lit(0)).alias("total_ngrams"),
        F.coalesce(score, F.lit(0.0)).alias(f"distinct_{n}"),
    )


def distinct_sketches(df: DataFrame, text: str, n: int, by: Columns = (), tokenizer=tokenize, plain: bool = True,
                      precision: int = 16) -> DataFrame:
    """A4 for growing corpora: per group a mergeable sketch of its n-grams, and how many there are.

    A part's sketches are stored once; a new part only reads its own texts.  The relative error
    is about 0.8 / 2 ** (precision / 2), a sketch takes up to 2 ** precision bytes.
    """
    grams = gram_counts(df.select(*by, tokenizer(F.col(text)).alias("_tokens")), n, by, plain)
    return grams.groupBy(*by).agg(F.hll_sketch_agg("_gram", precision).alias("sketch"),
                                  F.coalesce(F.sum("_n"), F.lit(0)).alias("total_ngrams"))


def distinct_united(parts: DataFrame, n: int, by: Columns = ()) -> DataFrame:
    """The shares of :func:`distinct_n`, estimated from the stored sketches of any number of parts."""
    sums = parts.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("distinct_ngrams"),
                                  F.coalesce(F.sum("total_ngrams"), F.lit(0)).alias("total_ngrams"))
    score = _ratio(F.least("distinct_ngrams", "total_ngrams"), F.col("total_ngrams"))
    return sums.select(*by, "distinct_ngrams", "total_ngrams", F.coalesce(score, F.lit(0.0)).alias(f"distinct_{n}"))


def distinct_k(tokens: Column, ks: Sequence[int], plain: bool = True) -> list[Column]:
    """A5: per row, token counts and the share of different k-grams.

    An empty token list has null counts and zero shares.
    """
    size = F.size(tokens)
    out = [
        F.when(size > 0, size).cast("long").alias("total_tokens"),
        F.when(size > 0, F.size(F.array_distinct(tokens))).cast("long").alias("unique_tokens"),
    ]
    for k in ks:
        distinct = F.size(F.array_distinct(ngram_keys(tokens, k, plain)))
        share = F.when(size >= k, distinct / (size - (k - 1))).otherwise(F.lit(0.0))
        out.append(share.alias(f"distinct_{k}"))
    return out


def stage_counts(frames: Mapping[str, DataFrame]) -> DataFrame:
    """A10: rows per stage (read, formatted, sampled, ...) as one table."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n")
        for name, df in frames.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def count_rows(df: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """A10: count rows as they pass; read the observation after any action on the frame."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
