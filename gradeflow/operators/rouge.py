"""ROUGE-1, ROUGE-2 and ROUGE-L per row.

Both texts of a pair sit in one row, so nothing is shuffled here: a long text or a
reference shared by very many rows makes no task larger than its own rows.  Whole
texts are compared; there is no length limit.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.text import ngram_keys, tokenize


def lcs_length(a: list[str], b: list[str]) -> int:
    """Longest common subsequence by bit-parallel rows.

    Row bits are a Python integer over positions of ``a``; each token of ``b`` costs
    a few whole-row operations, and memory is one row instead of a table.
    """
    wanted = set(b)
    bits: dict[str, bytearray] = {}
    for i, token in enumerate(a):
        if token in wanted:
            bits.setdefault(token, bytearray(len(a) // 8 + 1))[i >> 3] |= 1 << (i & 7)
    masks = {token: int.from_bytes(mask, "little") for token, mask in bits.items()}
    full = (1 << len(a)) - 1
    row = full
    for token in b:
        mask = masks.get(token)
        if mask:
            hits = row & mask
            row = ((row + hits) | (row - hits)) & full
    return len(a) - row.bit_count()


def _shared(a: list[str], b: list[str], n: int) -> int:
    """N-grams in common, each as often as it occurs on both sides."""
    grams = lambda t: Counter(zip(*(t[i:] for i in range(n))))
    return (grams(a) & grams(b)).total()


OVERLAPS = T.StructType([T.StructField(n, T.LongType()) for n in ("one", "two", "lcs")])


@F.pandas_udf(OVERLAPS)
def _overlaps(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for hyps, refs in batches:
        rows = []
        for hyp, ref in zip(hyps, refs):
            a, b = list(hyp), list(ref)
            rows.append((_shared(a, b, 1), _shared(a, b, 2), lcs_length(a, b)))
        yield pd.DataFrame(rows, columns=OVERLAPS.names)


def _prf(name: str, overlap: Column, hyp: Column, ref: Column) -> list[Column]:
    p = F.when(hyp > 0, overlap / hyp).otherwise(F.lit(0.0))
    r = F.when(ref > 0, overlap / ref).otherwise(F.lit(0.0))
    f = F.when(overlap > 0, 2.0 * overlap / (hyp + ref)).otherwise(F.lit(0.0))
    return [f.alias(f"{name}_f"), p.alias(f"{name}_p"), r.alias(f"{name}_r")]


def _distinct_prf(name: str, hyp: Column, ref: Column) -> list[Column]:
    overlap = F.size(F.array_intersect(hyp, ref))
    sizes = F.size(F.array_distinct(hyp)), F.size(F.array_distinct(ref))
    return _prf(name, overlap, *sizes)


def rouge(
    df: DataFrame,
    hyp: str,
    ref: str,
    keep: tuple[str, ...] = (),
    tokenizer=tokenize,
    counting: str = "clipped",
) -> DataFrame:
    """F, p and r for ROUGE-1, ROUGE-2 and ROUGE-L; an empty side scores 0.

    ``counting="clipped"`` counts each n-gram as often as both sides have it;
    ``"distinct"`` counts each different n-gram once and stays in the JVM for the
    two n-gram scores.  ROUGE-L is always the longest common subsequence.
    """
    if counting not in ("clipped", "distinct"):
        raise ValueError(f"unknown counting {counting!r}")
    tokens = df.select(
        *keep, tokenizer(F.col(hyp)).alias("_h"), tokenizer(F.col(ref)).alias("_r")
    )
    scored = tokens.withColumn("_o", _overlaps("_h", "_r"))
    h, r = F.size("_h"), F.size("_r")
    out = _prf("rouge_l", F.col("_o.lcs"), h, r)
    if counting == "clipped":
        bigrams = F.greatest(h - 1, F.lit(0)), F.greatest(r - 1, F.lit(0))
        grams = _prf("rouge_1", F.col("_o.one"), h, r) + _prf("rouge_2", F.col("_o.two"), *bigrams)
    else:
        grams = _distinct_prf("rouge_1", F.col("_h"), F.col("_r"))
        grams += _distinct_prf(
            "rouge_2", ngram_keys(F.col("_h"), 2), ngram_keys(F.col("_r"), 2)
        )
    return scored.select(*keep, *grams, *out)
