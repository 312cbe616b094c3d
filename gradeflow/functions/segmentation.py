"""Dictionary segmentation (T2): words of runs that are written without spaces.

A dictionary is a table of words with their frequencies.  A run is cut where the product of
its words' shares is largest: a prefix tree finds the dictionary's words at every place, and
the cheapest path through the lattice of these words is followed from the end.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from .text import word_lists

# Runs that are written without spaces, and runs that are words as they stand.
UNSPACED = "[一-龥]+"
WORDLIKE = r"[^\W_]+"

LIMIT = 2_000_000  # words that are sent to every task


def word_costs(words: DataFrame, word: str = "word", freq: str = "freq") -> DataFrame:
    """``word, cost`` and the cost of an unknown character in a row of its own, with a null word.

    A cost is a word's share as -1000 times its natural logarithm, rounded down, so that sums
    are exact.  A word that repeats counts with all its frequencies; an unknown character
    counts as if it occurred once.
    """
    known = words.where(F.col(word).isNotNull() & (F.col(word) != "") & (F.col(freq) > 0))
    counted = known.groupBy(F.col(word).alias("word")).agg(F.sum(freq).cast("double").alias("_n"))
    total = counted.agg(F.coalesce(F.sum("_n"), F.lit(1.0)).alias("_all"))

    def cost(n: Column) -> Column:
        return F.floor((F.log("_all") - F.log(n)) * 1000).cast("long").alias("cost")

    # One row on the right: the total.
    costs = counted.withColumn("_one", F.lit(1)).join(F.broadcast(total.withColumn("_one", F.lit(1))), "_one")
    alone = total.select(F.lit(None).cast("string").alias("word"), cost(F.lit(1.0)))
    return costs.select("word", cost(F.col("_n"))).union(alone)


class Dictionary:
    """A prefix tree of words; the entry ``None`` of a node is the cost of the word that ends there."""

    def __init__(self, costs: Iterable[tuple[str | None, int]]):
        self.root: dict = {}
        self.unknown = 0
        for word, cost in costs:
            if word is None:
                self.unknown = cost
                continue
            node = self.root
            for c in word:
                node = node.setdefault(c, {})
            node[None] = cost

    def cut(self, run: str) -> list[str]:
        """The cheapest words of a run; of equal costs the longer first word.

        Unknown ASCII characters that follow one another stay together.
        """
        n = len(run)
        best, ends, found = [0] * (n + 1), [0] * n, [False] * n
        for i in range(n - 1, -1, -1):
            least, end, known, node = None, i + 1, False, self.root
            for j in range(i, n):
                node = node.get(run[j])
                if node is None:
                    break
                cost = node.get(None)
                if cost is not None and (least is None or cost + best[j + 1] <= least):
                    least, end, known = cost + best[j + 1], j + 1, True
            alone = self.unknown + best[i + 1]
            if run[i] not in self.root or None not in self.root[run[i]]:
                if least is None or alone < least:
                    least, end, known = alone, i + 1, False
            best[i], ends[i], found[i] = least, end, known
        out, i, joined = [], 0, False
        while i < n:
            word, loose = run[i:ends[i]], not found[i] and run[i].isascii()
            if loose and joined:
                out[-1] += word
            else:
                out.append(word)
            i, joined = ends[i], loose
        return out


def tokens_of(text: str | None, dictionary: Dictionary, unspaced: str = UNSPACED) -> list[str]:
    """Words of a text that was not cleaned: digits, accents and single marks are tokens too."""
    pattern = re.compile(f"({unspaced})|((?:(?!{unspaced}){WORDLIKE[:-1]})+)|\\S")
    out: list[str] = []
    for m in pattern.finditer(text or ""):
        out += dictionary.cut(m[0]) if m[1] is not None else [m[0]]
    return out


def dictionary_tokenizer(words: DataFrame | Mapping[str, float], word: str = "word", freq: str = "freq",
                         unspaced: str = UNSPACED, limit: int = LIMIT) -> Callable[[Column], Column]:
    """T2 with a dictionary: a tokeniser for ``preprocess``, ``distinct_n`` and ``rouge``.

    ``words`` is a table of words and frequencies, or a mapping.  Runs that match ``unspaced`` are
    segmented; other runs of letters and digits are words, and any other character but white
    space is a token.  The dictionary is sent to the tasks, so more than ``limit`` words are
    refused.  Null text has no tokens.
    """
    if isinstance(words, Mapping):
        from pyspark.sql import SparkSession

        spark = SparkSession.getActiveSession()
        words = spark.createDataFrame([(w, float(n)) for w, n in words.items()], f"{word} string, {freq} double")
    rows = word_costs(words, word, freq).limit(limit + 2).collect()
    if len(rows) > limit + 1:
        raise ValueError(f"more than {limit} words; a dictionary of that size is not sent to tasks")
    shared = words.sparkSession.sparkContext.broadcast([(r["word"], r["cost"]) for r in rows])
    made: dict = {}

    def cut(text: str) -> list[str]:
        if "dictionary" not in made:
            made["dictionary"] = Dictionary(shared.value)
        return tokens_of(text, made["dictionary"], unspaced)

    return word_lists(cut)
