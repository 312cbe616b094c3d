"""Toxicity: a linear classifier whose scores may not depend on which group a text mentions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import Memo, byte_table, flat_bytes, plain, small_blocks, word_bounds, word_hashes

SAMPLE_ROWS = 2500     # labelled texts of each class that are learned from
LEAST_TEXTS = 4        # texts of the sample that a word must stand in
STEMS = (4, 5, 6, 7, 8)  # bytes of a word's beginning that are features beside the word
LEVELS = (1, 2, 4)     # a feature counts anew when it stands this often
PENALTY = 1.0          # weight of squared changes of the log odds under swapped identity terms
DECAY = 2e-4
STEPS = 300
_kept = Memo()

# Identity terms; those of one list can stand for one another in a sentence.
IDENTITY = [
    ["women", "men", "girls", "boys", "transgender", "nonbinary"],
    ["woman", "man", "girl", "boy"],
    ["muslim", "christian", "jewish", "hindu", "buddhist", "atheist"],
    ["muslims", "christians", "jews", "hindus", "buddhists", "atheists"],
    ["black", "white", "asian", "latino", "african", "european"],
    ["gay", "straight", "lesbian", "bisexual", "heterosexual"],
    ["immigrant", "refugee", "foreigner", "native"],
    ["immigrants", "refugees", "foreigners", "natives"],
    ["disabled", "blind", "deaf", "autistic"],
]


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def words_of(block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Values of the words of all texts, A-Z lower-cased, and the text of each."""
    buf, offsets = flat_bytes(block.column("text"))
    buf = byte_table("lower")[buf]
    starts, ends, firsts = word_bounds(buf, offsets, "nonword")
    doc = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    whole = word_hashes(buf, starts, ends)
    values, docs = [whole], [doc]
    # An identity term has no beginnings: they would stay behind when the term is swapped.
    terms = _terms()
    term = terms[np.minimum(np.searchsorted(terms, whole), len(terms) - 1)] == whole
    for size in STEMS:  # what a word begins with; a mark keeps it apart from a whole word
        long = (ends - starts > size) & ~term
        values.append(word_hashes(buf, starts[long], starts[long] + size) ^ np.uint64(size))
        docs.append(doc[long])
    return np.concatenate(values), np.concatenate(docs)


def _hash(words: list[str]) -> np.ndarray:
    buf, offsets = flat_bytes(pa.array([" ".join(words)]))
    starts, ends, _ = word_bounds(buf, offsets, "nonword")
    return word_hashes(buf, starts, ends)


def _terms() -> np.ndarray:
    if "terms" not in _kept:
        _kept["terms"] = np.unique(np.concatenate([_hash(group) for group in IDENTITY]))
    return _kept["terms"]


def _swaps(vocabulary: np.ndarray) -> np.ndarray:
    """For each word of the vocabulary the one that replaces it (itself if no identity term)."""
    out = np.arange(len(vocabulary))
    for group in IDENTITY:
        at = np.searchsorted(vocabulary, _hash(group))
        out[at] = np.roll(at, 1)
    return out


def known(values: np.ndarray, docs: np.ndarray, vocabulary: np.ndarray):
    """Text, place in the vocabulary and number of each known feature."""
    at = np.minimum(np.searchsorted(vocabulary, values), len(vocabulary) - 1)
    there = vocabulary[at] == values
    pair, count = np.unique(docs[there] * np.int64(len(vocabulary)) + at[there], return_counts=True)
    return pair // len(vocabulary), pair % len(vocabulary), count


def levels(doc: np.ndarray, word: np.ndarray, count: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (text, weight): a weight for each level that the count reaches."""
    there = [count >= level for level in LEVELS]
    return (np.concatenate([doc[t] for t in there]),
            np.concatenate([word[t] + k * size for k, t in enumerate(there)]))


def sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           label_col: str = "toxic", rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``rows`` labelled texts of each class, drawn by a hash; null label or text: unused."""
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(
        "doc_id is not null and label in (0, 1)")
    graded = (marked.groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("draw", F.xxhash64("doc_id", F.lit("toxic")))
              .withColumn("slot", F.shiftright("draw", 52)))
    # At most 4,096 counts a class say which leading bits hold the first rows; only those are ordered.
    last: dict[int, int] = {}
    held: dict[int, int] = {}
    for r in sorted(graded.groupBy("label", "slot").count().collect(), key=lambda r: r.slot):
        if held.get(r.label, 0) < rows:
            held[r.label] = held.get(r.label, 0) + r["count"]
            last[r.label] = r.slot
    first = F.lit(False)
    for label, slot in last.items():
        first = first | ((F.col("label") == label) & (F.col("slot") <= slot))
    drawn = (graded.where(first).withColumn("n", F.expr("row_number() over (partition by label order by draw, doc_id)"))
             .where(F.col("n") <= rows).select("doc_id", "label"))
    # At most 2 * rows ids and labels, so the texts are not shuffled.
    return plain(docs, id_col, text_col).where("text is not null").join(F.broadcast(drawn), "doc_id")


def fit(rows: DataFrame, penalty: float = PENALTY, steps: int = STEPS) -> dict[str, np.ndarray | float]:
    """Weights from (text, label) rows: cross entropy, decay, and ``penalty`` times the squared
    change of the log odds when identity terms are swapped for others of their list.

    Only distinct word values of the sampled texts reach the driver. With one class or none the
    model has no words and a constant score.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in small_blocks(batches):
            values, docs = words_of(block)
            order = np.lexsort((values, docs))
            values, docs = values[order], docs[order]
            edge = np.searchsorted(docs, np.arange(block.num_rows + 1))
            held = [np.unique(values[a:b], return_counts=True) for a, b in zip(edge[:-1], edge[1:])]
            yield pa.RecordBatch.from_arrays(
                [block.column("label"), pa.array([w.tobytes() for w, _ in held], pa.binary()),
                 pa.array([n.astype(np.uint16 if n.max(initial=0) < 65536 else np.uint64).tobytes() for _, n in held], pa.binary())],
                ["label", "words", "counts"])

    found = (rows.select("text", F.col("label").cast("int").alias("label"))
             .mapInArrow(run, "label int, words binary, counts binary").collect())
    found = sorted((r.label, bytes(r.words), bytes(r.counts)) for r in found)
    y = np.array([label for label, *_ in found], np.float64)
    if len(set(y)) < 2:
        return {"words": np.zeros(0, np.uint64), "weights": np.zeros((0, len(LEVELS))), "bias": 4.0 if y.any() else -4.0}
    held = [np.frombuffer(words, np.uint64) for _, words, _ in found]
    number = np.concatenate([np.frombuffer(c, np.uint16 if 4 * len(c) == len(w) else np.uint64) for _, w, c in found]).astype(np.int64)
    values = np.concatenate(held)
    docs = np.repeat(np.arange(len(held)), [len(h) for h in held])
    seen, texts = np.unique(values, return_counts=True)
    vocabulary = np.union1d(seen[texts >= LEAST_TEXTS], _terms())
    size, n = len(vocabulary), len(y)
    place = np.minimum(np.searchsorted(vocabulary, values), size - 1)
    there = vocabulary[place] == values
    base = docs[there], place[there], number[there]
    doc, word = levels(*base, size)
    swapped = _swaps(vocabulary)[word % size] + word // size * size
    changed = np.unique(doc[swapped != word])
    among = np.isin(doc, changed)
    size *= len(LEVELS)
    weigh = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, n - y.sum()))
    w, bias = np.zeros(size), 0.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)

    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, w[word], n) + bias, -30, 30)))
        d = weigh * (p - y)
        g = np.bincount(word, d[doc], size) + DECAY * w
        if len(changed):
            # The change is taken before the logistic curve, which would hide it in clear texts.
            gap = np.bincount(doc[among], w[word[among]] - w[swapped[among]], n) * (2 * penalty / len(changed))
            g += np.bincount(word[among], gap[doc[among]], size)
            g -= np.bincount(swapped[among], gap[doc[among]], size)
        g = np.append(g, d.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-5)
        w, bias = w - move[:-1], bias - move[-1]
    w = w.reshape(len(LEVELS), -1).T
    keep = np.abs(w).max(axis=1) > 0.02  # smaller weights move no score noticeably
    return {"words": vocabulary[keep], "weights": w[keep], "bias": float(bias)}


def score_texts(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted: one row per row of ``docs``, whole texts, no shuffle.

    Null and empty texts have no words and get the score of the bias alone.
    """
    words, weights, bias = model["words"], model["weights"], model["bias"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in small_blocks(batches):
            total = np.full(block.num_rows, bias)
            if len(words):
                doc, word = levels(*known(*words_of(block), words), len(words))
                total += np.bincount(doc, weights.T.ravel()[word], block.num_rows)
            score = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                ["doc_id", "score", "predicted"])

    return plain(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")
