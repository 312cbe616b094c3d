"""Ranked lexical search over an index of documents in strata of equal length normaliser."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import plain, small_blocks, written

ITEM_BYTES = 16 << 20     # of item text that one index serves
PIECE_POSTINGS = 1 << 20  # about as many postings are indexed at once
WORDS = rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SATURATION, FLAT, SLOPE = 8, 25, 75  # fixed values: 8 * (25 + 75 * n / average) / 1000


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and other characters; only A-Z are lower-cased."""
    return re.findall(WORDS, (text or "").encode().lower())


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impact(tf: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + SATURATION * m)


class Items:
    """Items as counts of terms; terms are numbered in order of first appearance."""

    def __init__(self, rows: list[tuple[int, int | None, str]]):
        self.keys, self.number = [(uid, item_id) for uid, item_id, _ in rows], {}
        self.terms, self.times = [], []
        for _, _, text in rows:
            counts = Counter(self.number.setdefault(t, len(self.number)) for t in terms_of(text))
            self.terms.append(np.array(list(counts), np.int64))
            self.times.append(np.array(list(counts.values()), np.int64))


class Stratum:
    """Postings of documents that share the normaliser m: by term, and within a term by tf.

    What an occurrence count is worth is computed once per tf, not once per posting.
    """

    def __init__(self, m: int, doc_ids: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray):
        order = np.lexsort((tf, term))
        doc, term, tf = doc[order], term[order], tf[order]
        self.doc_ids, self.doc = doc_ids, doc
        runs = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (tf[1:] != tf[:-1])])) if len(term) else term
        self.run_start = np.append(runs, len(term))
        self.run_impact = impact(tf[runs], m)
        first = np.flatnonzero(np.concatenate([[True], np.diff(term[runs]) > 0])) if len(runs) else runs
        self.term = term[runs][first]                       # terms of the stratum
        self.term_runs = np.append(first, len(runs))        # and their runs of equal tf
        self.most = self.run_impact[self.term_runs[1:] - 1] if len(first) else self.run_impact  # of the largest tf

    def find(self, terms: np.ndarray) -> np.ndarray:
        """Which of the given terms the stratum holds, as places, -1 where it does not."""
        at = np.searchsorted(self.term, terms)
        at[at == len(self.term)] = 0
        return np.where(self.term[at] == terms, at, -1) if len(self.term) else np.full(len(terms), -1)

    def scores(self, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The score of every document, from the terms at the given places."""
        runs = _ranges(self.term_runs[at], self.term_runs[at + 1])
        worth = self.run_impact[runs] * np.repeat(weights, self.term_runs[at + 1] - self.term_runs[at])
        places = _ranges(self.run_start[runs], self.run_start[runs + 1])
        out = np.zeros(len(self.doc_ids), np.int64)
        np.add.at(out, self.doc[places], np.repeat(worth, self.run_start[runs + 1] - self.run_start[runs]))
        return out


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sizes = ends - starts
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class Best:
    """The first documents found so far for one item: higher scores first, then smaller ids."""

    def __init__(self, keep: int):
        self.keep, self.score, self.doc = keep, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """A document below this score is not among the first."""
        return int(self.score[-1]) if len(self.score) == self.keep else 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.concatenate([self.score, score]), np.concatenate([self.doc, doc])
        order = np.lexsort((doc, -score))[:self.keep]
        self.score, self.doc = score[order], doc[order]


def search(strata: list[Stratum], items: Items, weights: np.ndarray, best: list[Best]) -> int:
    """Bring every item's first documents up to date; strata are visited by falling bound.

    A stratum's bound for an item is the score of a document that holds each of its terms as often
    as any does. Where it is below the item's last place, neither this stratum nor a later one
    can change the result. Returns how many visits were made.
    """
    visits = 0
    for item, (terms, times) in enumerate(zip(items.terms, items.times)):
        worth = weights[terms] * times
        found = [s.find(terms) for s in strata]
        bounds = np.array([int((s.most[at[at >= 0]] * worth[at >= 0]).sum()) for s, at in zip(strata, found)], np.int64)
        for k in np.argsort(-bounds, kind="stable").tolist():
            if bounds[k] < best[item].least:
                break
            visits += 1
            held = found[k] >= 0
            score = strata[k].scores(found[k][held], worth[held])
            at = np.flatnonzero(score >= best[item].least)
            best[item].add(score[at], strata[k].doc_ids[at])
    return visits


def _counted(rows: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n (terms with repeats), and the items' terms among them with their counts."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, find = vocabulary.value.get, re.compile(WORDS).findall
        for block in small_blocks(batches):
            n, sizes, ids = [], [], []
            for text in block.column("text").cast(pa.large_binary()).to_pylist():
                words = find(text.lower()) if text else []
                mine = [k for w in words if (k := get(w)) is not None]
                n.append(len(words))
                sizes.append(len(mine))
                ids += mine
            size = len(vocabulary.value) or 1
            row = np.repeat(np.arange(len(n)), sizes)
            pairs, tf = np.unique(row * size + np.array(ids, np.int64), return_counts=True)
            offsets = pa.array(np.searchsorted(pairs, np.arange(len(n) + 1) * size), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(n, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(pairs % size, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int32()))], ["doc_id", "n", "terms", "tfs"])

    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def _holding(counted: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "df"])

    out = np.zeros(size, np.int64)
    for r in counted.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]  # at most one row per term of a block of items
    return out


def _searcher(shared, keep: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weights = shared.value
        best = [Best(keep) for _ in items.keys]
        held: list[pa.RecordBatch] = []
        postings = 0

        def index() -> list[Stratum]:
            table = pa.Table.from_batches(held).combine_chunks()
            m, doc_ids = (table.column(c).to_numpy() for c in ("m", "doc_id"))
            lists = [table.column(c).combine_chunks() for c in ("terms", "tfs")]
            sizes = np.diff(lists[0].offsets.to_numpy())
            term, tf = (x.flatten().to_numpy().astype(np.int64) for x in lists)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(m)) + 1, [len(m)]])
            out = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part = slice(ends[a], ends[b])
                out.append(Stratum(int(m[a]), doc_ids[a:b], np.repeat(np.arange(b - a), sizes[a:b]), term[part], tf[part]))
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                held.append(part)
                postings += len(part.column("terms").flatten())
                if postings >= PIECE_POSTINGS:
                    search(index(), items, weights, best)
                    held, postings = [], 0
        if held:
            search(index(), items, weights, best)
        for (uid, item_id), b in zip(items.keys, best):
            if len(b.doc):
                size = len(b.doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uid] * size, pa.int64()), pa.array([item_id] * size, pa.int64()), pa.array(b.doc), pa.array(b.score)],
                    ["uid", "item_id", "doc_id", "score"])

    return run


def ranked(docs: DataFrame, items: DataFrame, keep: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``keep`` best documents with a score above 0.

    With N documents that have a term, L terms in all and n in a document, its normaliser is
    ``m = 25 + (75 * n * N) div L``. A term in df documents weighs ``floor(1000 * ln((2N + 2) / (2df + 1)))``;
    a document scores its weight times ``(10**9 * tf) div (1000 * tf + 8 * m)``, summed over the item's
    terms with repeats. Equal scores stand by smaller id.

    Documents are dealt by m, so that a task holds few and thick strata; it indexes them piece by
    piece, a stratum of any size in several pieces. Items are read block by block, about
    ``ITEM_BYTES`` of text each. Null text is empty; rows with a null doc_id count in all statistics
    but are not returned; an item row without a term has no result; rows that repeat an id are
    documents, or items, of their own.
    """
    spark = docs.sparkSession
    rows = plain(docs, id_col, text_col)
    tests = items.select(F.monotonically_increasing_id().alias("uid"), F.col(item_col).cast("long").alias("item_id"),
                         F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    tests = written(tests, "search-items")
    size = tests.agg(F.sum(F.octet_length("text") + 32).alias("s")).first()["s"] or 0
    blocks = int(-(-size // ITEM_BYTES)) or 1
    found = None
    for block in range(blocks):
        part = tests.where(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == block)
        part_items = Items([tuple(r) for r in part.collect()])  # about ITEM_BYTES
        hits = _block(rows, part_items, keep)
        found = hits if found is None else found.unionByName(hits)
    return found.select("item_id", F.col("place").alias("rank"), "doc_id", "score")


def _block(rows: DataFrame, items: Items, keep: int) -> DataFrame:
    spark = rows.sparkSession
    counted = written(_counted(rows, spark.sparkContext.broadcast(items.number)), "search-terms")
    total = counted.agg(F.count(F.when(F.col("n") > 0, 1)).alias("n"), F.sum("n").alias("l")).first()
    holding = _holding(counted, len(items.number))
    weights = np.array([weight(total["n"], int(h)) for h in holding], np.int64)
    shared = spark.sparkContext.broadcast((items, weights))
    m = F.expr(f"{FLAT} + ({SLOPE} * n * {total['n']}L) div {max(1, total['l'] or 0)}L")
    strata = (counted.where(F.col("doc_id").isNotNull() & (F.size("terms") > 0)).withColumn("m", m).drop("n")
              .repartitionByRange("m", F.xxhash64("doc_id")).sortWithinPartitions("m"))
    hits = strata.mapInArrow(_searcher(shared, keep), "uid long, item_id long, doc_id long, score long")
    order = Window.partitionBy("uid").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)
