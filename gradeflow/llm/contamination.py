"""Benchmark contamination: BM25 search of every passage over the test items, then verification."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import byte_table, flat_bytes, small_blocks, window_hashes, word_bounds, word_hashes

K1, B = 1.2, 0.75
THRESHOLD = 0.5        # part of the score that an item's own text would get
OVERLAP = 0.6          # part of the question's and of the answer's word triples
WHOLE = 0.7            # part of all words of an item, in order and close together, that also suffices
ANSWER = 0.25          # the last part of an item's words is its answer
LEAST_PASSAGE = 64     # words; a passage is twice the longest item of its index, or this
BLOCK_ITEMS = 4        # items in a block of a posting list
INDEX_BYTES = 16 << 20  # texts of one index; more items make more indexes


class Index:
    """Impact-ordered facts about items: postings by term, with a maximum for each block of items.

    Impacts are divided by the score of the item's own text, so one threshold serves all items.
    """

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        buf, offsets = flat_bytes(pa.array([t for _, t in items], pa.string()))
        buf = byte_table("lower")[buf]
        starts, ends, firsts = word_bounds(buf, offsets, "nonword")
        values = word_hashes(buf, starts, ends)
        self.words = [values[a:b] for a, b in zip(firsts[:-1], firsts[1:])]
        lengths = np.array([len(w) for w in self.words], float)
        self.longest = int(lengths.max(initial=0))
        self.vocabulary = np.unique(values)
        n, mean = len(items), max(1.0, lengths.mean() if len(items) else 1.0)
        counts = [np.unique(w, return_counts=True) for w in self.words]
        spread = np.zeros(len(self.vocabulary))
        coded = [np.searchsorted(self.vocabulary, w) for w, _ in counts]
        for c in coded:
            spread[c] += 1
        rare = np.log1p((n - spread + 0.5) / (spread + 0.5))
        self.postings: list[list[tuple[int, float]]] = [[] for _ in self.vocabulary]
        for item, (c, (_, tf)) in enumerate(zip(coded, counts)):
            impact = rare[c] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / mean))
            for term, part in zip(c.tolist(), (impact / max(impact.sum(), 1e-9)).tolist()):
                self.postings[term].append((item, part))
        # The postings cut into blocks, and the greatest part in each block.
        self.pieces: list[dict[int, list[tuple[int, float]]]] = []
        for posting in self.postings:
            pieces: dict[int, list[tuple[int, float]]] = {}
            for entry in posting:
                pieces.setdefault(entry[0] // BLOCK_ITEMS, []).append(entry)
            self.pieces.append(pieces)
        bounds = [(block, max(p for _, p in piece)) for pieces in self.pieces for block, piece in pieces.items()]
        self.bound_at = np.zeros(len(self.pieces) + 1, np.int64)
        np.cumsum([len(p) for p in self.pieces], out=self.bound_at[1:])
        self.bound_block = np.array([block for block, _ in bounds], np.int64)
        self.bound = np.array([part for _, part in bounds], float)
        self.most = np.array([max(p for piece in pieces.values() for _, p in piece) for pieces in self.pieces] or [0.0])
        self.parts = [self._parts(w) for w in self.words]

    @staticmethod
    def _parts(words: np.ndarray):
        cut = len(words) - max(1, int(round(len(words) * ANSWER)))
        pieces = [p for p in (words[:cut], words[cut:]) if len(p)]
        return [(min(3, len(p)), np.unique(window_hashes(p, min(3, len(p))))) for p in pieces]

    def open_blocks(self, terms: np.ndarray, threshold: float) -> list[int]:
        """Blocks whose maxima over the terms add up to the threshold; no other holds a hit."""
        sizes = self.bound_at[terms + 1] - self.bound_at[terms]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.bound_at[terms] - ends + sizes, sizes)
        total = np.bincount(self.bound_block[at], self.bound[at])
        return np.flatnonzero(total >= threshold - 1e-9).tolist()

    def search(self, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """Items whose score reaches the threshold: block-max WAND over the terms' postings.

        Blocks that their maxima rule out are skipped; in each of the others the lists are walked
        from pivot to pivot under the maxima of that block.
        """
        blocks = self.open_blocks(terms, threshold)
        if not blocks:
            return []
        own = [self.pieces[t] for t in terms.tolist()]
        found = []
        for block in blocks:
            pieces = [p[block] for p in own if block in p]
            found += self._walk(pieces, [max(part for _, part in piece) for piece in pieces], threshold)
        return found

    @staticmethod
    def _walk(lists: list[list[tuple[int, float]]], most: list[float], threshold: float) -> list[tuple[int, float]]:
        at = [0] * len(lists)
        live = list(range(len(lists)))
        found = []
        while live:
            live.sort(key=lambda k: lists[k][at[k]][0])
            total, pivot = 0.0, -1
            for place, k in enumerate(live):
                total += most[k]
                if total >= threshold - 1e-12:
                    pivot = place
                    break
            if pivot < 0:
                break  # all lists together cannot reach the threshold any more
            item = lists[live[pivot]][at[live[pivot]]][0]
            while pivot + 1 < len(live) and lists[live[pivot + 1]][at[live[pivot + 1]]][0] == item:
                pivot += 1
            to = item
            if lists[live[0]][at[live[0]]][0] == item:
                score = sum(lists[k][at[k]][1] for k in live[:pivot + 1])
                if score >= threshold - 1e-12:
                    found.append((item, score))
                to = item + 1
            for k in live[:pivot + 1]:
                while at[k] < len(lists[k]) and lists[k][at[k]][0] < to:
                    at[k] += 1
            live = [k for k in live if at[k] < len(lists[k])]
        return found

    def verified(self, item: int, passage: np.ndarray, overlap: float, whole: float = WHOLE) -> bool:
        """Question and answer both have enough of their word triples in the passage, or enough of
        the item's words stand in their order in a stretch of the passage."""
        if all(np.isin(wanted, window_hashes(passage, width)).mean() >= overlap for width, wanted in self.parts[item]):
            return True
        return self.aligned(item, passage, whole)

    def aligned(self, item: int, passage: np.ndarray, whole: float) -> bool:
        """A stretch of about one and a half times the item's words has enough of them in order."""
        words = self.words[item]
        n, least = len(words), whole * len(words) - 1e-9
        here = np.flatnonzero(np.isin(passage, words))
        step = max(1, n // 8)
        begin = np.arange(0, len(passage), step)
        first = np.searchsorted(here, begin)
        last = np.searchsorted(here, begin + n + n // 2 + 2 + step)
        some = last - first >= least
        if not some.any():
            return False
        places: dict[int, int] = {}
        for k, word in enumerate(words.tolist()):
            places[word] = places.get(word, 0) | 1 << k
        found = [places[word] for word in passage[here].tolist()]
        full = (1 << n) - 1
        for lo, hi in sorted(set(zip(first[some].tolist(), last[some].tolist()))):
            free = full  # the zeros count the longest common subsequence
            for match in found[lo:hi]:
                taken = free & match
                free = (free + taken | free - taken) & full
            if n - free.bit_count() >= least:
                return True
        return False

    def scan(self, values: np.ndarray, threshold: float, overlap: float) -> dict[int, float]:
        """Items found in any passage of a text, with their best scores."""
        if not len(values) or not len(self.vocabulary):
            return {}
        place = np.minimum(np.searchsorted(self.vocabulary, values), len(self.vocabulary) - 1)
        known = self.vocabulary[place] == values
        stride = max(LEAST_PASSAGE // 2, self.longest)
        total = np.concatenate([[0.0], np.cumsum(np.where(known, self.most[place], 0.0))])
        begin = np.arange(0, max(1, len(values) - stride), stride)
        end = np.minimum(begin + 2 * stride, len(values))
        out: dict[int, float] = {}
        # The sum over all words of a passage bounds every score in it from above.
        for lo, hi in zip(begin[total[end] - total[begin] >= threshold - 1e-9].tolist(),
                          end[total[end] - total[begin] >= threshold - 1e-9].tolist()):
            terms = np.unique(place[lo:hi][known[lo:hi]])
            if self.most[terms].sum() < threshold - 1e-9:
                continue
            for item, score in self.search(terms, threshold):
                if self.verified(item, values[lo:hi], overlap):
                    out[item] = max(out.get(item, 0.0), score)
        return out


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD,
                 overlap: float = OVERLAP, carry: bool = False) -> DataFrame:
    """doc_id, contaminated, items (ids of the test items found, sorted), best_score; with
    ``carry`` also the row itself as struct ``row``.

    Every passage of a text (two passages overlap by half and are twice the longest item) queries
    a BM25 index of the items; what reaches the threshold is verified by the word triples of
    question and answer, or else by the part of the whole item that stands in order, so that
    changed words and a missing end are allowed for. Null or empty texts hold no item; items without words or id are never found; equal items are all reported. One row per
    row of ``docs``, no shuffle. Items beyond ``INDEX_BYTES`` of text are dealt to several indexes
    by hash; statistics are those of an item's own index.
    """
    wanted = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where(
        "item_id is not null and length(text) > 0")
    size = wanted.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    count = size // INDEX_BYTES + 1
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []))
    out = rows.withColumn("hits", F.expr("cast(map() as map<bigint, double>)"))
    for part in range(count):
        held = wanted.where(F.expr(f"pmod(xxhash64(item_id, text), {count}) = {part}")).collect()  # a bounded part
        index = Index(sorted((r.item_id, r.text) for r in held))
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for block in small_blocks(batches):
                buf, offsets = flat_bytes(block.column("text"))
                buf = byte_table("lower")[buf]
                starts, ends, firsts = word_bounds(buf, offsets, "nonword")
                values = word_hashes(buf, starts, ends)
                hits = []
                for lo, hi, before in zip(firsts[:-1], firsts[1:], block.column("hits").to_pylist()):
                    best = dict(before or [])
                    for item, score in index.scan(values[lo:hi], threshold, overlap).items():
                        best[index.ids[item]] = max(best.get(index.ids[item], 0.0), score)
                    hits.append(list(best.items()))
                yield pa.RecordBatch.from_arrays(
                    [*block.columns[:-1], pa.array(hits, pa.map_(pa.int64(), pa.float64()))], block.schema.names)

        out = out.mapInArrow(run, out.schema)
    return out.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.sort_array(F.map_keys("hits")).alias("items"),
                      F.coalesce(F.array_max(F.map_values("hits")), F.lit(0.0)).alias("best_score"),
                      *(["row"] if carry else []))
