"""Repeated passages: word windows that also start in a document with a smaller id."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import as_long, flat_bytes, plain, small_blocks, window_hashes, word_bounds, word_hashes, written
from .slots import GATHERED, gathered, may_repeat, packed_slots, shared_table, table_of

WINDOW = 50
PERIOD = 31
# A difference cover of 31: every remainder is the difference of two members.
COVER = (0, 1, 3, 8, 12, 18)
SECOND = np.uint64(0xC2B2AE3D27D4EB4F)


def _values(block: pa.RecordBatch):
    buf, offsets = flat_bytes(block.column("text"))
    starts, ends, firsts = word_bounds(buf, offsets)
    return buf, starts, ends, firsts, word_hashes(buf, starts, ends)


def _inside(firsts: np.ndarray, count: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word: its document, and whether a window of ``width`` from it stays inside."""
    doc = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    at = np.arange(count)
    return doc, at + width <= firsts[doc + 1] if count else np.zeros(0, bool)


FEW_RUNS = 1_000_000  # rows and runs that are broadcast: some tens of megabytes
RUNS = "doc_id long, runs array<struct<first: long, last: long, mark: long>>"


def _runs(before: int, after: int):
    """Sorted places as runs of what they cover, from ``before`` ahead of each to ``after`` from it on.

    Places with a mark stay apart, as the mark belongs to one place.
    """
    kind = pa.struct([("first", pa.int64()), ("last", pa.int64()), ("mark", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for places in batch.column("at"):
                at, marks = places.values.field("at").to_numpy().astype(np.int64), places.values.field("mark")
                new = np.diff(at, prepend=-before - after - 1) > before + after
                new |= np.asarray(marks.is_valid())
                edge = np.flatnonzero(new)
                first, last = np.maximum(at[edge] - before, 0), at[np.append(edge[1:], len(at)) - 1] + after
                found.append([{"first": f, "last": e, "mark": m} for f, e, m in
                              zip(first.tolist(), last.tolist(), marks.take(pa.array(edge)).to_pylist())])
            names = [c for c in batch.schema.names if c != "at"]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.list_(kind)), *(batch.column(c) for c in names[1:])],
                ["doc_id", "runs", *names[1:]])

    return run


def _few(runs: DataFrame) -> DataFrame:
    """Broadcast a written table of runs if its rows and runs are few; else texts move to it."""
    held = runs.agg((F.count("*") + F.coalesce(F.sum(F.size("runs")), F.lit(0))).alias("held")).first().held
    return F.broadcast(runs) if held <= FEW_RUNS else runs


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                    period: int = PERIOD, cover: tuple[int, ...] = COVER, text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if ``text``, ``kept_text``.

    A word goes if a window of ``window`` words covering it also starts in a document with a
    smaller id. Hashes are taken of shorter windows whose position modulo ``period`` is in
    ``cover``; two equal long windows always share such an anchor at the same shift. Anchors, and
    later windows, that stand only once are mostly left out before any shuffle by a table of hash
    slots of a fixed size, which keeps all that repeat. Only around anchors that stand in several
    documents are the long windows (two 64-bit values each) compared. Null text has no words. Rows with the same id are one document as far as
    comparing goes, and each loses the windows that stand in it; a null id removes nothing
    elsewhere and loses nothing.
    """
    short = window - period + 1
    if short < 1 or {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError("the cover must give every difference, and the period must be below the window")
    source = plain(docs, id_col, text_col)
    named = source.where("doc_id is not null")
    chosen = np.zeros(period, bool)
    chosen[list(cover)] = True

    def anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for block in small_blocks(batches):
            _, _, _, firsts, values = _values(block)
            hashes = window_hashes(values, short)
            doc, fits = _inside(firsts, len(values), short)
            doc, fits = doc[:len(hashes)], fits[:len(hashes)]
            at = np.flatnonzero(fits & chosen[(np.arange(len(hashes)) - firsts[doc]) % period])
            yield block, firsts, doc[at], at, hashes[at]

    def anchor_slots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from gathered(hashes for *_, hashes in anchors(batches))

    several = shared_table(docs, packed_slots(named.mapInArrow(anchor_slots, GATHERED)))

    def repeated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(several)
        for block, firsts, doc, at, hashes in anchors(batches):
            keep = may_repeat(table, hashes)
            doc, at = doc[keep], at[keep]
            ids = block.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [as_long(hashes[keep]), pa.array(ids[doc]), pa.array((at - firsts[doc]).astype(np.int32))], ["h", "doc_id", "at"])

    found = written(named.mapInArrow(repeated, "h long, doc_id long, at int"), "anchors")
    shared = found.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    # One row per document: from where to where windows hold a shared anchor. Such rows are small,
    # so they are broadcast as long as they are few, and texts move only beyond that.
    places = written(found.join(shared.select("h"), "h", "left_semi").groupBy("doc_id")
                     .agg(F.sort_array(F.collect_set(F.struct("at", F.lit(None).cast("long").alias("mark")))).alias("at"))
                     .join(named.groupBy("doc_id").agg((F.count("*") > 1).alias("many")), "doc_id")
                     .select("doc_id", "at", "many").mapInArrow(_runs(period - 1, 1), RUNS + ", many boolean"), "places")
    around = written(named.join(_few(places), "doc_id").select("doc_id", "text", "runs", "many"), "around")

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for block in small_blocks(batches):
            _, _, _, firsts, values = _values(block)
            marks = np.zeros(len(values) + 1, np.int64)
            for row, runs in enumerate(block.column("runs")):
                # Those beyond the end stand in another text of the same id.
                first, last = (np.minimum(runs.values.field(c).to_numpy() + firsts[row], firsts[row + 1]) for c in ("first", "last"))
                np.add.at(marks, first, 1)
                np.add.at(marks, last, -1)
            near = np.cumsum(marks)[:-1] > 0
            a, b = window_hashes(values, window), window_hashes(values ^ SECOND, window)
            doc, fits = _inside(firsts, len(values), window)
            at = np.flatnonzero(near[:len(a)] & fits[:len(a)])
            yield block, firsts, doc[at], at, a[at], b[at]

    def window_slots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from gathered(a for *_, a, _ in windows(batches))

    both = shared_table(docs, packed_slots(around.mapInArrow(window_slots, GATHERED)))

    def compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(both)
        for block, firsts, doc, at, a, b in windows(batches):
            keep = may_repeat(table, a)
            doc, at, a, b = doc[keep], at[keep], a[keep], b[keep]
            ids = block.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            # Where an id has several texts, a window is told by its value as well as by its place.
            many = block.column("many").to_numpy(zero_copy_only=False).astype(bool)
            mark = pa.array(a.view(np.int64), mask=~many[doc])
            yield pa.RecordBatch.from_arrays(
                [as_long(a), as_long(b), pa.array(ids[doc]), pa.array((at - firsts[doc]).astype(np.int32)), mark],
                ["a", "b", "doc_id", "at", "mark"])

    long = written(around.mapInArrow(compared, "a long, b long, doc_id long, at int, mark long"), "windows")
    first = long.groupBy("a", "b").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    hits = written(long.join(first, ["a", "b"]).where("doc_id > low").groupBy("doc_id")
                   .agg(F.sort_array(F.collect_set(F.struct("at", "mark"))).alias("at"))
                   .mapInArrow(_runs(0, window), RUNS), "hits")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in small_blocks(batches):
            buf, starts, ends, firsts, values = _values(block)
            raw = buf.tobytes()
            hashes = window_hashes(values, window).view(np.int64)
            rows = []
            for row, hits in enumerate(block.column("runs")):
                lo, hi = int(firsts[row]), int(firsts[row + 1])
                gone = np.zeros(hi - lo + 1, np.int64)
                if hits.is_valid:
                    first, last, marks = (hits.values.field(c) for c in ("first", "last", "mark"))
                    first, last = first.to_numpy(), last.to_numpy()
                    if not marks.null_count:  # others may stand in another text of the same id
                        fits = last <= hi - lo
                        own = hashes[first[fits] + lo] == marks.to_numpy()[fits]
                        first, last = first[fits][own], last[fits][own]
                    np.add.at(gone, first, 1)
                    np.add.at(gone, last, -1)
                left = np.flatnonzero(np.cumsum(gone)[:-1] == 0) + lo
                kept = b" ".join(raw[s:e] for s, e in zip(starts[left].tolist(), ends[left].tolist()))
                rows.append((hi - lo, hi - lo - len(left), hashlib.sha256(kept).hexdigest(), kept))
            n, removed, sha, kept = zip(*rows)
            columns = [block.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha)]
            if text:
                columns.append(pa.array([k.decode("utf-8", "replace") for k in kept]))
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + (["kept_text"] if text else [])
    return source.join(_few(hits), "doc_id", "left").select("doc_id", "text", "runs").mapInArrow(
        cut, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if text else ""))
