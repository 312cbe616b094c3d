"""JSON documents split over tasks (S3).

A task that starts in the middle of a document does not know whether it starts in a string,
nor how deep.  A first scan counts, for every split and under both assumptions, the change of
depth and the commas at each depth; one row per split then tells all splits their true start.
A second scan cuts the elements of the outermost array at its own commas.  Parts of elements
that cross a border meet in one small group.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..sizes import broadcast_if, file_count, unsplit_bytes
from ..storage import keep

# Pieces of files end at closing braces, so records give short pieces.  A brace is never the
# escaped character of a valid string, so no escape crosses a piece's end.
PIECE_END = "}"
BLANK = b" \t\n\r"  # fixed values: white space between JSON tokens
BATCH = 2048
RUN = 1 << 18  # bytes that are looked at together; their places and depths take some sixty times that

def scan_pieces(spark: SparkSession, roots: list[str], listing: dict[str, str]) -> DataFrame:
    pieces = spark.read.options(**listing, lineSep=PIECE_END).text(roots)
    meta = {"_file": "file_path", "_block": "file_block_start", "_size": "file_size"}
    return pieces.select(F.col("value").cast("binary").alias("value"),
                         *[F.col(f"_metadata.{v}").alias(k) for k, v in meta.items()])


def structure(text: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Which characters stand in strings, the change of depth at each, and how many quotes count."""
    quotes = text == 34
    slashes = text == 92
    if slashes.any():
        at = np.flatnonzero(quotes[1:] & slashes[:-1]) + 1  # quotes behind a backslash
        place = np.arange(len(text))
        before = np.maximum.accumulate(np.where(slashes, -1, place))  # the last other character
        quotes[at[(at - 1 - before[at - 1]) % 2 == 1]] = False
    count = np.cumsum(quotes)
    strings = (count - quotes + inside) % 2 == 1
    opens = ((text == 123) | (text == 91)) & ~strings
    closes = ((text == 125) | (text == 93)) & ~strings
    return strings, opens.astype(np.int64) - closes, int(count[-1]) if len(count) else 0


def _runs(text: bytes) -> Iterator[bytes]:
    """A text in parts of about ``RUN`` bytes; none ends in a backslash, so no escape crosses an end."""
    start = 0
    while len(text) - start > 2 * RUN:
        end = start + RUN
        while end < len(text) and text[end - 1] == 92:
            end += 1
        yield text[start:end]
        start = end
    yield text[start:] if start else text


def _rows(batch: pa.RecordBatch, keys: Iterable[str], text: str) -> Iterator[list[tuple]]:
    """The rows of a batch as Python values, by slices of about ``RUN`` bytes of text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        done = int(sizes[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, done + RUN, "right")))
        part = batch.slice(start, end - start)
        yield list(zip(*(part.column(c).to_pylist() for c in (*keys, text))))
        start = end


def _splits(batches: Iterable[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, Iterator[bytes]]]:
    """Each split with its text in runs of pieces; every piece gets its end back."""
    def runs():
        for batch in batches:
            for rows in _rows(batch, keys, "value"):
                for key, group in groupby(rows, key=lambda r: r[:-1]):
                    for run in _runs(b"".join(x for r in group for x in (r[-1], b"}"))):
                        yield key, run

    for key, group in groupby(runs(), key=lambda r: r[0]):
        yield key, (text for _, text in group)


def summaries(pieces: DataFrame) -> DataFrame:
    """One row per split: bytes, quotes, and under both assumptions depth and commas by depth."""
    schema = ("_file string, _block long, _size long, _bytes long, _quotes long, _lead string, "
              "_depth0 long, _depth1 long, _commas0 map<long,long>, _commas1 map<long,long>")
    names = [c.split()[0] for c in schema.split(", ")]
    counts = pa.map_(pa.int64(), pa.int64())
    kinds = [pa.string(), *[pa.int64()] * 4, pa.string(), pa.int64(), pa.int64(), counts, counts]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, texts in _splits(batches, "_file", "_block", "_size"):
            size = quotes = 0
            lead = None
            depth, commas = [0, 0], [Counter(), Counter()]
            for raw in texts:
                text = np.frombuffer(raw, np.uint8)
                for start in (0, 1):
                    strings, change, count = structure(text, (start + quotes) % 2 == 1)
                    levels = depth[start] + np.cumsum(change)
                    at = (text == 44) & ~strings
                    for level, n in zip(*np.unique(levels[at], return_counts=True)):
                        commas[start][int(level)] += int(n)
                    depth[start] = int(levels[-1])
                quotes += count
                size += len(raw)
                if lead is None and (shown := raw.lstrip(BLANK)):
                    lead = shown[:1].decode("latin-1")
            row = (*key, size, quotes, lead, *depth, *(list(c.items()) for c in commas))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names)

    return pieces.mapInArrow(run, schema)


def offsets(found: DataFrame) -> DataFrame:
    """The true start of every split: in a string or not, how deep, behind how many commas."""
    order = Window.partitionBy("_file").orderBy("_block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)

    def before(value) -> F.Column:
        return F.coalesce(F.sum(value).over(earlier), F.lit(0))

    def true(name: str):
        return F.when(F.col("_inside"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))

    known = found.withColumn("_inside", before(F.col("_quotes")) % 2 == 1)
    known = known.withColumn("_depth", before(true("_depth")))
    commas = F.coalesce(F.element_at(true("_commas"), 1 - F.col("_depth")), F.lit(0))
    everything = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return known.select(
        "_file", "_block", "_inside", "_depth", before(commas).alias("_number"), before(F.col("_bytes")).alias("_before"),
        (F.count("_lead").over(earlier) > 0).alias("_begun"),
        F.coalesce(F.first("_lead", ignorenulls=True).over(everything) == "[", F.lit(False)).alias("_array"))


class _Element:
    """What a task knows of the element it reads: its text here, and whether it began here."""

    def __init__(self, number: int, begun: bool):
        self.number, self.whole, self.parts = number, begun, []


def _cut(texts: Iterator[bytes], inside: bool, depth: int, number: int, before: int, size: int, begun: bool):
    """(number, text, whole, last) of the elements of a split, and None where the file is malformed."""
    element = _Element(number, False) if depth > 0 else None
    position = before
    for raw in texts:
        position += len(raw)
        if position > size:  # the file does not end in a brace
            raw = raw[:-1]
        text = np.frombuffer(raw, np.uint8)
        strings, change, quotes = structure(text, inside)
        levels = depth + np.cumsum(change)
        cuts = np.flatnonzero(((text == 44) & ~strings & (levels == 1)) | ((change > 0) & (levels == 1)) | ((change < 0) & (levels == 0)))
        start = 0
        for at in cuts.tolist():
            part, sign = raw[start:at], text[at]
            start = at + 1
            if sign == 44:
                element.parts.append(part)
                yield element.number, b"".join(element.parts), element.whole, False
                element = _Element(element.number + 1, True)
            elif change[at] > 0:
                if begun or sign != 91 or part.strip(BLANK):
                    yield None
                    return
                begun, element = True, _Element(number, True)
            else:
                if sign != 93:
                    yield None
                    return
                element.parts.append(part)
                yield element.number, b"".join(element.parts), element.whole, True
                element = None
        if element:
            element.parts.append(raw[start:])
        elif raw[start:].strip(BLANK):
            yield None
            return
        if len(levels):
            depth = int(levels[-1])
            if levels.min() < 0:
                yield None
                return
        inside = (inside + quotes) % 2 == 1
    if position >= size and (depth or inside):
        yield None
    elif element:
        yield element.number, b"".join(element.parts), False, False


def _sound(text: bytes, number: int, last: bool) -> bool:
    """Whether an element is one JSON value; only the sole element of an empty array is blank."""
    if not text.strip(BLANK):
        return last and number == 0
    try:
        json.loads(text.decode(), parse_int=len, parse_float=len)  # numbers of any length
        return True
    except (ValueError, RecursionError):
        return False


def _whole_file(texts: Iterator[bytes], size: int) -> Iterator[tuple | None]:
    """As :func:`_cut` for a file that one task reads from its start; a single value is one element."""
    head: list[bytes] = []
    for raw in texts:
        head.append(raw)
        if shown := raw.lstrip(BLANK):
            if shown[:1] == b"[":
                yield from _cut(chain(head, texts), False, 0, 0, 0, size, False)
                return
            break
    text = b"".join(chain(head, texts))
    yield 0, text[:-1] if len(text) > size else text, True, True


def elements(spark: SparkSession, roots: list[str], listing: dict[str, str]) -> DataFrame:
    """``_file``, ``_number`` and ``text`` of the elements of arrays, or of whole single documents.

    A malformed file gives none.  A document that is not an array is one element, of one task.
    Files too small to be split are read once.  The starts of the others have a row per split of
    128 MB and are broadcast: 100 TB are under a million.
    """
    pieces = scan_pieces(spark, roots, listing)
    small = F.col("_size") <= unsplit_bytes(spark)
    large = pieces.where(~small)
    starts = keep(offsets(summaries(large)), "json-starts")
    schema = "_file string, _number long, _block long, text string, _last boolean, _bad boolean"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_()]
    schema = schema.replace("text string", "text binary")

    def batched(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for row in rows:
            held.append(row)
            size += len(row[3] or b"")
            if len(held) == BATCH or size > RUN:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names)

    def checked(file: str, block: int, found: Iterable[tuple | None]) -> Iterator[tuple]:
        for element in found:
            if element is None:
                yield file, None, block, None, False, True
                continue
            at, text, whole, last = element
            if whole:
                yield file, at, None, text, last, not _sound(text, at, last)
            else:
                yield file, at, block, text, last, False

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (file, block, size, inside, depth, number, before, begun, is_array), texts in _splits(
                    batches, "_file", "_block", "_size", "_inside", "_depth", "_number", "_before", "_begun", "_array"):
                if not is_array:
                    whole = b"".join(texts)
                    yield file, 0, block, whole[:-1] if before + len(whole) > size else whole, True, False
                    continue
                yield from checked(file, block, _cut(texts, inside, depth, number, before, size, begun))

        return batched(rows())

    def cut_files(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched(row for (file, block, size), texts in _splits(batches, "_file", "_block", "_size")
                       for row in checked(file, block, _whole_file(texts, size)))

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched((file, number, None, text, last, not _sound(text, number, last)) for batch in batches
                       for part in _rows(batch, ("_file", "_number", "_last"), "text") for file, number, last, text in part)

    split = large.join(F.broadcast(starts), ["_file", "_block"]).mapInArrow(cut, schema)
    found = keep(split.union(pieces.where(small).mapInArrow(cut_files, schema)), "json-elements")
    parts = found.where(F.col("_block").isNotNull() & ~F.col("_bad")).groupBy("_file", "_number").agg(
        F.max("_last").alias("_last"), F.sort_array(F.collect_list(F.struct("_block", "text"))).alias("parts"))
    text = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["text"]))
    joined = keep(parts.select("_file", "_number", "_last", text.alias("text")).mapInArrow(check, schema), "json-joined")
    whole = found.where(F.col("_block").isNull()).unionByName(joined)
    bad = found.select("_file", "_bad").union(joined.select("_file", "_bad")).where("_bad").select("_file").distinct()
    sound = whole.join(broadcast_if(bad, file_count(pieces)), "_file", "left_anti")
    return sound.select("_file", "_number", F.decode("text", "utf-8").alias("text"))
