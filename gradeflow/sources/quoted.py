"""Quoted CSV files split over tasks.

A line break may stand inside a quoted cell, so a task that starts in the middle of a file
cannot know whether it starts in a cell.  It reads its lines under both assumptions; they
soon agree.  One row per split then tells every split's true start by a running combination
over the file, and a second scan parses each split from there.  The lines of a record that
crosses a border are picked out by their numbers and meet in one small group.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable, Iterator
from itertools import groupby, tee

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .paths import file_path

LINE_BREAK = "\n"
BATCH = 4096  # records in an output batch
_SUMMARY = (
    "_file string, _block long, _from long, _end0 int, _ended0 long, _most0 long, _tail0 long, _skip0 long, _fields0 long, "
    "_end1 int, _ended1 long, _most1 long, _tail1 long, _skip1 long, _fields1 long, _head1 long, _head_fields1 long"
)


def splittable(encoding: str) -> bool:
    """Whether a line feed is one byte that stands for nothing else."""
    return not encoding.lower().replace("_", "-").startswith(("utf-16", "utf16", "utf-32", "utf32", "utf-7", "utf7"))


def scan_lines(spark: SparkSession, roots: list[str], listing: dict[str, str]) -> DataFrame:
    """Lines as bytes, in file order within each split; only line feeds end them."""
    lines = spark.read.options(**listing, lineSep=LINE_BREAK).text(roots)
    return lines.select(
        F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"),
    )


def _pieces(line: bytes, encoding: str) -> list[str]:
    """A line with its end; lone carriage returns end lines too."""
    text = line.decode(encoding, "replace") + LINE_BREAK
    return re.split(r"(?<=\r)(?!\n)", text) if "\r" in text else [text]


class Records:
    """Records of a run of lines, which may start inside a quoted cell."""

    def __init__(self, lines: Iterator[bytes], sep: str, encoding: str, opened: bool = False):
        self.line = -1        # the last line taken
        self.rest = 0         # pieces of it not yet taken
        self.start = -1 if opened else 0  # the line in which the next record starts
        self.skip = 0         # records that ended in that line before it; negative if the first began before it
        self.ended = 0
        self.most = 0         # fields of the widest whole record
        self.over = False
        self.cells: list[str] = []
        self._lines, self._encoding, self._opened = lines, encoding, opened
        csv.field_size_limit(2**31 - 1)
        self._reader = csv.reader(self._feed(), delimiter=sep)

    def _feed(self) -> Iterator[str]:
        opening = '"' if self._opened else ""
        for line in self._lines:
            if opening and b'"' not in line:  # still inside the cell
                self.line += 1
                continue
            pieces = _pieces(line, self._encoding)
            self.line += 1
            self.rest = len(pieces)
            for piece in pieces:
                self.rest -= 1
                yield opening + piece
                opening = ""
        self.over = True
        yield opening + "."  # joins an open record, or is one of its own

    def advance(self) -> bool:
        """Read one record; False at the end, where ``cells`` are those of an open record, if any."""
        self.cells = next(self._reader)
        if self.over:
            return False
        self.ended += 1
        if self.rest:
            begun = self.start < self.line
            self.skip = -1 if begun else self.skip + (-1 if self.skip < 0 else 1)
            self.start = self.line
        else:
            self.start, self.skip = self.line + 1, 0
        return True

    @property
    def open(self) -> bool:
        """At the end: whether a record goes on in the next split."""
        return self.start <= self.line


def summarise(lines: Iterator[bytes], sep: str, encoding: str, first: bool) -> tuple:
    """What a split is under both assumptions: the numeric part of a summary row."""
    mine, other = tee(lines)
    a = Records(mine, sep, encoding)
    b = None if first else Records(other, sep, encoding, opened=True)
    del mine, other
    head, head_fields = 0, 0
    met = None  # where both came to a record's start at the same line
    after = 0   # fields of the widest record from there on
    a_open, b_open = True, b is not None
    while a_open or b_open:
        if b_open and (not a_open or b.line <= a.line):
            b_open = b.advance()
            if b_open:
                if b.ended == 1:
                    head, head_fields = b.line + 1, len(b.cells)
                else:
                    b.most = max(b.most, len(b.cells))
        else:
            a_open = a.advance()
            if a_open:
                a.most, after = max(a.most, len(a.cells)), max(after, len(a.cells))
        if b_open and a_open and b.ended and (a.start, a.skip) == (b.start, b.skip) and not a.rest:
            met, after, b_open = (a.ended, b.ended), 0, False
            b._lines = b._reader = None  # nothing is kept for it any longer
    first_state = (int(a.open), a.ended, a.most, a.start, a.skip, len(a.cells) if a.open else 0)
    if b is None:
        return *first_state, 0, 0, 0, 0, 0, 0, 0, 0
    if met:
        ended = b.ended + a.ended - met[0]
        return *first_state, first_state[0], ended, max(b.most, after), *first_state[3:], head, head_fields
    return *first_state, int(b.open), b.ended, b.most, b.start, b.skip, len(b.cells) if b.open else 0, head, head_fields


def _splits(batches: Iterable[pa.RecordBatch], *more: str) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("_file", "_block", *more, "value", "_at")))

    keys = 2 + len(more)
    return groupby(rows(), key=lambda r: r[:keys])


def summaries(lines: DataFrame, sep: str, encoding: str) -> DataFrame:
    """One row per split."""
    names = [part.split()[0] for part in _SUMMARY.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, block), rows in _splits(batches):
            first = next(rows)

            def values():
                yield first[2]
                for row in rows:
                    yield row[2]

            found = summarise(values(), sep, encoding, block == 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], pa.int32() if n in ("_end0", "_end1") else None)
                 for n, x in zip(names, (file, block, first[3], *found))], names)

    return lines.mapInArrow(run, _SUMMARY)


def offsets(found: DataFrame) -> DataFrame:
    """The true start of every split, how many records ended before it, and its open ends.

    Each split maps the state at its start to that at its end: it forces one, keeps it, or
    swaps it.  So a state is the last forced one, swapped as often as there were swaps since.
    """
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    forced = F.col("_end0") == F.col("_end1")
    swaps = F.when(~forced & (F.col("_end0") == 1), 1).otherwise(0)
    # A file's first split is only read as a record's start.
    fixed = F.when(forced | (F.col("_block") == 0), F.struct(F.col("_end0").alias("end"), F.col("_swaps").alias("swaps")))
    last = F.last(F.col("_fixed"), ignorenulls=True).over(earlier)
    state = F.when(last.isNull(), 0).otherwise(
        (last["end"] + F.coalesce(F.sum("_swap").over(earlier), F.lit(0)) - last["swaps"]) % 2)
    known = (found.withColumn("_swap", swaps).withColumn("_swaps", F.sum("_swap").over(upto))
             .withColumn("_fixed", fixed).withColumn("_state", state.cast("int")))
    for name in ("_end", "_ended", "_most", "_tail", "_skip", "_fields"):
        known = known.withColumn(name, F.when(F.col("_state") == 0, F.col(f"{name}0")).otherwise(F.col(f"{name}1")))
    before = F.coalesce(F.sum("_ended").over(earlier), F.lit(0))
    return known.select("_file", "_block", "_from", "_state", "_end", "_ended", "_most", "_tail", "_skip", "_fields",
                        F.when(F.col("_state") == 1, F.col("_head1")).otherwise(0).alias("_head"),
                        F.when(F.col("_state") == 1, F.col("_head_fields1")).otherwise(0).alias("_head_fields"),
                        before.alias("_before"))


def _ends(splits: DataFrame) -> DataFrame:
    """Parts of records that cross a border: their record, fields, lines and place.

    The part at a split's start belongs to the record that all earlier ones ended before; it is the
    whole split where no record ends in it.
    """
    through = (F.col("_state") == 1) & (F.col("_ended") == 0)
    head = F.when((F.col("_state") == 1) & ~through, F.struct(
        F.col("_before").alias("_record"), F.col("_head_fields").alias("_n"), F.lit(0).cast("long").alias("_first"),
        F.col("_head").alias("_last"), F.lit(0).cast("long").alias("_leave")))
    tail = F.when(F.col("_end") == 1, F.struct(
        (F.col("_before") + F.col("_ended")).alias("_record"), F.col("_fields").alias("_n"),
        F.when(through, 0).otherwise(F.col("_tail")).cast("long").alias("_first"),
        F.lit(2**62).alias("_last"), F.when(through, 0).otherwise(F.col("_skip")).cast("long").alias("_leave")))
    return splits.select("_file", "_block", "_from", F.explode(F.array_compact(F.array(head, tail))).alias("_p")).select(
        "_file", "_block", "_from", "_p.*")


def width(splits: DataFrame) -> int:
    """Fields of the widest record; parts of one share the cell that a border cuts."""
    broken = _ends(splits).groupBy("_file", "_record").agg((F.sum("_n") - F.count("*") + 1).alias("_n"))
    return splits.select(F.col("_most").alias("_n")).union(broken.select("_n")).agg(F.max("_n")).first()[0] or 0


def cells(lines: DataFrame, splits: DataFrame, sep: str, encoding: str) -> DataFrame:
    """``raw_data``, ``_file`` and ``_record`` (from 0) of every record, blank ones included.

    ``splits`` has one row per split of 128 MB, which is broadcast: 100 TB are under a million.
    """
    schema = "raw_data array<string>, _file string, _record long"

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.list_(pa.string()), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["raw_data", "_file", "_record"])

    def batched(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in rows:
            held.append(row)
            if len(held) == BATCH:
                yield batch_of(held)
                held = []
        if held:
            yield batch_of(held)

    def inside(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for (file, block, state, before), rows in _splits(batches, "_state", "_before"):
                records = Records((r[4] for r in rows), sep, encoding, opened=state == 1)
                while records.advance():
                    if records.ended > 1 or state == 0:
                        yield records.cells, file, before + records.ended - 1

        return batched(found())

    def across(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found():
            for batch in batches:
                for file, record, leave, parts in zip(*(batch.column(c).to_pylist() for c in ("_file", "_record", "_leave", "parts"))):
                    records = Records(iter(parts), sep, encoding, opened=leave < 0)
                    more = True
                    for _ in range(abs(leave) + 1):
                        more = records.advance()
                    out = records.cells
                    if not more:  # the file ends inside a quoted cell: without what marks the end here
                        out[-1] = out[-1][:-1]
                    yield out, file, record

        return batched(found())

    starts = F.broadcast(splits.select("_file", "_block", "_state", "_before"))
    whole = lines.join(starts, ["_file", "_block"]).select("_file", "_block", "_state", "_before", "value", "_at")
    broken = lines.join(F.broadcast(_ends(splits)), ["_file", "_block"]).where(
        (F.col("_at") - F.col("_from") >= F.col("_first")) & (F.col("_at") - F.col("_from") < F.col("_last")))
    broken = broken.groupBy("_file", "_record").agg(
        F.max_by("_leave", F.abs("_leave")).alias("_leave"),
        F.transform(F.sort_array(F.collect_list(F.struct("_block", "_at", "value"))), lambda x: x["value"]).alias("parts"))
    return whole.mapInArrow(inside, schema).union(broken.mapInArrow(across, schema))


def read_quoted(spark: SparkSession, roots: list[str], listing: dict[str, str], sep: str, encoding: str,
                skip_header: bool, fields: int | None, keep) -> DataFrame:
    """``raw_data``, ``_source_file`` and ``_row_index`` of every record, split over tasks.

    Cells and row numbers are those of one reader over the whole file; blank rows are
    counted.  Short rows are filled with empty cells up to ``fields``, or the widest record.
    ``keep`` writes a small frame.
    """
    lines = scan_lines(spark, roots, listing)
    splits = keep(offsets(summaries(lines, sep, encoding)), "splits")
    most = width(splits) if fields is None else fields
    rows = cells(lines, splits, sep, encoding)
    if skip_header:
        rows = rows.where("_record > 0")
    filled = F.concat("raw_data", F.array_repeat(F.lit(""), F.greatest(F.lit(0), F.lit(most) - F.size("raw_data"))))
    if fields is not None:
        filled = F.slice(filled, 1, max(1, most))
    return rows.select(filled.alias("raw_data"), file_path("_file").alias("_source_file"),
                       (F.col("_record") - int(skip_header)).alias("_row_index"))
