"""CSV and TSV scans."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import bind
from ..operators.formatting import clean_cells
from ..storage import keep
from .lines import number_rows, scan_position
from .paths import file_path, listing_options, resolve
from .quoted import read_quoted, splittable

RAW_SCHEMA = "raw_data array<string>, _source_file string, _row_index long"

# Fixed value: how many leading characters decide the delimiter.
SNIFF_CHARS = 1024


def sniff_delimiter(text: str) -> str:
    try:
        return csv.Sniffer().sniff(text[:SNIFF_CHARS]).delimiter
    except csv.Error:
        return ","


def _files_by_delimiter(spark: SparkSession, roots: list[str], listing: dict[str, str]) -> dict[str, list[str]]:
    """Every file's delimiter, from its own first characters; only those and names reach the driver."""
    lines = spark.read.options(**listing).text(roots).select(
        F.substring("value", 1, SNIFF_CHARS).alias("value"), *scan_position()
    ).filter("_block = 0")
    # A task reads a file's first split in order, so its smallest ids are the first lines.
    first = lines.groupBy("_file").agg(F.min("_at").alias("_from"))
    head = lines.join(first, "_file").filter(F.col("_at") < F.col("_from") + SNIFF_CHARS)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "value"))), lambda x: x["value"]), "\n")
    found: dict[str, list[str]] = {}
    for row in head.groupBy(file_path("_file").alias("file")).agg(F.substring(text, 1, SNIFF_CHARS).alias("head")).collect():
        found.setdefault(sniff_delimiter(row["head"]), []).append(row["file"])
    return found


def _field_count(record: Column, sep: str, quote: bool) -> Column:
    """Fields of a record: separators outside quoted cells, and one more."""
    literal = re.escape(sep)
    if quote:
        # Without doubled quotes a quoted cell has no quote inside.
        record = F.regexp_replace(
            F.replace(record, F.lit('""'), F.lit("")), f'(^|{literal})"[^"]*+"(?={literal}|$)', "$1"
        )
    return F.size(F.split(record, literal, -1))


def _width(rows: DataFrame, record: str, sep: str, quote: bool) -> int:
    """Fields of the widest record of all; none may lose a cell."""
    others = [F.count(c) for c in rows.columns if c != record]  # Spark does not read broken records alone
    return rows.agg(F.max(_field_count(F.col(record), sep, quote)), *others).first()[0] or 1


def _numbered_lines(
    spark: SparkSession, roots: list[str], listing: dict[str, str], skip_header: bool, cells
) -> DataFrame:
    """Rows of files whose records are lines; ``cells`` maps a line to its cells."""
    lines = spark.read.options(**listing).text(roots).select("value", *scan_position())
    numbered = number_rows(lines, "_line")
    rows = numbered.filter(F.col("_line") > 0) if skip_header else numbered
    return rows.select(
        cells(F.col("value")).alias("raw_data"),
        file_path("_file").alias("_source_file"),
        (F.col("_line") - int(skip_header)).alias("_row_index"),
    )


def _read(
    spark: SparkSession,
    paths: str | Sequence[str],
    *,
    suffix: str,
    recursive: bool,
    encoding: str,
    skip_header: bool,
    sep: str | None,
    quote: bool,
    width: int | None,
    multi_line: bool,
    row_index: bool,
) -> DataFrame:
    roots = resolve(spark, paths, suffix, recursive)
    if not roots:
        return spark.createDataFrame([], RAW_SCHEMA)
    listing = listing_options(suffix, recursive)
    if sep is None:
        files = _files_by_delimiter(spark, roots, listing)
        if len(files) > 1:
            frames = [
                _read(spark, paths, suffix=suffix, recursive=False, encoding=encoding, skip_header=skip_header,
                      sep=own, quote=quote, width=width, multi_line=multi_line, row_index=row_index)
                for own, paths in sorted(files.items())
            ]
            return reduce(DataFrame.unionByName, frames)
        sep = next(iter(files), ",")
    if quote and multi_line and splittable(encoding):
        rows = clean_cells(read_quoted(spark, roots, listing, sep, encoding, skip_header, width, keep))
        return rows if row_index else rows.drop("_row_index")
    by_line = not multi_line and encoding.lower() in ("utf-8", "utf8") and (row_index or not quote)
    reading = {
        **listing, "sep": sep, "encoding": encoding, "quote": '"' if quote else "",
        "escape": '"' if quote else "\x00", "multiLine": str(multi_line).lower(), "mode": "PERMISSIVE",
    }
    if width is None and not (by_line and not quote):
        if by_line:
            width = _width(spark.read.options(**listing).text(roots), "value", sep, quote)
        else:
            # A record of more than one field is kept whole in the last column.
            broken = {"columnNameOfCorruptRecord": "_record"}
            records = spark.read.schema("_c0 string, _record string").options(**reading, **broken).csv(roots)
            width = _width(records, "_record", sep, quote)
    names = [f"_c{i}" for i in range(max(width or 1, 1))]
    options = {
        **reading,
        "header": str(skip_header).lower(),
        "enforceSchema": "true",
    }
    schema = ", ".join(f"`{n}` string" for n in names)
    if by_line:

        def cells(line: Column) -> Column:
            if not quote:
                found = F.split(line, re.escape(sep), -1)
                if width is None:
                    return found
                return F.concat(found, F.array_repeat(F.lit(""), F.greatest(F.lit(0), F.lit(width) - F.size(found))))
            parsed = F.from_csv(line, schema, {k: options[k] for k in ("sep", "quote", "escape", "mode")})
            return bind(parsed, lambda r: F.array(*[r[n] for n in names]))

        rows = clean_cells(_numbered_lines(spark, roots, listing, skip_header, cells))
        return rows if row_index else rows.drop("_row_index")
    cells = spark.read.schema(schema).options(**options).csv(roots)
    raw = F.array(*names).alias("raw_data")
    if not row_index:
        return clean_cells(cells.select(raw, file_path().alias("_source_file")))
    numbered = number_rows(cells.select(raw, *scan_position()), "_row_index")
    rows = numbered.select("raw_data", file_path("_file").alias("_source_file"), "_row_index")
    return clean_cells(rows)


def read_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    *,
    encoding: str = "utf-8",
    skip_header: bool = True,
    sep: str | None = None,
    recursive: bool = False,
    suffix: str = "csv",
    width: int | None = None,
    multi_line: bool = True,
    row_index: bool = True,
) -> DataFrame:
    """Trimmed cells as ``raw_data``, with ``_source_file`` and ``_row_index``.

    The first record of every file is skipped unless ``skip_header=False``, also in
    files without a header.  Unless given, ``sep`` is found for every file by its own
    head, and ``width`` (number of fields) is that of the widest record; short rows are
    filled with empty cells.  Row numbers count blank rows.

    Files are split over tasks, also where cells hold line breaks: a first scan finds how
    every split starts (see ``quoted``), a second one parses it.  In UTF-16 and UTF-32 a
    file is one task's, and its empty lines are not counted.  ``multi_line=False`` promises
    that no cell holds a line break; rows are then parsed in the JVM, with a counting scan
    for row numbers that ``row_index=False`` saves.
    """
    if sep is None and suffix == "tsv":
        sep = "\t"
    return _read(
        spark, paths, suffix=suffix, recursive=recursive, encoding=encoding,
        skip_header=skip_header, sep=sep, quote=True, width=width, multi_line=multi_line,
        row_index=row_index,
    )


def read_tsv(
    spark: SparkSession,
    paths: str | Sequence[str],
    *,
    encoding: str = "utf-8",
    skip_header: bool = True,
    recursive: bool = False,
    suffix: str = "tsv",
    width: int | None = None,
    row_index: bool = True,
) -> DataFrame:
    """Tab-separated rows; quotes are ordinary characters, so files split freely."""
    return _read(
        spark, paths, suffix=suffix, recursive=recursive, encoding=encoding,
        skip_header=skip_header, sep="\t", quote=False, width=width, multi_line=False,
        row_index=row_index,
    )
