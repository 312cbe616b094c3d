"""Numbered lines and side-by-side label files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.text import strip
from ..sizes import broadcast_if, split_bound
from .paths import file_path, listing_options, resolve


def number_rows(df: DataFrame, out: str, start: int = 0) -> DataFrame:
    """Number rows per file, in file order, without moving them.

    ``df`` comes straight from a file scan and has ``_file``, ``_block`` (where the
    scan's split starts) and ``_at`` (``monotonically_increasing_id``).  A split is read
    in order by one task, so a row's place in its split is its distance from the
    split's smallest id; adding the rows of the file's earlier splits gives its number.
    Only one row per split is shuffled, and those rows are broadcast as long as the
    scan's files and size bound their number.
    """
    splits = df.groupBy("_file", "_block").agg(
        F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_rows")
    )
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = splits.select(
        "_file", "_block", "_from", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")
    )
    number = F.col("_before") + (F.col("_at") - F.col("_from")) + start
    return (
        df.join(broadcast_if(offsets, split_bound(df)), ["_file", "_block"])
        .withColumn(out, number.cast("long"))
        .drop("_block", "_at", "_from", "_before")
    )


def scan_position() -> list:
    return [
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
    ]


def read_numbered_lines(
    spark: SparkSession, paths: str | Sequence[str], suffix: str = "jsonl", recursive: bool = False
) -> DataFrame:
    """Text lines as ``_source_file, line_no, value``; blank lines are counted."""
    roots = resolve(spark, paths, suffix, recursive)
    if not roots:
        return spark.createDataFrame([], "_source_file string, line_no long, value string")
    lines = spark.read.options(**listing_options(suffix, recursive)).text(roots)
    numbered = number_rows(lines.select("value", *scan_position()), "line_no")
    return numbered.select(file_path("_file").alias("_source_file"), "line_no", "value")


def attach_line_labels(
    lines: DataFrame,
    labels: DataFrame,
    lines_suffix: str = ".jsonl",
    labels_suffix: str = "-labels.lst",
) -> DataFrame:
    """``x-labels.lst`` line *i* becomes ``label`` of line *i* of ``x.jsonl``.

    A left equi-join on (stem, line number): a bad record line still uses up its label.
    """

    def stem(suffix: str):
        name = F.col("_source_file")
        return F.when(name.endswith(suffix), name.substr(F.lit(1), F.length(name) - len(suffix)))

    side = labels.select(
        stem(labels_suffix).alias("_stem"), "line_no", strip(F.col("value")).alias("label")
    )
    return lines.withColumn("_stem", stem(lines_suffix)).join(
        side, ["_stem", "line_no"], "left"
    ).drop("_stem")
