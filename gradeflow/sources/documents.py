"""JSON, JSON Lines, Parquet and word-list scans."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.strict_json import parse_whole
from ..functions.text import strip
from .arrays import elements
from .lines import attach_line_labels, read_numbered_lines
from .paths import exclude_paths, exists, file_path, listing_options, resolve

def _struct(schema: str | T.StructType) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _empty(spark: SparkSession, fields: T.StructType, **extra: str) -> DataFrame:
    nulls = [F.lit(None).cast(kind).alias(name) for name, kind in extra.items()]
    return spark.createDataFrame([], fields).select("*", *nulls)


def read_json(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: str | T.StructType,
    *,
    recursive: bool = False,
    suffix: str = "json",
) -> DataFrame:
    """S3: one document per file; an array gives a row per element, an object one row.

    Files that do not parse give no rows.  Arrays are split over tasks, also in one file
    without line breaks (see ``arrays``); a single object is one task's.
    """
    roots = resolve(spark, paths, suffix, recursive)
    fields = _struct(schema)
    if not roots:
        return _empty(spark, fields, _source_file="string", _row_index="long")
    found = elements(spark, roots, listing_options(suffix, recursive))
    # A filter on a computed column would parse every element twice; below a generator it does not.
    rows = found.select(file_path("_file").alias("_source_file"), F.col("_number").alias("_row_index"),
                        F.explode_outer(F.array(parse_whole(F.col("text"), fields))).alias("_item"))
    return rows.filter(F.col("_item").isNotNull()).select("_item.*", "_source_file", "_row_index")


def parse_json_lines(lines: DataFrame, schema: str | T.StructType, keep: Sequence[str] = ()) -> DataFrame:
    """Records of a ``value`` column; lines that are not one JSON object are dropped.

    A value of another type than the schema states is null; the record is kept.
    """
    fields = _struct(schema)
    record = parse_whole(F.col("value"), fields)
    # A filter on a computed column is pushed below it and would parse every line twice;
    # it is not pushed below a generator.
    parsed = lines.select(*keep, F.explode_outer(F.array(record)).alias("_r"))
    parsed = parsed.filter(F.col("_r").isNotNull())
    return parsed.select(*[F.col("_r")[f.name].alias(f.name) for f in fields.fields], *keep)


def read_jsonl(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: str | T.StructType,
    *,
    recursive: bool = False,
    suffix: str = "jsonl",
    exclude_path_patterns: Iterable[str] = (),
    labelled_paths: str | None = None,
) -> DataFrame:
    """One record per line; a bad line is skipped, the file is kept.

    ``exclude_path_patterns`` drops files whose path contains a pattern (S8).  Files
    whose path contains ``labelled_paths`` take a ``label`` column from their
    ``-labels.lst`` neighbour by line number (S5).
    """
    fields = _struct(schema)
    if labelled_paths is None:
        roots = resolve(spark, paths, suffix, recursive)
        if not roots:
            return _empty(spark, fields, _source_file="string")
        text = spark.read.options(**listing_options(suffix, recursive)).text(roots)
        lines = text.select("value", file_path().alias("_source_file"))
        lines = exclude_paths(lines, F.col("_source_file"), exclude_path_patterns)
        return parse_json_lines(lines, fields, ["_source_file"])
    lines = read_numbered_lines(spark, paths, suffix, recursive)
    lines = exclude_paths(lines, F.col("_source_file"), exclude_path_patterns)
    folders = [paths] if isinstance(paths, str) else list(paths)
    beside = [p[: -len(suffix) - 1] + "-labels.lst" if p.endswith(f".{suffix}") else p for p in folders]
    labels = read_numbered_lines(spark, beside, "lst", recursive)
    labels = labels.filter(F.col("_source_file").contains(labelled_paths))
    labelled = attach_line_labels(lines, labels, lines_suffix=f".{suffix}")
    return parse_json_lines(labelled, fields, ["label", "_source_file", "line_no"])


def read_parquet(
    spark: SparkSession,
    paths: str | Sequence[str],
    *,
    recursive: bool = False,
    val: bool = False,
    suffix: str = "parquet",
    raw: bool = False,
) -> DataFrame:
    """Parquet rows with ``_source_file`` and ``_row_index``.

    ``val=True`` keeps the files whose name contains ``val``, already when listing.
    ``raw=True`` packs the columns into one ``raw_data`` struct.  Otherwise columns
    stay at the top level, where pruning and filters reach the files.
    """
    roots = resolve(spark, paths, suffix, recursive)
    if not roots:
        raise FileNotFoundError(f"no .{suffix} file under {paths}")
    reader = spark.read.options(**listing_options(suffix, recursive, "val" if val else ""))
    table = reader.parquet(*roots)
    place = [file_path().alias("_source_file"), F.col("_metadata.row_index").alias("_row_index")]
    return table.select(F.struct("*").alias("raw_data") if raw else "*", *place)


def read_stop_words(spark: SparkSession, path: str) -> DataFrame:
    """Distinct trimmed words, one per line; a missing file is an empty set."""
    if not exists(spark, path):
        return spark.createDataFrame([], "word string")
    return spark.read.text(path).select(strip(F.col("value")).alias("word")).distinct()


def stop_word_list(words: DataFrame, limit: int = 100_000) -> list[str]:
    """The words on the driver, for ``remove_stop_words``; refuses a list beyond ``limit``."""
    rows = words.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} stop words; use stop_word_filter, which joins")
    return [r["word"] for r in rows]


def stop_word_filter(df: DataFrame, key: Sequence[str], tokens: str, words: DataFrame) -> DataFrame:
    """L6 for lists of any size: tokens that match no listed word, in order.

    Distinct tokens of a row are exploded and joined with the list; the row then drops
    those that were found.  Rows are told apart by ``key`` and a hash of their tokens:
    what a list of tokens loses depends on the list alone, so rows that repeat both get
    the same, right result.  A row whose tokens all vanish keeps an empty list.
    """
    same = F.xxhash64(F.col(tokens))
    marked = df.withColumn("_list", same)
    parts = marked.select(*key, "_list", F.explode(F.array_distinct(tokens)).alias("_token"))
    found = parts.join(words.select(F.col("word").alias("_token")).distinct(), "_token", "left_semi")
    lists = (found.groupBy(*key, "_list").agg(F.collect_set("_token").alias("_gone"))
             .select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(key)], F.col("_list").alias("_key_list"), "_gone"))
    on = F.col("_list") == F.col("_key_list")
    for i, k in enumerate(key):
        on = on & F.col(k).eqNullSafe(F.col(f"_key_{i}"))
    none = F.array().cast("array<string>")
    left = F.filter(F.coalesce(F.col(tokens), none), lambda t: t.isNotNull() & ~F.array_contains(F.coalesce("_gone", none), t))
    return marked.join(lists, on, "left").withColumn(tokens, left).select(*df.columns)
