"""Loading as configured: reader, formatter and sample by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.sampling import head_biased_cap, sample_n, take
from ..registry import formatters, loaders
from ..sources import read_csv, read_json, read_jsonl, read_parquet, read_tsv

# Where a row stands in the input: unique, and there whatever the rows hold.
PLACE = ["_source_file", "_row_index"]


def _pick(config: dict, *names: str) -> dict:
    return {n: config[n] for n in names if n in config}


@loaders.register("CSVDataLoader")
def _csv(spark: SparkSession, config: dict) -> DataFrame:
    options = _pick(config, "encoding", "skip_header", "recursive", "suffix", "sep", "width", "multi_line")
    rows = read_csv(spark, config["paths"], **options)
    return head_biased_cap(rows, config.get("num", -1)) if config.get("head_biased") else rows


@loaders.register("TSVDataLoader")
def _tsv(spark: SparkSession, config: dict) -> DataFrame:
    options = _pick(config, "encoding", "skip_header", "recursive", "suffix", "width")
    return read_tsv(spark, config["paths"], **options)


@loaders.register("JsonLoader")
def _json(spark: SparkSession, config: dict) -> DataFrame:
    return read_json(spark, config["paths"], config["schema"], **_pick(config, "recursive"))


@loaders.register("JsonlLoader")
def _jsonl(spark: SparkSession, config: dict) -> DataFrame:
    options = _pick(config, "recursive", "suffix", "exclude_path_patterns", "labelled_paths")
    return read_jsonl(spark, config["paths"], config["schema"], **options)


@loaders.register("ParquetDataLoader")
def _parquet(spark: SparkSession, config: dict) -> DataFrame:
    return read_parquet(spark, config["paths"], **_pick(config, "recursive", "val", "suffix", "raw"))


def _default_key(rows: DataFrame) -> list[str]:
    if set(PLACE) <= set(rows.columns):
        return PLACE
    if "question_id" in rows.columns:
        return ["question_id"]
    raise ValueError(f"name the unique columns as 'key'; the rows have {rows.columns}")


def load(spark: SparkSession, config: dict) -> DataFrame:
    """Read, format and sample as one configuration entry says.

    ``class`` names the loader, ``formatter_name`` the formatter, ``num`` the sample
    size, ``seed`` its seed and ``key`` the unique columns that order it; unless given,
    a row's file and number, else ``question_id``.  With ``first=True`` the sample is
    the first ``num`` rows in key order, taken before formatting.
    """
    rows = loaders.get(config["class"])(spark, config)
    num = config.get("num", -1)
    key = config.get("key")
    if config.get("first"):
        rows = take(rows, num, key or _default_key(rows))
    if config.get("formatter_name"):
        rows = rows.transform(formatters.get(config["formatter_name"]))
    if num == -1 or config.get("first"):
        return rows
    return sample_n(rows, num, key or _default_key(rows), config.get("seed", 42))
