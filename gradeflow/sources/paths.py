"""Path resolution shared by the file readers."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

log = logging.getLogger(__name__)


def exists(spark: SparkSession, pattern: str) -> bool:
    """Whether a path, or anything a glob pattern stands for, is there."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(target)
    return found is not None and len(found) > 0


def resolve(
    spark: SparkSession, paths: str | Sequence[str], suffix: str, recursive: bool = False
) -> list[str]:
    """Existing roots, each once and sorted.

    A missing path and a single file of another suffix are logged and left out.
    Folders are not listed here; Spark lists them with the options of
    :func:`listing_options`.  A path that a listed folder already covers is dropped.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    files, folders = set(), set()
    for raw in [paths] if isinstance(paths, str) else list(paths):
        path = hadoop(raw)
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            log.warning("path does not exist: %s", raw)
            continue
        status = fs.getFileStatus(path)
        full = status.getPath().toString()
        if status.isDirectory():
            folders.add(full)
        elif full.endswith(f".{suffix}"):
            if full.rsplit("/", 1)[1].startswith(("_", ".")):
                log.warning("Spark reads no file with a hidden name: %s", raw)
            files.add(full)
        else:
            log.warning("not a .%s file: %s", suffix, raw)

    def covered(path: str) -> bool:
        above = [path.rsplit("/", i)[0] for i in range(1, path.count("/") - 1)]
        return any(a in folders for a in (above if recursive else above[:1] if path in files else []))

    return sorted(p for p in files | folders if not covered(p))


def listing_options(suffix: str, recursive: bool, contains: str = "") -> dict[str, str]:
    return {
        "pathGlobFilter": f"*{contains}*.{suffix}" if contains else f"*.{suffix}",
        "recursiveFileLookup": str(bool(recursive)).lower(),
        "ignoreMissingFiles": "true",
    }


def file_path(col: str = "_metadata.file_path") -> Column:
    """A file's path as written; the metadata column holds it percent-encoded."""
    return F.url_decode(F.replace(F.col(col), F.lit("+"), F.lit("%2B")))


def exclude_paths(df: DataFrame, path: Column, patterns: Iterable[str]) -> DataFrame:
    """Drop rows of files whose path contains one of the patterns."""
    for pattern in patterns:
        df = df.filter(~path.contains(pattern))
    return df
