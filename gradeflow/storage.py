"""Tables written to the folder that all executors share, and their removal."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from .session import shared_folder

_folders: list[tuple[SparkSession, str]] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; what is there goes when its scope or the driver ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _folders.append((spark, path))
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    What is used several times is then computed once, and a lost executor costs one scan.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scope() -> Iterator[None]:
    """Remove the folders made inside, once their readers are done."""
    before = len(_folders)
    try:
        yield
    finally:
        remove(before)


@atexit.register
def remove(first: int = 0) -> None:
    """Remove the folders made since the first ``first`` ones."""
    while len(_folders) > first:
        spark, path = _folders.pop()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended: its owner cleans the shared folder
            return
