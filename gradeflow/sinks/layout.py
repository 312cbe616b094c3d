"""Files under chosen names (K1, K2): numbered chunks of records, and a tree of result files.

Spark writes every file's content as one row of a staging table, so lost or repeated tasks
leave nothing behind; the driver then gives the files their names, which is the commit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..sizes import broadcast_if, file_count
from ..sources.scores import RESULT_FILE
from ..storage import keep, new_folder

CHUNK_ROWS = 5000


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _publish(texts: DataFrame, names: dict[int, str], root: str, overwrite: Sequence[str] = ()) -> list[str]:
    """Write ``_file`` (a number) and ``value`` as one file each, named by ``names``.

    ``overwrite``: patterns of files under ``root`` that make room first. If a name cannot be
    given, those given before are taken back.
    """
    spark = texts.sparkSession
    staging = new_folder(spark, "layout")
    texts.write.partitionBy("_file").text(staging)
    fs = _path(spark, root).getFileSystem(spark._jsc.hadoopConfiguration())
    for pattern in overwrite:
        for old in fs.globStatus(_path(spark, f"{root}/{pattern}")) or []:
            fs.delete(old.getPath(), False)
    done = []
    try:
        for number, name in sorted(names.items()):
            target = _path(spark, f"{root}/{name}")
            parts = fs.globStatus(_path(spark, f"{staging}/_file={number}/part-*"))
            if len(parts) != 1:
                raise OSError(f"{len(parts)} files staged for {name}")
            fs.mkdirs(target.getParent())
            fs.delete(target, False)
            if not fs.rename(parts[0].getPath(), target):
                raise OSError(f"could not create {target}")
            done.append(target)
    except Exception:
        for target in done:
            fs.delete(target, False)
        raise
    fs.delete(_path(spark, staging), True)
    return [str(t.toString()) for t in done]


def numbered(df: DataFrame, order_by: Sequence[str] = ()) -> DataFrame:
    """All rows with ``_n`` from 0, without gaps, in the stated order or as they come.

    The rows are written; a row's number is its place in its file and the rows of the files
    before.  Sorting is by ranges, so no task holds more than its share.
    """
    rows = keep(df.orderBy(*order_by) if order_by else df, "numbered")
    placed = rows.select("*", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long").alias("_part"),
                         F.col("_metadata.row_index").alias("_at"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy("_part").agg(F.count("*").alias("_rows")).select(
        "_part", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))  # one row per file
    return placed.join(broadcast_if(parts, file_count(rows)), "_part").select(
        *[f"`{c}`" for c in df.columns], (F.col("_before") + F.col("_at")).alias("_n"))


def write_chunks(df: DataFrame, path: str, prefix: str = "processed_data", chunk_rows: int = CHUNK_ROWS,
                 order_by: Sequence[str] = ()) -> list[str]:
    """K1: JSON arrays of ``chunk_rows`` records named ``{prefix}_0000.json``, ``{prefix}_0001.json``, ...

    Numbers have no gaps and only the last file holds fewer records.  Null fields are written.
    Earlier chunks of the same prefix are removed.  No rows, no files.
    """
    if chunk_rows < 1:
        raise ValueError("a chunk has at least one row")
    spark = df.sparkSession
    record = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    rows = numbered(df, order_by).select(F.floor(F.col("_n") / chunk_rows).alias("_file"), "_n", record.alias("_r"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_n", "_r"))), lambda x: x["_r"])  # chunk_rows of them
    texts = keep(rows.groupBy("_file").agg(F.concat(F.lit("[\n  "), F.array_join(lines, ",\n  "), F.lit("\n]")).alias("value")), "chunks")
    count = texts.count()
    names = {i: f"{prefix}_{i:04d}.json" for i in range(count)}
    return _publish(texts, names, path, overwrite=[f"{prefix}_[0-9][0-9][0-9][0-9]*.json"])


def write_score_tree(metrics: DataFrame, root: str) -> list[str]:
    """K2: ``{root}/{model}/{dataset}/statistical_analysis/result_stats.json``, ``overall`` first.

    What ``read_scores(layout="tree")`` reads.  One small file per row of ``metrics``; a name with
    a path separator and a repeated run are refused.
    """
    body = F.to_json(F.struct("overall", "correct_count", "total_count"), {"ignoreNullFields": "false"})
    runs = keep(metrics.select(F.col("model").cast("string").alias("model"), F.col("dataset").cast("string").alias("dataset"),
                               body.alias("value")), "runs")
    places = runs.groupBy("model", "dataset").agg(F.count("*").alias("n"))
    bad = places.where("n > 1 OR model IS NULL OR dataset IS NULL OR model = '' OR dataset = '' OR "
                       "contains(model, '/') OR contains(dataset, '/')").first()
    if bad:
        raise ValueError(f"not one file of its own: {bad['model']!r}, {bad['dataset']!r}")
    order = Window.orderBy("model", "dataset")
    files = runs.withColumn("_file", F.row_number().over(order) - 1)  # one row per file to be named
    texts = keep(files, "score-tree")
    names = {r["_file"]: f"{r['model']}/{r['dataset']}/{RESULT_FILE}" for r in texts.select("_file", "model", "dataset").collect()}
    return _publish(texts.select("_file", "value"), names, root.rstrip("/"))
