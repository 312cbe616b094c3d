"""Size checks that execute nothing: file listings and the optimizer's estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Up to this many rows, one per file or per split, a broadcast stays in the low hundreds
# of megabytes.
BROADCAST_ROWS = 1_000_000


def scanned_bytes(df: DataFrame) -> int:
    """Bytes of everything a frame reads; very large where Spark knows nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(leaves.apply(i).stats().sizeInBytes() for i in range(leaves.size()))


def file_count(df: DataFrame) -> int:
    """How many files a frame reads, from Spark's own listing."""
    return len(df._jdf.inputFiles())


def unsplit_bytes(spark: SparkSession) -> int:
    """Files of up to this size are never split by a scan, whatever else it reads."""
    as_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    return min(as_bytes(spark.conf.get(f"spark.sql.files.{c}")) for c in ("maxPartitionBytes", "openCostInBytes"))


def split_bound(df: DataFrame) -> int:
    """An upper bound on the splits of a file scan, by the rule Spark splits files with."""
    conf, java = df.sparkSession.conf, df.sparkSession.sparkContext._jvm
    as_bytes = java.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    most = as_bytes(conf.get("spark.sql.files.maxPartitionBytes"))
    opening = as_bytes(conf.get("spark.sql.files.openCostInBytes"))
    files = file_count(df)
    size = scanned_bytes(df)
    per_core = (size + files * opening) // df.sparkSession.sparkContext.defaultParallelism
    return files + size // max(1, min(most, max(opening, per_core)))


def broadcast_if(small: DataFrame, rows: int) -> DataFrame:
    """Broadcast a frame of at most ``rows`` rows if that is few; else leave it to a shuffle."""
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Give every core a share of a table stored in fewer splits than there are cores.

    A table with enough splits comes back unchanged, so large data is not shuffled.
    Meant for scans: a frame with shuffles of its own would be executed to find out.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *key) if df.rdd.getNumPartitions() < cores else df
