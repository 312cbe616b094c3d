"""Exact sampling, caps and unions."""

from __future__ import annotations

import logging
import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sizes import broadcast_if, file_count, scanned_bytes

log = logging.getLogger(__name__)

# How many rows one task may be given to merge in a top-k.
SINGLE_TASK_ROWS = 1_000_000
SPLIT_BYTES = 128 * 1024 * 1024
LANES = 1000


def _merged_rows(df: DataFrame, n: int) -> float:
    """Rows the last task of ``orderBy().limit(n)`` receives: up to ``n`` from every split.

    Splits follow from the bytes the plan reads, so nothing is executed.
    """
    return n * max(1.0, scanned_bytes(df) / SPLIT_BYTES)


def sample_key(key: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


def sample_n(
    df: DataFrame,
    n: int,
    key: Sequence[str],
    seed: int = 42,
    single_task_rows: int = SINGLE_TASK_ROWS,
) -> DataFrame:
    """L1: exactly ``min(n, rows)`` rows without replacement; -1 keeps all.

    Rows are drawn in the order of a seeded hash of their unique ``key``, so the
    sample does not depend on partitioning.  Where a plain top-k would push too many
    rows into its last task, :func:`_sample_below_threshold` draws the same sample.
    """
    if n == -1:
        return df
    if _merged_rows(df, n) <= single_task_rows:
        return df.orderBy(sample_key(key, seed), *key).limit(n)
    return _sample_below_threshold(df, n, key, seed)


def _cut(share: float) -> str:
    """The hash below which this share of all rows is expected."""
    if share >= 1:
        return "g"  # above every hexadecimal digit
    return f"{int(max(share, 0.0) * 2**128):032x}"


def _sample_below_threshold(df: DataFrame, n: int, key: Sequence[str], seed: int) -> DataFrame:
    """The same sample for any ``n`` and any table, without a shuffle of the rows.

    Hashes are uniform, so the n-th smallest is near ``n / rows``.  Counting the rows
    below a cut on either side of it (two scans of the key columns) proves that the
    lower part belongs to the sample and that only the narrow band between the cuts, a
    few times sqrt(n) rows, has to be ordered.
    """
    hashed = df.withColumn("_hash", sample_key(key, seed))
    total = df.count()
    if n >= total:
        log.warning("sample of %d rows asked from %d; all are used", n, total)
        return df
    slack = 6 * math.sqrt(n) + 16
    while True:
        low, high = _cut((n - slack) / total), _cut((n + slack) / total)
        below, within = hashed.agg(
            F.count_if(F.col("_hash") < low), F.count_if(F.col("_hash") < high)
        ).first()
        if below <= n <= within:
            break
        slack *= 4
    band = hashed.filter((F.col("_hash") >= low) & (F.col("_hash") < high))
    edge = band.orderBy("_hash", *key).limit(n - below)
    return hashed.filter(F.col("_hash") < low).unionByName(edge).drop("_hash")


SLOTS = 1 << 16


def sample_each(df: DataFrame, by: str, sizes: Mapping[str, int] | int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """L1 for every value of ``by`` at once: exactly ``min(n, rows)`` rows of each, each with its own n.

    ``sizes`` is one n, or one per value; -1 keeps all, and a value that is not named has none.  Rows
    are drawn in the order of ``sample_key``, as ``sample_n`` draws them.  One scan counts rows by
    the first bits of their hash; that tells for each value the slot in which its n-th
    row lies.  A second scan keeps the rows up to there, and only that slot's rows are ordered.
    """
    slot = F.conv(F.substring("_hash", 1, 4), 16, 10).cast("int")
    hashed = df.withColumn("_hash", sample_key(key, seed)).withColumn("_slot", slot)
    if isinstance(sizes, Mapping):
        named = F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]) if sizes else F.create_map().cast("map<string,int>")
        wanted = F.coalesce(F.try_element_at(named, F.col(by).cast("string")), F.lit(0))
    else:
        wanted = F.lit(sizes)
    counts = hashed.groupBy(by, "_slot").agg(F.count("*").alias("_rows")).withColumn("_wanted", wanted)
    earlier = Window.partitionBy(by).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
    # One row per value and slot, of which only those with the n-th row are kept.
    cuts = (counts.withColumn("_before", before)
            .where((F.col("_before") < F.col("_wanted")) & (F.col("_before") + F.col("_rows") >= F.col("_wanted")))
            .select(F.col(by).alias("_of"), F.col("_slot").alias("_cut"), (F.col("_wanted") - F.col("_before")).alias("_more")))
    drawn = hashed.withColumn("_wanted", wanted).where("_wanted <> 0").join(cuts, F.col(by).eqNullSafe(F.col("_of")), "left")
    drawn = drawn.where("_wanted = -1 OR _cut IS NULL OR _slot <= _cut")  # no cut: fewer rows than wanted
    inside = F.coalesce(F.col("_slot") < F.col("_cut"), F.lit(True)) | (F.col("_wanted") == -1)
    # Only the last slot's rows of each value meet; the others are spread.
    lane = F.when(inside, F.col("_slot")).otherwise(-1)
    place = F.row_number().over(Window.partitionBy(by, lane).orderBy("_hash", *key))
    return drawn.withColumn("_place", place).where(inside | (F.col("_place") <= F.col("_more"))).select(
        *[F.col(f"`{c}`") for c in df.columns])


def take(
    df: DataFrame, n: int, order_by: Sequence[str], single_task_rows: int = SINGLE_TASK_ROWS
) -> DataFrame:
    """The first ``n`` rows in a stated order (-1 keeps all).

    On a table with very many splits their candidates first meet in a number of lanes,
    each of which passes on ``n`` rows.
    """
    if n == -1:
        return df
    if _merged_rows(df, n) > single_task_rows:
        lane = Window.partitionBy("_lane").orderBy(*order_by)
        ranked = df.withColumn("_lane", F.spark_partition_id() % LANES)
        ranked = ranked.withColumn("_rank", F.row_number().over(lane))
        df = ranked.filter(F.col("_rank") <= n).drop("_lane", "_rank")
    return df.orderBy(*order_by).limit(n)


def head_biased_cap(
    df: DataFrame, n: int, file: str = "_source_file", row: str = "_row_index"
) -> DataFrame:
    """L2: the rows held when reading stops a file beyond ``100 * n`` rows in total.

    Files count in name order; every later file still gives its first row.  Only rows
    that are there count, not the blank ones that their numbers skip.  Row numbers are
    counted in steps of ``100 * n + 1``, so no more than two steps of one file, which
    hold at most that many rows each, are ever ordered.
    """
    if n == -1:
        return df
    most = 100 * n + 1
    steps = df.groupBy(file, F.floor(F.col(row) / most).alias("_step")).agg(F.count("*").alias("_rows"), F.min(row).alias("_first"))
    # One row per step of a file: places of files and steps before each.
    earlier = Window.partitionBy(file).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    steps = steps.withColumn("_inside", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    files = steps.groupBy(file).agg(F.sum("_rows").alias("_all"), F.min("_first").alias("_head"))
    preceding = Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    before = files.select(file, "_head", F.coalesce(F.sum("_all").over(preceding), F.lit(0)).alias("_before"))
    wanted = (steps.join(broadcast_if(before, file_count(df)), file)
              .filter((F.col("_before") + F.col("_inside") <= 100 * n) | (F.col("_first") == F.col("_head")))
              .select(F.col(file).alias("_of"), "_step", "_before", "_inside"))
    # At most two steps in all hold the first rows, and one more for each later file.
    near = df.join(wanted, (F.col(file) == F.col("_of")) & (F.floor(F.col(row) / most) == F.col("_step")))
    place = F.row_number().over(Window.partitionBy("_of", "_step").orderBy(row)) - 1 + F.col("_inside")
    return (near.withColumn("_place", place)
            .filter((F.col("_before") + F.col("_place") <= 100 * n) | (F.col("_place") == 0))
            .select(*df.columns))


def union_samples(frames: Sequence[DataFrame]) -> DataFrame:
    """L4: all loaders' rows; a column one of them lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
