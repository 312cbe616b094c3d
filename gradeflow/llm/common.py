"""What the operators share: scratch tables, bounded blocks of texts, words as hashes, components."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeflow.session import shared_folder

# Texts handled by one round of array work; a longer single text is a block of its own.
BLOCK_BYTES = 2 << 20
ODD = np.uint64(0x9E3779B97F4A7C15)
_scratch: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below the one that all executors share; removed when the driver ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


@atexit.register
def _remove_scratch() -> None:
    remove_scratch(_scratch)


def remove_scratch(folders: list[tuple[SparkSession, str]]) -> None:
    for spark, path in folders:
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended: its owner cleans the shared folder
            return


def scratch_since(count: int) -> list[tuple[SparkSession, str]]:
    """The folders made after the first ``count`` ones."""
    return _scratch[count:]


def scratch_count() -> int:
    return len(_scratch)


def unread(folders: list[tuple[SparkSession, str]], df: DataFrame) -> list[tuple[SparkSession, str]]:
    """Those of the folders that a frame does not read."""
    files = df.inputFiles()
    return [(spark, path) for spark, path in folders if not any(path.rsplit("/", 1)[-1] in f for f in files)]


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: lineage ends here and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only id and text, as ``doc_id`` and ``text``: other columns cannot clash with ours."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def small_blocks(batches: Iterable[pa.RecordBatch], column: str = "text",
                 limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows with about ``limit`` bytes of text each."""
    for batch in batches:
        sizes = lengths_of(batch.column(column))
        start = held = 0
        for row, size in enumerate(sizes.tolist()):
            if held and held + size > limit:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if batch.num_rows > start:
            yield batch.slice(start)


def lengths_of(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of a column as one byte array and the offsets of the rows; null is empty."""
    parts = [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return np.frombuffer(b"".join(parts), np.uint8), offsets


class Memo(dict):
    """Values that a process keeps; it travels empty, and by value like the rest of the package."""

    def __reduce__(self):
        return Memo, ()


_kept = Memo()


def byte_table(kind: str) -> np.ndarray:
    if kind not in _kept:
        _kept[kind] = _byte_table(kind)
    return _kept[kind]


def _byte_table(kind: str) -> np.ndarray:
    if kind == "space":  # 0x20 and 0x09-0x0D
        out = np.zeros(256, bool)
        out[[0x20, *range(9, 14)]] = True
    elif kind == "lower":
        out = np.arange(256, dtype=np.uint8)
        out[65:91] += 32
    elif kind == "nonword":  # all but ASCII letters, digits and what is not ASCII
        out = np.zeros(256, bool)
        out[:128] = [not chr(c).isalnum() for c in range(128)]
    else:  # a fixed random value for each byte
        out = np.random.default_rng(0x5EED).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
    return out


def powers(count: int, base: int) -> np.ndarray:
    if (count, base) not in _kept:
        out = np.full(count, base, np.uint64)
        out[:1] = 1
        _kept[count, base] = np.cumprod(out, dtype=np.uint64)
    return _kept[count, base]


def _power_pair(count: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(10, int(count).bit_length())
    base = int(ODD)
    return powers(size, base), powers(size, pow(base, -1, 2**64))


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def word_bounds(buf: np.ndarray, offsets: np.ndarray, apart: str = "space"):
    """Starts and ends of words, and each text's first place in that list."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~byte_table(apart)[buf]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    edges = offsets[(offsets > 0) & (offsets < len(buf))]
    first[edges] = word[edges]
    last[edges - 1] = word[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit value for each word, from its bytes alone."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _power_pair(len(buf))
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(byte_table("random")[buf] * power[:len(buf)], out=total[1:])
    length = (ends - starts).astype(np.uint64)
    return mix((total[ends] - total[starts]) * inverse[starts] + length * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit value for each run of ``width`` consecutive values."""
    if len(values) < width:
        return np.zeros(0, np.uint64)
    power, inverse = _power_pair(len(values))
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[:len(values)], out=total[1:])
    return mix((total[width:] - total[:-width]) * inverse[:len(values) - width + 1])


def as_long(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components: (node, component), component being the smallest node reachable.

    ``edges`` has long columns ``a`` and ``b``. Large-star and small-star rounds: every node
    sends its neighbours to the smallest one it knows, until nothing changes. Each round is two
    shuffles with minima combined before them, and its edges are written, so a node with very
    many neighbours costs no task more than its share and lost executors cost one round.
    """
    edges = written(edges.where("a != b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (both.join(least.select(F.col("u"), F.least("u", "m").alias("m")), "u")
                 .where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = written(large, name)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))).distinct())
        edges = written(small, name)
        seen = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if before == (seen.n, seen.h):
            break
        before = (seen.n, seen.h)
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)
