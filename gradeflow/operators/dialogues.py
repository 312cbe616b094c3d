"""Dialogue hashes and duplicate detection."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.canonical import canonical_json
from ..registry import formatters


def with_dialogue_hash(df: DataFrame, dialogues: str = "dialogues", out: str = "hash") -> DataFrame:
    """SHA-256 of the canonical JSON of ``dialogues``; no dialogues hash as ``[]``."""
    text = canonical_json(F.col(dialogues), df.schema[dialogues].dataType)
    return df.withColumn(out, F.sha2(F.coalesce(text, F.lit("[]")), 256))


@formatters.register("empty_format")
def empty_format(df: DataFrame) -> DataFrame:
    """Keep the sample as it is and put its dialogue hash into ``other_info``."""
    hashed = (
        with_dialogue_hash(df)
        if "dialogues" in df.columns
        else df.withColumn("hash", F.sha2(F.lit("[]"), 256))
    )
    return hashed.withColumn("other_info", F.struct("hash")).drop("hash")


def hash_turns(
    turns: DataFrame, key: str, order: str, fields: Sequence[str] = ("role", "content")
) -> DataFrame:
    """F5 for dialogues stored one turn per row: ``key, hash, turn_count``.

    Turns are brought together and sorted by Spark, then fed to the digest one after
    the other.  A task holds one Arrow batch at a time, so a dialogue of any length
    passes through without being collected.
    """
    schema = T.StructType([turns.schema[f] for f in fields])
    piece = canonical_json(F.struct(*fields), schema)
    rows = (
        turns.select(F.col(key), F.col(order), piece.alias("_json"))
        .repartition(key)
        .sortWithinPartitions(key, order, "_json")  # equal positions: by content
        .select(key, "_json")
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, count, kind = None, None, 0, None

        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            keys, hashes, counts = zip(*done)
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, kind), pa.array(hashes, pa.string()), pa.array(counts, pa.int64())],
                [key, "hash", "turn_count"],
            )

        for batch in batches:
            done = []
            kind = batch.column(0).type
            # Python values: a null key equals a null key, and large integers stay exact.
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if state is None or k != current:
                    if state is not None:
                        state.update(b"]")
                        done.append((current, state.hexdigest(), count))
                    current, state, count = k, hashlib.sha256(b"["), 0
                else:
                    state.update(b", ")
                state.update(text.encode("utf-8"))
                count += 1
            if done:
                yield batch_of(done)
        if state is not None:
            state.update(b"]")
            yield batch_of([(current, state.hexdigest(), count)])

    out = T.StructType(
        [turns.schema[key], T.StructField("hash", T.StringType()), T.StructField("turn_count", T.LongType())]
    )
    return rows.mapInArrow(digest, out)


def duplicate_groups(df: DataFrame, key: str, hash_col: str = "hash") -> DataFrame:
    """Per content hash, the smallest key (the kept row) and the number of copies.

    Only hash and key are shuffled, and copies are combined map-side first, so one
    text making up a large part of the table stays cheap.
    """
    return df.groupBy(hash_col).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies"))


def dedup_by_hash(df: DataFrame, key: str, hash_col: str = "hash") -> DataFrame:
    """The row with the smallest key of every group of equal hashes.

    A null key is kept only where its group has no other; a null hash is a group like any.
    """
    kept = duplicate_groups(df, key, hash_col).select(F.col(key).alias("_key"), F.col(hash_col).alias("_hash"))
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col(hash_col).eqNullSafe(F.col("_hash"))
    return df.join(kept, same, "left_semi")
