"""Exact deduplication by most-significant-byte-first radix partitioning of whole texts."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .common import small_blocks, written
from .slots import GATHERED, gathered, may_repeat, packed_slots, shared_table, table_of

# A group below either bound is finished inside one task; a larger one is split by more bytes.
LEAF_ROWS = 50_000
LEAF_BYTES = 32 << 20
FIRST_BYTES = 16
FACTOR = 16


def radix_groups(texts: list[bytes]) -> list[list[int]]:
    """Positions of equal texts, found by splitting on successive bytes.

    A group is split by the next few bytes (8, then twice as many each time) until it is a
    single text or all its texts have ended; no digest decides equality.
    """
    done: list[list[int]] = []
    stack = [(list(range(len(texts))), 0, 8)]
    while stack:
        group, at, width = stack.pop()
        if len(group) == 1:
            done.append(group)
            continue
        parts: dict[bytes, list[int]] = defaultdict(list)
        for i in group:
            parts[texts[i][at:at + width]].append(i)
        for piece, members in parts.items():
            if len(piece) < width:  # these texts have ended, with equal bytes all the way
                done.append(members)
            else:
                stack.append((members, at + width, 2 * width))
    return done


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                leaf_rows: int = LEAF_ROWS, leaf_bytes: int = LEAF_BYTES,
                first_bytes: int = FIRST_BYTES) -> DataFrame:
    """Mark, among texts equal after lower-casing A-Z, the one row to keep.

    Adds to all columns of ``docs`` (a column of the same name is replaced): ``keep_id`` (the id
    of the row that stays: the largest id, a null id being the smallest), ``group_size``,
    ``kept`` and ``text_sha256`` (of the lower-cased text). Null text is empty text. Of rows that
    repeat the same id and text exactly one is kept. An empty table gives an empty result.

    Texts that stand once are mostly told by a table of hash slots of a fixed size, which keeps all
    that repeat, and are neither stored nor shuffled. Each block of the others is first grouped
    where it was read, so a text that fills a third of the
    table is shuffled once a block. Groups too large for a task are split across the cluster by
    more and more leading bytes; texts that have ended while their group is still too large are
    equal and are only aggregated.
    """
    marked = written(_marked(docs, id_col, text_col), "exact")
    reps = marked.where("_radix_text is not null").select("_radix_row", "_radix_order", "_radix_copies", "_radix_text")
    found, heavy, depth = [], None, first_bytes
    active = reps
    while True:
        key = F.substring("_radix_text", 1, depth)
        counted = active.groupBy(key.alias("_radix_key")).agg(
            F.count("*").alias("rows"), F.sum(F.length("_radix_text")).alias("bytes"))
        large = written(counted.where((F.col("rows") > leaf_rows) | (F.col("bytes") > leaf_bytes))
                        .select("_radix_key"), "exact-prefixes")
        keyed = active.withColumn("_radix_key", key)
        if large.isEmpty():
            found.append(_finish(keyed))
            break
        found.append(_finish(keyed.join(large, "_radix_key", "left_anti")))
        rest = keyed.join(large, "_radix_key", "left_semi")
        found.append(_ended(rest.where(F.length("_radix_text") < depth)))
        active = rest.where(F.length("_radix_text") >= depth).drop("_radix_key")
        depth *= FACTOR
    groups = found[0]
    for more in found[1:]:
        groups = groups.unionByName(more)
    ours = ["keep_id", "group_size", "kept", "text_sha256"]
    named = [c for c in docs.columns if c.lower() not in ours]
    own = [F.col(f"_radix_in.`{c}`").alias(c) for c in named]
    sha = F.col("_radix_sha").alias("text_sha256")
    alone = marked.where("_radix_alone").select(
        *own, F.col("_radix_order.id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    out = marked.where("not _radix_alone").drop("_radix_text", "_radix_copies", "_radix_order").join(groups, "_radix_rep")
    return out.select(
        *own, F.col("_radix_keep_id").alias("keep_id"), F.col("_radix_size").alias("group_size"),
        (F.col("_radix_row") == F.col("_radix_keep_row")).alias("kept"), sha).unionByName(alone)


def _lowered(block: pa.RecordBatch) -> list[bytes]:
    return [t.lower() for t in block.column("_radix_source").cast(pa.large_binary()).to_pylist()]


def _hashes(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), np.uint64)


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every row with the row that stands for it in its block; only that one carries the text, if it may stand elsewhere."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("_radix_row"), F.col(id_col).cast("long").alias("_radix_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_radix_source"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_radix_in"))
    schema = StructType.fromDDL("_radix_row long, _radix_order struct<id: long, row: long>, _radix_rep long, "
                                "_radix_copies long, _radix_sha string, _radix_alone boolean, _radix_text binary").add(rows.schema["_radix_in"])

    def text_slots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from gathered(_hashes([hashlib.sha256(t).digest() for t in _lowered(block)])
                            for block in small_blocks(batches, "_radix_source", 8 << 20))

    several = shared_table(docs, packed_slots(rows.select("_radix_source").mapInArrow(text_slots, GATHERED)))

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(several)
        for block in small_blocks(batches, "_radix_source", 8 << 20):
            texts = _lowered(block)
            numbers = block.column("_radix_row").to_pylist()
            ids = block.column("_radix_id").to_pylist()
            n = len(texts)
            rep, copies, sha, kept, alone = [0] * n, [0] * n, [""] * n, [None] * n, [False] * n
            groups = radix_groups(texts)
            digests = [hashlib.sha256(texts[group[0]]).digest() for group in groups]
            for group, digest, more in zip(groups, digests, may_repeat(table, _hashes(digests)).tolist()):
                best = max(group, key=lambda i: (ids[i] is not None, ids[i] or 0, numbers[i]))
                copies[best], kept[best] = len(group), texts[best] if more else None
                for i in group:
                    rep[i], sha[i], alone[i] = numbers[best], digest.hex(), not more
            order = [{"id": a, "row": b} for a, b in zip(ids, numbers)]
            yield pa.RecordBatch.from_arrays(
                [block.column("_radix_row"), pa.array(order, pa.struct([("id", pa.int64()), ("row", pa.int64())])),
                 pa.array(rep, pa.int64()), pa.array(copies, pa.int64()), pa.array(sha, pa.string()),
                 pa.array(alone), pa.array(kept, pa.binary()), block.column("_radix_in")],
                ["_radix_row", "_radix_order", "_radix_rep", "_radix_copies", "_radix_sha", "_radix_alone", "_radix_text", "_radix_in"])

    return rows.mapInArrow(mark, schema)


_GROUPS = "_radix_rep long, _radix_keep_id long, _radix_keep_row long, _radix_size long"


def _finish(keyed: DataFrame) -> DataFrame:
    """Radix grouping inside a task: texts with the same leading bytes meet in one partition."""

    def group(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        prefix = None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in
                             ("_radix_key", "_radix_row", "_radix_order", "_radix_copies", "_radix_text"))):
                if row[0] != prefix and held:
                    yield settle(held)
                    held = []
                prefix = row[0]
                held.append(row[1:])
        if held:
            yield settle(held)

    def settle(held: list[tuple]) -> pa.RecordBatch:
        out: list[tuple] = []
        for members in radix_groups([row[3] for row in held]):
            best = max((held[i][1] for i in members), key=lambda o: (o["id"] is not None, o["id"] or 0, o["row"]))
            size = sum(held[i][2] for i in members)
            out += [(held[i][0], best["id"], best["row"], size) for i in members]
        names = ["_radix_rep", "_radix_keep_id", "_radix_keep_row", "_radix_size"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    return keyed.repartition("_radix_key").sortWithinPartitions("_radix_key").mapInArrow(group, _GROUPS)


def _ended(rest: DataFrame) -> DataFrame:
    """Whole texts shorter than the bytes compared: rows with the same key are equal."""
    best = rest.groupBy("_radix_key").agg(
        F.max("_radix_order").alias("best"), F.sum("_radix_copies").alias("_radix_size"))
    return rest.join(best, "_radix_key").select(
        F.col("_radix_row").alias("_radix_rep"), F.col("best.id").alias("_radix_keep_id"),
        F.col("best.row").alias("_radix_keep_row"), "_radix_size")
