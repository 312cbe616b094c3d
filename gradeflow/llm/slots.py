"""A fixed-size table of hash slots: which of them more than one occurrence falls into."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

SLOT_BITS = 28          # slots of the table, as a power of two: 32 MB as bits, at any input size
LOW_BITS = 16           # slots of one row of the merge
HELD = 4 << 20          # slots that a task gathers before it passes them on


def _slot(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - SLOT_BITS)


def _rows(slots: np.ndarray, often: np.ndarray) -> pa.RecordBatch:
    block = (slots >> np.uint64(LOW_BITS)).astype(np.int64)
    low = slots.astype(np.uint16)
    first = np.flatnonzero(np.diff(block, prepend=-1))
    parts = list(zip(first.tolist(), [*first[1:].tolist(), len(slots)]))
    return pa.RecordBatch.from_arrays(
        [pa.array(block[first].astype(np.int32)), pa.array([low[s:e].tobytes() for s, e in parts], pa.binary()),
         pa.array([low[s:e][often[s:e]].tobytes() for s, e in parts], pa.binary())], ["block", "seen", "often"])


def gathered(hashes: Iterable[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """In a task: the slots of all hashes, each once, and those that came more than once."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def combined() -> tuple[np.ndarray, np.ndarray]:
        slots = np.concatenate([s for s, _ in held])
        often = np.concatenate([o for _, o in held])
        slots, place, counts = np.unique(slots, return_inverse=True, return_counts=True)
        more = counts > 1
        more[place[often]] = True
        return slots, more

    size = 0
    for some in hashes:
        slots, counts = np.unique(_slot(some), return_counts=True)
        held.append((slots, counts > 1))
        size += len(slots)
        if size > HELD:
            yield _rows(*combined())
            held, size = [], 0
    if size:
        yield _rows(*combined())


GATHERED = "block int, seen binary, often binary"


def packed_slots(parts: DataFrame) -> dict[int, bytes]:
    """The table as packed bits of each block, from the rows of :func:`gathered` of all tasks.

    A hash that stands more than once always finds its bit set; one that stands once finds it
    set as often as slots are shared. The table has 2 ** SLOT_BITS bits whatever the input, and
    a row of the merge is 2 ** LOW_BITS slots, so neither a task nor the driver holds more for
    more input; a frequent hash comes once from each task. Blocks are packed where they are merged,
    and the driver passes them on as they are: a sparse table is small there.
    """
    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, counts = None, np.zeros(1 << LOW_BITS, np.uint8)

        def bits() -> pa.RecordBatch:
            packed = [zlib.compress(np.packbits(counts > 1), 1)] if counts.max() > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([at] * len(packed), pa.int32()), pa.array(packed, pa.binary())], ["block", "bits"])

        for batch in batches:
            for block, seen, often in zip(*(batch.column(c).to_pylist() for c in ("block", "seen", "often"))):
                if block != at:
                    if at is not None:
                        yield bits()
                    at = block
                    counts[:] = 0
                low = np.frombuffer(seen, np.uint16)
                counts[low] = np.minimum(counts[low] + 1, 2)
                counts[np.frombuffer(often, np.uint16)] = 2
        if at is not None:
            yield bits()

    found = parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block int, bits binary").toArrow()
    return dict(zip(found.column("block").to_pylist(), found.column("bits").to_pylist()))


def _unpacked(packed: dict[int, bytes]) -> np.ndarray:
    table = np.zeros((1 << (SLOT_BITS - LOW_BITS), 1 << (LOW_BITS - 3)), np.uint8)
    for block, bits in packed.items():
        table[block] = np.frombuffer(zlib.decompress(bits), np.uint8)
    return table.reshape(-1)


def repeated_slots(parts: DataFrame) -> np.ndarray:
    """The table as bits."""
    return _unpacked(packed_slots(parts))


def shared_table(df: DataFrame, packed: dict[int, bytes]) -> Broadcast:
    """The table of :func:`packed_slots` for all tasks."""
    return df.sparkSession.sparkContext.broadcast(packed)


def table_of(shared: Broadcast) -> np.ndarray:
    return _unpacked(shared.value)


def may_repeat(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slots = _slot(hashes)
    return (table[slots >> np.uint64(3)] >> (np.uint64(7) - (slots & np.uint64(7))).astype(np.uint8)) & 1 > 0
