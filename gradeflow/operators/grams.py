"""N-grams counted by blocks of texts, before they are shuffled (A4).

A hash table of nearly all-different n-grams outgrows a task's memory and is then sorted and
spilled.  A block is small: its words become numbers, its n-grams tuples of numbers, and only
the different ones of a group become strings.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions.text import SEPARATOR
from ..sizes import scanned_bytes

BLOCK = 1 << 20  # words of a block; a longer text is a block of its own
PART_BYTES = 8 << 20  # bytes of input whose n-grams one task unites
UNKNOWN = 1 << 60  # an estimate beyond it says nothing


def _codes(column: pa.Array) -> np.ndarray:
    """Equal values as equal numbers; rows of types that cannot be compared here stay apart."""
    try:
        return column.dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
    except pa.ArrowNotImplementedError:
        return np.arange(len(column))


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One number for each pair of numbers."""
    if not len(left):
        return left
    width = int(right.max()) + 1
    if (int(left.max()) + 1) * width >= 1 << 62:
        left = np.unique(left, return_inverse=True)[1]
    return left * width + right


def _pieces(words: pa.Array, plain: bool) -> pa.Array:
    if plain:
        return words
    return pc.binary_join_element_wise(pc.cast(pc.utf8_length(words), pa.string()), words, ":")


def block_counts(block: pa.RecordBatch, by: Sequence[str], n: int, plain: bool) -> tuple[list[pa.Array], pa.Array, pa.Array]:
    """Group columns, n-gram and how often it stands in the block; a null n-gram for every group."""
    lists = block.column("_tokens")
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten().dictionary_encode(null_encoding="encode")
    codes = words.indices.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    ends = np.cumsum(lengths)
    at = np.arange(len(codes))
    at = at[at + n <= ends[row]]
    if n == 1 and plain:  # a word that is null is no n-gram; in a longer one it is left out
        at = at[~words.indices.take(pa.array(at)).is_null().to_numpy(zero_copy_only=False)] if words.indices.null_count else at
        at = at[words.dictionary.is_valid().to_numpy(zero_copy_only=False)[codes[at]]] if len(at) else at
    group = np.zeros(len(lengths), np.int64)
    for i in range(len(by)):
        group = _pair(group, _codes(block.column(i)))
    key = group[row[at]]
    for k in range(n):
        key = _pair(key, codes[at + k])
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    at = at[first]
    pieces = _pieces(words.dictionary, plain)
    parts = [pieces.take(pa.array(codes[at + k])) for k in range(n)]
    if n == 1:
        grams = parts[0] if plain else pc.fill_null(parts[0], "")
    elif not pieces.null_count:
        grams = pc.binary_join_element_wise(*parts, SEPARATOR)
    else:
        # Arrow leaves out a row without any value: an empty string in front keeps it.
        grams = pc.binary_join_element_wise(pa.array([""] * len(at), pa.string()), *parts, SEPARATOR, null_handling="skip")
        grams = pc.utf8_slice_codeunits(grams, len(SEPARATOR))
    groups = np.unique(group, return_index=True)[1]
    places = pa.array(np.concatenate([row[at], groups]))
    return ([block.column(i).take(places) for i in range(len(by))],
            pa.concat_arrays([grams.cast(pa.string()), pa.nulls(len(groups), pa.string())]),
            pa.array(np.concatenate([counts, np.zeros(len(groups), np.int64)]).astype(np.int64)))


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("_tokens")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        done = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + BLOCK, "right")))
        yield batch.slice(start, end - start)
        start = end


def gram_counts(tokens: DataFrame, n: int, by: Sequence[str], plain: bool) -> DataFrame:
    """``by``, ``_gram`` and ``_n`` of a frame of ``by`` and ``_tokens``: counts of blocks, to be added up.

    The strings are those of :func:`functions.text.ngram_keys`.  Every group also has a row with a
    null n-gram and no count, so that none is lost.
    """
    by = list(by)
    kinds = tokens.select(*by).schema
    schema = kinds.add("_gram", "string").add("_n", "long")
    names = [*by, "_gram", "_n"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _blocks(batch):
                groups, grams, counts = block_counts(block, by, n, plain)
                yield pa.RecordBatch.from_arrays([*groups, grams, counts], names)

    return tokens.select(*by, "_tokens").mapInArrow(run, schema)


def spread_grams(counts: DataFrame, source: DataFrame) -> DataFrame:
    """Deal n-grams to enough tasks for their tables to stay in memory."""
    read = scanned_bytes(source)
    usual = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = read // PART_BYTES if read < UNKNOWN else 0
    return counts.repartition(int(parts), "_gram") if parts > usual else counts.repartition("_gram")
