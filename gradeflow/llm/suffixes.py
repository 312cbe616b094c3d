"""Repeated byte strings: suffix arrays, built by linear grouping, over what documents may share."""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import (BLOCK_BYTES, as_long, byte_table, flat_bytes, mix, plain, remove_scratch, scratch_count, scratch_since, small_blocks,
                     window_hashes, written)

LENGTH = 50        # bytes of a string that is removed when it repeats
GRAM = 24          # bytes of the anchors that choose what is sorted together
BIN_BYTES = 64 << 10
CROWDED = 2_000    # distinct slices of a key above which they are cut and dealt by finer keys
HEAVY = 32         # bins that the distinct slices of a key may fill before they are dealt so
MANY = 8           # anchors of a cell that may be crowded
BLOCK = 8 << 20    # bytes of text that ask together which of their values others have
ASKED = 8 << 20    # bytes of text for each task that answers
RUN = 64 << 10     # bytes of text whose runs are found at a time: the arrays stay in a core's cache
CELL = 1024        # bytes of the text where values were first met that are dealt together


def suffix_array(text: list[int]) -> list[int]:
    """Suffixes in order, in time linear in the text, without recursion or renaming.

    First the suffixes are grouped by their Lyndon prefixes: groups start as equal first symbols
    and are processed from the highest to the lowest. The nearest earlier suffix of a smaller
    group (its previous-smaller pointer) has its prefix extended by the group, and so moves to a
    new group right above its old one; extended more often, it moves higher. Then, from the
    smallest suffix on, each suffix settles those whose Lyndon prefix ends where it begins: they
    take the next free places of their groups.
    """
    n = len(text)
    if not n:
        return []
    symbols = np.asarray(text)
    by = np.argsort(symbols, kind="stable")
    first = np.flatnonzero(np.diff(symbols[by], prepend=symbols[by[0]] - 1))
    after = np.append(first[1:], n)
    places, groups, ends = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n + 1, np.int64)
    places[by] = np.arange(n)
    groups[by] = np.repeat(first, after - first)
    ends[first] = after
    order, place, start, end = by.tolist(), places.tolist(), groups.tolist(), ends.tolist()
    before = list(range(-1, n - 1))
    top = n
    while top:
        group = start[order[top - 1]]
        if top - group == 1:  # most groups end as one suffix
            i = order[group]
            p = i - 1
            while p >= 0 and start[p] >= group:
                p = before[p]
            before[i] = p
            if p >= 0:
                b = end[start[p]] - 1
                end[start[p]] = b
                a = place[p]
                if a != b:
                    other = order[b]
                    order[a], order[b] = other, p
                    place[other], place[p] = a, b
                start[p] = b
                end[b] = b + 1
            top = group
            continue
        counts: dict[int, int] = {}
        for i in sorted(order[group:top]):
            p = i - 1
            while p >= 0 and start[p] >= group:
                p = before[p]
            before[i] = p
            if p >= 0:
                counts[p] = counts.get(p, 0) + 1
        levels: dict[int, list[int]] = {}
        for p, count in counts.items():
            levels.setdefault(count, []).append(p)
        for count in sorted(levels, reverse=True):
            touched: dict[int, int] = {}
            for p in levels[count]:
                old = start[p]
                b = end[old]
                touched.setdefault(old, b)
                b -= 1
                end[old] = b
                a = place[p]
                if a != b:
                    other = order[b]
                    order[a], order[b] = other, p
                    place[other], place[p] = a, b
            for p in levels[count]:
                start[p] = end[start[p]]
            for old, was in touched.items():
                end[end[old]] = was
        top = group
    # The Lyndon prefix of a suffix ends at the next suffix of a group that is not higher; of the
    # same group, that counts if both have the same previous-smaller pointer.
    settle: dict[int, list[int]] = {}
    stack: list[int] = []
    for i in range(n):
        low, own = start[i], []
        while stack and (low < start[stack[-1]] or low == start[stack[-1]] and before[i] == before[stack[-1]]):
            own.append(stack.pop())
        if own:
            settle[i] = own
        stack.append(i)
    settle[n] = stack
    out = [0] * n
    free = list(range(n))
    queue_at = -1
    current = n
    while True:
        for j in settle.get(current, ()):
            out[free[start[j]]] = j
            free[start[j]] += 1
        queue_at += 1
        if queue_at == n:
            return out
        current = out[queue_at]


def _least(grams: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values."""
    strings, least, have = len(grams) - width + 1, grams, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[:strings], least[width - have:width - have + strings])
    return least


def runs_of(buf: np.ndarray, offsets: np.ndarray, length: int, gram: int, part: int | None = None):
    """Runs of neighbouring strings whose least gram has the same value.

    Returns the value, the text, the first string's place in the text, and the number of strings.
    Equal strings have equal least grams, so they are found in runs of equal values. With ``part``
    the value is that of all bytes which strings share whose first least gram stands at the same
    place or at one of the same ``part`` neighbouring places: whole strings for one place.
    """
    strings = len(buf) - length + 1
    none = np.zeros(0, np.int64)
    if strings < 1:
        return none.astype(np.uint64), none, none, none
    values, width = byte_table("random")[buf], length - gram + 1
    grams = mix(window_hashes(values, gram))
    least = _least(grams, width)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:strings]
    inside = np.arange(strings) + length <= offsets[text + 1]
    begins = np.ones(strings, bool)
    begins[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1]
    if part and part < width:
        ahead = np.zeros(strings, np.int64)  # bytes before the gram
        for at in range(width - 1, -1, -1):
            ahead[grams[at:at + strings] == least] = at
        kind, place = ahead // part, np.arange(strings) + ahead
        begins[1:] |= (kind[1:] != kind[:-1]) | (place[1:] != place[:-1])
    first = np.flatnonzero(begins & inside)
    stops = np.flatnonzero(begins | ~inside)
    following = np.searchsorted(stops, first, "right")
    last = np.where(following < len(stops), stops[np.minimum(following, len(stops) - 1)], strings)
    value = least[first]
    if part and part < width:
        kind, place = kind[first], place[first]
        for k in np.unique(kind).tolist():
            before, most = k * part, min(width, (k + 1) * part) - 1
            own = kind == k
            value[own] = mix(window_hashes(values, length + before - most)[place[own] - before] ^ mix(np.uint64([k + 1])))
    return value, text[first], first - offsets[text[first]], last - first


def lowest(slices: list[tuple[bytes, int]], length: int) -> list[np.ndarray]:
    """For each string of each slice the smallest document among equal strings of all slices."""
    raw = np.frombuffer(b"".join(piece + b"\0" for piece, _ in slices), np.uint8)
    sizes = np.array([len(piece) + 1 for piece, _ in slices])
    ends = np.cumsum(sizes)
    text = raw.astype(np.int64) + 1
    text[ends - 1] = 0
    order = np.array(suffix_array(text.tolist()), np.int64)
    order = order[order + length < np.repeat(ends, sizes)[order]]  # else no whole string begins here
    new = np.ones(len(order), bool)
    strings = np.lib.stride_tricks.sliding_window_view(raw, length)
    for at in range(1, len(order), 1 << 16):
        here = strings[order[at - 1:at + (1 << 16)]]
        new[at:at + (1 << 16)] = (here[1:] != here[:-1]).any(1)
    out = np.zeros(len(raw), np.int64)
    if len(order):
        first = np.flatnonzero(new)
        low = np.minimum.reduceat(np.repeat([low for _, low in slices], sizes)[order], first)
        out[order] = np.repeat(low, np.diff(np.append(first, len(order))))
    return [out[end - size:end - length] for end, size in zip(ends.tolist(), sizes.tolist())]


def _packed(values: np.ndarray) -> bytes:
    """Numbers byte by byte, the first bytes of all together: those of small ones are compressed away."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(packed: bytes, kind: type, count: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(packed, count * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, count).T).view(kind).reshape(-1)


TEXTS = "block long, ids array<long>, sizes array<long>, size long, raw binary"


def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In a task: ids and texts in blocks of about ``BLOCK`` bytes, compressed."""
    task, made = TaskContext.get().partitionId(), 0
    ids, sizes, raw = [], [], []

    def block() -> pa.RecordBatch:
        every = b"".join(raw)
        return pa.RecordBatch.from_arrays(
            [pa.array([(task << 32) + made], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64())),
             pa.array([len(every)], pa.int64()), pa.array([pa.compress(every, codec="zstd", asbytes=True)], pa.binary())],
            ["block", "ids", "sizes", "size", "raw"])

    held = 0
    for part in small_blocks(batches):
        buf, offsets = flat_bytes(part.column("text"))
        ids += part.column("doc_id").to_pylist()
        sizes += np.diff(offsets).tolist()
        raw.append(buf.tobytes())
        held += len(buf)
        if held >= BLOCK or len(ids) >= BLOCK >> 6:
            yield block()
            made += 1
            ids, sizes, raw, held = [], [], [], 0
    if ids:
        yield block()


def texts_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a block, and where its texts begin."""
    raw = pa.decompress(row["raw"], row["size"], codec="zstd", asbytes=True) if row["size"] else b""
    return np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum(row["sizes"], dtype=np.int64)]).astype(np.int64)


class Values:
    """The runs of a block and their different values, in the order in which tasks are asked for them."""

    def __init__(self, row: dict, askers: int, length: int, gram: int):
        self.buf, self.offsets = texts_of(row)
        ids = np.array([0 if i is None else i for i in row["ids"]], np.int64)
        named = np.array([i is not None for i in row["ids"]], bool)
        found, start, texts = [], 0, len(ids)
        while start < texts:
            stop = min(texts, max(start + 1, int(np.searchsorted(self.offsets, self.offsets[start] + RUN, "right")) - 1))
            low, high = self.offsets[start], self.offsets[stop]
            value, text, at, n = runs_of(self.buf[low:high], self.offsets[start:stop + 1] - low, length, gram)
            own = named[text + start]
            found.append((value[own], text[own] + start, at[own], n[own]))
            start = stop
        value, self.text, self.at, self.n = (np.concatenate(x) for x in zip(*found))
        value = mix(value ^ np.uint64(0xD6E8FEB86659FD93))  # least values are small; these are spread
        value = (((value >> np.uint64(32)) * np.uint64(askers)) & ~np.uint64(0xFFFFFFFF)) | (value & np.uint64(0xFFFFFFFF))
        order = np.argsort(value, kind="stable")
        begins = np.ones(len(value), bool)
        begins[1:] = value[order[1:]] != value[order[:-1]]
        first = np.flatnonzero(begins)
        self.value, self.kind = value[order[first]], np.zeros(len(value), np.int64)
        self.kind[order] = np.cumsum(begins) - 1
        doc = ids[self.text[order]]
        self.several = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first) if len(first) else np.zeros(0, bool)
        # A cell is told by 16 bits: more texts than these number are dealt together now and then.
        self.cell = ((self.offsets[self.text] + self.at) // CELL)[order[first]].astype(np.uint16)


ASK = "block long, asked int, n long, value binary, cell binary, several binary"
ANSWER = "block long, asked int, n long, shared binary, label binary"


def asking(askers: int, length: int, gram: int):
    """For each block and part of the values: the different ones, where the block has them first, and which of them several documents have."""
    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            own = Values(row, askers, length, gram)
            cuts = np.searchsorted(own.value, np.arange(askers + 1, dtype=np.uint64) << np.uint64(32))
            cuts[-1] = len(own.value)
            columns = [[] for _ in range(6)]
            for asked in np.flatnonzero(np.diff(cuts)).tolist():
                a, b = int(cuts[asked]), int(cuts[asked + 1])
                steps = np.diff(own.value[a:b].astype(np.uint32), prepend=np.uint32(0))
                for column, x in zip(columns, (row["block"], asked, b - a, _packed(steps), _packed(own.cell[a:b]),
                                               np.packbits(own.several[a:b]).tobytes())):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (
                pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
                ["block", "asked", "n", "value", "cell", "several"])

    return ask


def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each value that several documents have, a label: the first block that has it, and where that has it first.

    Values that follow each other in a text come with one label if they do so where they were first met.
    """
    def answered(rows: list[dict]) -> pa.RecordBatch:
        counts = [row["n"] for row in rows]
        value = np.concatenate([np.cumsum(_unpacked(row["value"], np.uint32, row["n"]), dtype=np.uint32) for row in rows])
        cell = np.concatenate([_unpacked(row["cell"], np.uint16, row["n"]) for row in rows])
        several = np.concatenate([np.unpackbits(np.frombuffer(row["several"], np.uint8), count=row["n"]) for row in rows]) > 0
        order = np.argsort(value, kind="stable")  # rows come by block, so the first of equal ones is of the first block
        begins = np.ones(len(value), bool)
        begins[1:] = value[order[1:]] != value[order[:-1]]
        first = np.flatnonzero(begins)
        many = np.diff(np.append(first, len(value)))
        met = np.repeat(order[first], many)
        block = np.repeat(np.array([row["block"] for row in rows], np.int64), counts)[met].view(np.uint64)
        label = np.empty(len(value), np.uint32)
        label[order] = mix(mix(block) ^ cell[met]) >> np.uint64(32)
        shared = np.empty(len(value), bool)
        shared[order] = np.repeat((many > 1) | np.logical_or.reduceat(several[order], first), many)
        ends = np.cumsum(counts)
        return pa.RecordBatch.from_arrays(
            [pa.array([row["block"] for row in rows], pa.int64()), pa.array([row["asked"] for row in rows], pa.int32()), pa.array(counts, pa.int64()),
             pa.array([np.packbits(shared[e - n:e]).tobytes() for e, n in zip(ends, counts)], pa.binary()),
             pa.array([label[e - n:e][shared[e - n:e]].tobytes() for e, n in zip(ends, counts)], pa.binary())],
            ["block", "asked", "n", "shared", "label"])

    for rows in groups_of(batches, "asked"):
        yield answered(list(rows))


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield {c: batch.column(c)[row].as_py() for c in batch.schema.names}


def groups_of(batches: Iterable[pa.RecordBatch], name: str) -> Iterator[Iterator[dict]]:
    for _, rows in itertools.groupby(rows_of(batches), key=lambda row: row[name]):
        yield rows


SLICES = "h long, block long, row int, doc_id long, at int, slice binary"


def slicing(askers: int, length: int, gram: int):
    """From the answers to a block, followed by the block: what it may share, cut where labels change."""
    def cut_slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups_of(batches, "block"):
            shared, labels, n = [], [], 0
            for row in rows:
                if row["raw"] is None:
                    shared.append(np.unpackbits(np.frombuffer(row["shared"], np.uint8), count=row["n"]))
                    labels.append(np.frombuffer(row["label"], np.uint32))
                    n += row["n"]
                    continue
                own = Values(row, askers, length, gram)
                if n != len(own.value):
                    raise RuntimeError(f"block {row['block']}: {n} answers to {len(own.value)} values")
                if not n:
                    continue
                label = np.full(n, -1, np.int64)
                label[np.concatenate(shared) > 0] = np.concatenate(labels)
                label = label[own.kind]
                begins = np.ones(len(label), bool)
                begins[1:] = (label[1:] != label[:-1]) | (own.text[1:] != own.text[:-1]) | (own.at[1:] != own.at[:-1] + own.n[:-1])
                first = np.flatnonzero(begins)
                strings = np.add.reduceat(own.n, first)
                first, strings = first[label[first] >= 0], strings[label[first] >= 0]
                text, at = own.text[first], own.at[first]
                start = own.offsets[text] + at
                raw = own.buf.tobytes()
                ids = pa.array(row["ids"], pa.int64())
                for some in np.array_split(np.arange(len(first)), 1 + len(first) // 5_000):
                    yield pa.RecordBatch.from_arrays(
                        [as_long(mix(label[first[some]].view(np.uint64) + np.uint64(1))), pa.array(np.full(len(some), row["block"])),
                         pa.array(text[some].astype(np.int32)), ids.take(pa.array(text[some])), pa.array(at[some].astype(np.int32)),
                         pa.array([raw[s:s + m + length - 1] for s, m in zip(start[some].tolist(), strings[some].tolist())], pa.binary())],
                        ["h", "block", "row", "doc_id", "at", "slice"])

    return cut_slices


def finer(part: int, length: int, gram: int):
    """Slices cut into runs with keys of their own, by :func:`runs_of`."""
    def cut_slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in small_blocks(batches, "slice", BLOCK_BYTES >> 2):
            buf, offsets = flat_bytes(block.column("slice"))
            value, row, at, n = runs_of(buf, offsets, length, gram, part)
            raw, start = buf.tobytes(), offsets[row] + at
            for some in np.array_split(np.arange(len(row)), 1 + len(row) // 50_000):
                taken = block.take(pa.array(row[some]))
                yield pa.RecordBatch.from_arrays(
                    [as_long(value[some]), taken.column("block"), taken.column("row"), taken.column("doc_id"),
                     pa.array((taken.column("at").to_numpy() + at[some]).astype(np.int32)),
                     pa.array([raw[s:s + m + length - 1] for s, m in zip(start[some].tolist(), n[some].tolist())], pa.binary())],
                    ["h", "block", "row", "doc_id", "at", "slice"])

    return cut_slices


def _elsewhere(value: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which values come in several of the numbered owners."""
    order = np.argsort(value, kind="stable")
    begins = np.ones(len(value), bool)
    begins[1:] = value[order[1:]] != value[order[:-1]]
    first = np.flatnonzero(begins)
    out = np.zeros(len(value), bool)
    if len(first):
        several = np.minimum.reduceat(own[order], first) < np.maximum.reduceat(own[order], first)
        out[order] = np.repeat(several, np.diff(np.append(first, len(value))))
    return out


KNOWN = "h long, slice binary, ends array<int>, lows array<long>"


def _settle(pieces: dict[tuple[int, bytes], list], lows: np.ndarray, length: int, gram: int, bin_bytes: int, part: int) -> None:
    """Suffix-sort pieces by key: from the smallest document of each and its places to that of each of its strings.

    A key whose pieces fill a bin has them cut first, as by :func:`finer`. A suffix array is of whole keys and
    of about a sixteenth of a bin, as its lists then stay in a core's cache.
    """
    def settle(some: list) -> None:
        for (_, (_, spans)), low in zip(some, lowest([(piece, low) for (_, piece), (low, _) in some], length)):
            for s, e in spans:
                lows[s:e] = low

    some, size = [], 0
    for _, own in itertools.groupby(sorted(pieces.items(), key=lambda found: found[0]), key=lambda found: found[0][0]):
        own = list(own)
        own_size = sum(len(piece) for (_, piece), _ in own)
        if own_size > bin_bytes and part > 1:
            finer_part = (part + 2) // 3
            buf, offsets = flat_bytes(pa.array([piece for (_, piece), _ in own], pa.binary()))
            raw = buf.tobytes()
            value, row, at, n = runs_of(buf, offsets, length, gram, finer_part)
            cut: dict[tuple[int, bytes], list] = {}
            for h, k, a, m, start in zip(value.tolist(), row.tolist(), at.tolist(), n.tolist(), (offsets[row] + at).tolist()):
                low, spans = own[k][1]
                found = cut.setdefault((h, raw[start:start + m + length - 1]), [low, []])
                found[0] = min(found[0], low)
                found[1] += [(s + a, s + a + m) for s, _ in spans]
            _settle(cut, lows, length, gram, bin_bytes, finer_part)
            continue
        if some and size + own_size > bin_bytes >> 4:
            settle(some)
            some, size = [], 0
        some += own
        size += own_size
    if some:
        settle(some)


def _known(held: list[tuple[int, bytes, int]], length: int, gram: int, bin_bytes: int, part: int) -> pa.RecordBatch:
    """For distinct slices and the smallest document of each: the smallest document of each of their strings.

    Strings that stand in one of the slices only have its document. The others make up pieces of the slices;
    equal pieces are one, and those that have a string of another one are suffix-sorted, in bins of whole keys.
    """
    keys = np.array([h for h, _, _ in held], np.int64)
    buf, offsets = flat_bytes(pa.array([piece for _, piece, _ in held], pa.binary()))
    strings = np.diff(offsets) - length + 1
    firsts = np.concatenate([[0], np.cumsum(strings)])
    own = np.repeat(np.arange(len(held)), strings)
    place = np.arange(firsts[-1]) - firsts[own] + offsets[own]
    value = window_hashes(byte_table("random")[buf], length)[place]
    repeats = _elsewhere(value, own)
    edge = repeats.copy()
    edge[1:] &= ~repeats[:-1] | (own[1:] != own[:-1])
    starts = np.flatnonzero(edge)
    edge = repeats.copy()
    edge[:-1] &= ~repeats[1:] | (own[1:] != own[:-1])
    stops = np.flatnonzero(edge) + 1
    lows = np.repeat(np.array([low for *_, low in held], np.int64), strings)
    pieces: dict[tuple[int, bytes], list] = {}
    raw = buf.tobytes()
    for s, e in zip(starts.tolist(), stops.tolist()):
        k, low = int(own[s]), int(lows[s])
        found = pieces.setdefault((int(keys[k]), raw[place[s]:place[s] + e - s + length - 1]), [low, []])
        found[0] = min(found[0], low)
        found[1].append((s, e))

    alone = [spans[0] for _, spans in pieces.values()]
    inside = np.concatenate([np.zeros(0, np.int64), *(np.arange(s, e) for s, e in alone)])
    which = np.repeat(np.arange(len(alone)), [e - s for s, e in alone])
    compared = np.bincount(which[_elsewhere(value[inside], which)], minlength=len(alone)) > 0
    for (low, spans), other in zip(pieces.values(), compared.tolist()):
        for s, e in () if other else spans:
            lows[s:e] = low
    _settle({key: found for (key, found), other in zip(pieces.items(), compared.tolist()) if other}, lows, length, gram, bin_bytes, part)
    changes = np.ones(len(lows), bool)
    changes[1:] = (lows[1:] != lows[:-1]) | (own[1:] != own[:-1])
    at = np.flatnonzero(changes)
    bounds = np.searchsorted(at, firsts).astype(np.int32)
    ends = np.append(at[1:], len(lows)) - firsts[own[at]]
    return pa.RecordBatch.from_arrays(
        [pa.array(keys), pa.array([piece for _, piece, _ in held], pa.binary()),
         pa.ListArray.from_arrays(pa.array(bounds), pa.array(ends.astype(np.int32))),
         pa.ListArray.from_arrays(pa.array(bounds), pa.array(lows[at]))], ["h", "slice", "ends", "lows"])


def sorting(length: int, gram: int, bin_bytes: int, part: int):
    """Distinct slices that come by key: what :func:`_known` finds, for some whole keys at a time."""
    def sort_bins(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, int]] = []
        size = 0
        for batch in batches:
            for h, piece, low in zip(*(batch.column(c).to_pylist() for c in ("h", "slice", "low"))):
                if held and size > 8 * bin_bytes and h != held[-1][0]:
                    yield _known(held, length, gram, bin_bytes, part)
                    held, size = [], 0
                held.append((h, piece, low))
                size += len(piece)
        if held:
            yield _known(held, length, gram, bin_bytes, part)

    return sort_bins


HITS = "block long, n long, row binary, first binary, bytes binary"
SPANS = 1 << 20    # of bytes that go, which a task gathers before it passes them on


def spanning(length: int):
    """Spans of bytes that go, gathered by block."""
    def spans(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            block, row, doc, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "row", "doc_id", "at"))
            ends, lows = batch.column("ends").flatten().to_numpy(), batch.column("lows").flatten().to_numpy()
            many = batch.column("ends").value_lengths().to_numpy(zero_copy_only=False)
            k = np.repeat(np.arange(len(many)), many)
            starts = np.zeros(len(ends), np.int64)
            starts[1:] = ends[:-1]
            starts[(np.cumsum(many) - many)[many > 0]] = 0
            gone = lows < doc[k]
            k, starts, ends = k[gone], starts[gone], ends[gone]
            held.append([block[k], row[k], at[k] + starts, ends - starts + length - 1])
            size += len(k)
            if size > SPANS:
                yield gathered_by_block(held)
                held, size = [], 0
        if size:
            yield gathered_by_block(held)

    return spans


def gathered_by_block(held: list[list[np.ndarray]]) -> pa.RecordBatch:
    block, *columns = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(block, kind="stable")
    block, columns = block[order], [c[order].astype(np.int32) for c in columns]
    first = np.flatnonzero(np.diff(block, prepend=block[0] - 1))
    parts = list(zip(first.tolist(), [*first[1:].tolist(), len(block)]))
    return pa.RecordBatch.from_arrays(
        [pa.array(block[first]), pa.array([e - s for s, e in parts], pa.int64()),
         *(pa.array([_packed(c[s:e]) for s, e in parts], pa.binary()) for c in columns)], ["block", "n", "row", "first", "bytes"])


def _stored(df: DataFrame, name: str) -> DataFrame:
    """As :func:`written`; what was shuffled for it goes at once, as nothing reads it again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    conf = df.sparkSession.conf
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return written(df, name)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def _met(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of each block, followed by the block itself."""
    both = rows.withColumn("whole", F.lit(False)).unionByName(texts.withColumn("whole", F.lit(True)), allowMissingColumns=True)
    return both.repartition("block").sortWithinPartitions("block", "whole", *(["asked"] if "asked" in rows.columns else [])).drop("whole")


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                          gram: int = GRAM, bin_bytes: int = BIN_BYTES, crowded: int = CROWDED,
                          content: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if ``content``, ``kept`` (binary).

    A byte goes if a string of ``length`` bytes covering it also starts in a document with a
    smaller id. Strings are told by the value of their least gram. Blocks of texts ask, with a few
    bytes for each value, which of theirs other documents have; the answer names the place where a
    value was first met. Neighbouring strings whose values were first met together are cut out and
    dealt by that place, so that equal strings always meet and copied text moves in long slices.
    Distinct slices of one place are suffix-sorted together in what they have in common, in bins
    of bounded size; where a place has very many slices, these are cut and dealt by the value of
    the least gram, by more and more of the bytes around it, and at last by whole strings. Null
    text is empty text. Rows that repeat an id are one document as far as comparing goes, and each
    loses the strings that stand in it; a null id removes nothing elsewhere and loses nothing.
    """
    source = plain(docs, id_col, text_col)
    texts = _stored(source.mapInArrow(pack, TEXTS), "texts")
    before = scratch_count()
    askers = 1 + (texts.agg(F.sum("size")).first()[0] or 0) // ASKED
    asked = texts.select("block", "ids", "sizes", "size", "raw").mapInArrow(asking(askers, length, gram), ASK)
    answers = asked.repartition("asked").sortWithinPartitions("asked", "block").mapInArrow(answer, ANSWER)
    slices = _stored(_met(texts, answers).mapInArrow(slicing(askers, length, gram), SLICES), "slices")
    hits, cell = [], 3 * (length - gram + 1)
    part = cell
    while True:
        distinct = _stored(slices.groupBy("h", "slice").agg(F.min("doc_id").alias("low")), "distinct")
        kept = distinct
        if part > 1:
            hot = _stored(distinct.groupBy("h").agg(F.count("*").alias("kinds"), F.sum(F.length("slice")).alias("size"))
                          .where((F.col("kinds") > (MANY * crowded if part == cell else crowded)) | (F.col("size") > HEAVY * bin_bytes)).select("h"), "hot")
            kept = distinct.join(hot, "h", "left_anti")
        known = (kept.repartition("h").sortWithinPartitions("h", "slice").select("h", "slice", "low")
                 .mapInArrow(sorting(length, gram, bin_bytes, part), KNOWN))
        hits.append(_stored(slices.join(known, ["h", "slice"]).where("exists(lows, low -> low < doc_id)")
                            .select("block", "row", "doc_id", "at", "ends", "lows").mapInArrow(spanning(length), HITS), "hits"))
        if part == 1 or hot.isEmpty():
            break
        part = (part + 2) // 3
        slices = _stored(slices.join(hot, "h", "left_semi").mapInArrow(finer(part, length, gram), SLICES), "slices")
    named = [path for _, path in scratch_since(before)]
    remove_scratch([(docs.sparkSession, path) for path in named if not path.rsplit("/", 1)[-1].startswith("hits-")])
    gone = functools.reduce(DataFrame.unionByName, hits)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in groups_of(batches, "block"):
            found = []
            for row in rows:
                if row["raw"] is None:
                    found.append([_unpacked(row[c], np.int32, row["n"]) for c in ("row", "first", "bytes")])
                    continue
                buf, offsets = texts_of(row)
                marks = np.zeros(len(buf) + 1, np.int32)
                for text, first, count in found:
                    np.add.at(marks, offsets[text] + first, 1)
                    np.add.at(marks, offsets[text] + first + count, -1)
                left = np.cumsum(marks[:-1], dtype=np.int32) == 0
                begins = ~left
                begins[1:] &= left[:-1]
                edges = offsets[:-1][np.diff(offsets) > 0]
                begins[edges] = ~left[edges]
                spans = np.concatenate([[0], np.cumsum(begins)])[offsets]
                out, size = [], 0
                for doc, low, high, n in zip(row["ids"], offsets[:-1].tolist(), offsets[1:].tolist(), np.diff(spans).tolist()):
                    kept = (buf[low:high][left[low:high]] if n else buf[low:high]).tobytes()
                    out.append((doc, high - low, high - low - len(kept), n, hashlib.sha256(kept).hexdigest(), kept))
                    size += len(kept)
                    if size > BLOCK_BYTES:
                        yield as_rows(out)
                        out, size = [], 0
                if out:
                    yield as_rows(out)

    def as_rows(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types[:len(names)])], names)

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + (["kept"] if content else [])
    types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if content else "")
    return _met(texts, gone).mapInArrow(cut, schema)
