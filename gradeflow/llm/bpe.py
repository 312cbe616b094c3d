"""Byte-level BPE by merge replay over the distinct words of a block of texts."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import plain, small_blocks

CACHED_WORDS = 200_000
_vocabularies: dict[str, "Vocabulary"] = {}


def read_ranks(path: str) -> bytes:
    """A rank file (base64 token, rank). It is read by the driver and sent with the job."""
    with open(path, "rb") as f:
        return f.read()


class Vocabulary:
    def __init__(self, lines: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x.strip())}
        self.token = {i: t for t, i in self.ranks.items()}
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    self.pairs[a, b] = rank
        self.known: dict[str, tuple[int, ...]] = {}

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def replay(words: list[bytes], vocabulary: Vocabulary) -> list[tuple[int, ...]]:
    """Token ids of each word.

    All words lie behind one another; an index gives for each merge the positions where its
    pair stands. Merges are applied in rank order, in a merge from left to right, and only the
    neighbours of a merged pair are looked up again. A merge that makes a pair of a lower rank
    is interrupted for it, so every word sees its merges in the order it would see alone.
    """
    single, pairs = vocabulary.single, vocabulary.pairs
    ids: list[int] = []
    starts = [0]
    for word in words:
        ids += [single[b] for b in word]
        ids.append(-1)  # no pair holds it
        starts.append(len(ids))
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    index: dict[int, list[int]] = defaultdict(list)
    for i in range(n - 1):
        rank = pairs.get((ids[i], ids[i + 1]))
        if rank is not None:
            index[rank].append(i)
    order = list(index)
    heapq.heapify(order)
    while order:
        rank = heapq.heappop(order)
        places = sorted(index.pop(rank, ()))
        for done, i in enumerate(places):
            left = ids[i]
            if left < 0 or (j := after[i]) >= n or pairs.get((left, ids[j])) != rank:
                continue
            ids[i], ids[j] = rank, -2
            k = after[i] = after[j]
            lower = False
            if k < n:
                before[k] = i
                if (r := pairs.get((rank, ids[k]))) is not None:
                    if r not in index:
                        heapq.heappush(order, r)
                    index[r].append(i)
                    lower |= r < rank
            if (h := before[i]) >= 0 and (r := pairs.get((ids[h], rank))) is not None:
                if r not in index:
                    heapq.heappush(order, r)
                index[r].append(h)
                lower |= r < rank
            if lower:
                if rank not in index:
                    heapq.heappush(order, rank)
                index[rank] += places[done + 1:]
                break
    return [tuple(x for x in ids[a:b - 1] if x >= 0) for a, b in zip(starts, starts[1:])]


def encode_block(texts: list[str], finder, vocabulary: Vocabulary) -> Iterator[list[int]]:
    """Ids of each text; words not met before go through the replay together."""
    known = vocabulary.known
    pieces = [finder(t) for t in texts]
    fresh = list({w for words in pieces for w in words if w not in known})
    ids = dict(zip(fresh, replay([w.encode() for w in fresh], vocabulary)))
    if len(known) + len(ids) <= CACHED_WORDS:  # the cache only saves time
        known.update(ids)
    for words in pieces:
        out: list[int] = []
        for w in words:
            out.extend(ids[w] if w in ids else known[w])
        yield out


def encode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if ``ids``, ``ids`` and ``decoded`` (binary).

    One row per row of ``docs``, repeated rows and null ids included; null text is empty text and
    has no token. Nothing is shuffled. ``ranks`` is the content of a rank file, ``pattern`` the
    expression that cuts words. Words of any length are handled.
    """
    key = hashlib.sha256(ranks).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # the rank file: its size is fixed

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        finder = regex.compile(pattern).findall
        if key not in _vocabularies:
            _vocabularies[key] = Vocabulary(shared.value)
        vocabulary = _vocabularies[key]
        for block in small_blocks(batches):
            texts = [t or "" for t in block.column("text").to_pylist()]
            rows = []
            for found in encode_block(texts, finder, vocabulary):
                decoded = vocabulary.decode(found)
                rows.append((len(found), hashlib.sha256(",".join(map(str, found)).encode()).hexdigest(),
                             hashlib.sha256(decoded).hexdigest(), *((found, decoded) if ids else ())))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types)]], names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + (["ids", "decoded"] if ids else [])
    types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.binary()]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return plain(docs, id_col, text_col).mapInArrow(run, schema + (", ids array<int>, decoded binary" if ids else ""))
