"""BPE with word ends: long unsplit text is encoded as a tree of halves, joined where both sides agree."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Memo, plain, small_blocks, written

LEAF = 32              # symbols encoded at once; longer text is halved
WINDOW = 4             # tokens on either side of a join that are encoded anew at first
LONG_CHARS = 1 << 16   # a document with such a run without white space is dealt over tasks
TASK_LEAF = 1 << 14    # symbols of such a run that one task encodes
CACHED_WORDS = 200_000
IDS_IN_BATCH = 1 << 18
BITS = 20              # of a token id
NO_MERGE = 1 << 62
BEYOND = 0x370         # texts of Latin letters alone take a simpler pattern

# Contractions are tokens of their own; then letters, single digits, all else.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
# Letters and numbers of later Unicode versions than the tokenizer library's; to it they
# are neither.
LATER = (
    "\\u0558\\u058B\\u058C\\u088F\\u0C5C\\u0CDC\\u208F\\u209D-\\u209F\\uA7CE\\uA7CF\\uA7D2\\uA7D4\\uA7DD\\uA7E2\\uA7F1"
    "\\uAB6C\\uAB6D\\U000107BB-\\U000107BF\\U00010940-\\U00010959\\U00010EC5-\\U00010EC7\\U00010ED9-\\U00010EEE"
    "\\U00011B0A\\U00011DB0-\\U00011DDB\\U00011DE0-\\U00011DE9\\U00011DF1\\U0001246F\\U00012475-\\U0001247F"
    "\\U00012550-\\U00012686\\U00016EA0-\\U00016EB8\\U00016EBB-\\U00016ED3\\U00016FF2-\\U00016FF6"
    "\\U000187F8-\\U000187FF\\U00018CD6-\\U00018CDA\\U00018D09-\\U00018D20\\U00018D80-\\U00018DF2"
    "\\U00018E00-\\U00019191\\U000191A0-\\U000191D2\\U0001B123-\\U0001B128\\U0001B168\\U0001D6A6"
    "\\U0001DF1F-\\U0001DF24\\U0001DF2B-\\U0001DF81\\U0001DF90-\\U0001DF96\\U0001DFCD-\\U0001DFFF"
    "\\U0001E6C0-\\U0001E6DE\\U0001E6E0-\\U0001E6E2\\U0001E6E4\\U0001E6E5\\U0001E6E7-\\U0001E6ED"
    "\\U0001E6F0-\\U0001E6F4\\U0001E6FE\\U0001E6FF\\U0002B73A-\\U0002B73F\\U0002B81E\\U0002CEA2-\\U0002CEAD"
    "\\U000323B0-\\U00033479\\U0003D000-\\U0003FC3F"
)
# Capitals that Python does not know yet, and a sigma is never final here.
CAPITALS = {0x3A3: 0x3C3, 0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3,
            0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
            **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}}
_vocabularies = Memo()


def read_tokenizer(path: str) -> str:
    """A tokenizer file. It is read by the driver and sent with the job."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(256 + hidden.index(b)) if b in hidden else chr(b) for b in range(256)]


class Vocabulary:
    """Merges, words and special tokens of a tokenizer file (BPE, NFC, lower case, byte level)."""

    def __init__(self, content: str):
        import regex

        spec = json.loads(content)
        model = spec["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"] or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # A pair's two ids as one number, to its rank and the merged id as one number.
        self.merges = {ids[a] << BITS | ids[b]: rank << BITS | ids[a + b] for rank, (a, b) in enumerate(merges)}
        self.parts = {ids[a + b]: (ids[a], ids[b]) for a, b in merges}
        self.token = {i: t for t, i in ids.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        letters = byte_letters()
        self.inner, self.last = [ids[c] for c in letters], [ids[c + end] for c in letters]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        longest = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")").split if longest else lambda t: [t]
        classes = r"{L}+|" + CONTRACTIONS + r"|{N}|[^\s{L}{N}]+"
        self.words = regex.compile(classes.format(L=r"\p{L}", N=r"\p{N}")).findall
        known = {c: f"[\\p{{{c}}}--[{LATER}]]" for c in "LN"}
        self.words_exact = regex.compile("(?V1)" + classes.format(**known)).findall
        low = {c: "".join(chr(k) for k in range(BEYOND) if unicodedata.category(chr(k))[0] == c) for c in "LN"}
        space = "".join(chr(k) for k in range(BEYOND) if regex.match(r"\s", chr(k)))
        self.words_low = re.compile(f"[{low['L']}]+|{CONTRACTIONS}|[{low['N']}]|[^{space}{low['L']}{low['N']}]+").findall
        self.beyond = re.compile(f"[{chr(BEYOND)}-\U0010FFFF]").search
        self.odd = re.compile(f"[{LATER}{''.join(map(chr, CAPITALS))}]").search
        self.ids, self.texts = _Known(self), _Known(self)
        self._symbols: dict[int, tuple[int, ...]] = {}

    def split(self, text: str) -> list[str | int]:
        """Words of the normalised text, and ids where the text holds a special token."""
        if "<" not in text:
            return self._words(text)
        out: list[str | int] = []
        for piece in self.cut(text):
            out += [self.special[piece]] if piece in self.special else self._words(piece)
        return out

    def _words(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        low = text.lower()
        if not self.beyond(low):
            return self.words_low(low)
        if not self.odd(text):
            return self.words(low)
        return self.words_exact(text.translate(CAPITALS).lower())

    def start(self, word: str) -> list[int]:
        """A word as single symbols; the last one carries the word's end."""
        raw = word.encode()
        return [*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]]

    def symbols(self, token: int) -> tuple[int, ...]:
        if token not in self._symbols:
            pair = self.parts.get(token)
            self._symbols[token] = self.symbols(pair[0]) + self.symbols(pair[1]) if pair else (token,)
        return self._symbols[token]

    def greedy(self, ids: list[int]) -> list[int]:
        """Always the pair of the lowest rank, the leftmost first, until none is left."""
        get = self.merges.get
        if len(ids) > 2 * LEAF:
            return self._greedy_long(ids)
        ids = list(ids)
        found = [get(a << BITS | b, NO_MERGE) for a, b in zip(ids, ids[1:])]
        while found and (best := min(found)) != NO_MERGE:
            at = found.index(best)
            new = best & (1 << BITS) - 1
            ids[at:at + 2] = [new]
            del found[at]
            if at:
                found[at - 1] = get(ids[at - 1] << BITS | new, NO_MERGE)
            if at < len(found):
                found[at] = get(new << BITS | ids[at + 1], NO_MERGE)
        return ids

    def _greedy_long(self, ids: list[int]) -> list[int]:
        get, n = self.merges.get, len(ids)
        ids, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[int, int, int]] = []  # merge, place, the pair it is for

        def offer(i: int, j: int) -> None:
            pair = ids[i] << BITS | ids[j]
            if (merge := get(pair)) is not None:
                heapq.heappush(queue, (merge, i, pair))

        for i in range(n - 1):
            offer(i, i + 1)
        while queue:
            merge, i, pair = heapq.heappop(queue)
            j = after[i]
            if ids[i] < 0 or j >= n or ids[i] << BITS | ids[j] != pair:
                continue
            ids[i], ids[j] = merge & (1 << BITS) - 1, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                offer(i, k)
            if before[i] >= 0:
                offer(before[i], i)
        return [x for x in ids if x >= 0]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of two neighbouring texts as tokens of the whole.

        The tokens around the join are encoded anew. Where the outermost token on either side
        comes out as it was, all neighbours are pairs that no merge joins, in the window, in
        what is left of it and in what is right of it, and such a sequence is the one encoding.
        Until then the window doubles.
        """
        reach = WINDOW
        while True:
            a, b = max(0, len(left) - reach), min(len(right), reach)
            window = [s for t in left[a:] + right[:b] for s in self.symbols(t)]
            found = self.greedy(window)
            if (a == 0 or found[0] == left[a]) and (b == len(right) or found[-1] == right[b - 1]):
                return left[:a] + found + right[b:]
            reach *= 2

    def tree(self, symbols: list[int]) -> list[int]:
        if len(symbols) <= LEAF:
            return self.greedy(symbols)
        middle = LEAF
        while 2 * middle < len(symbols):
            middle *= 2
        return self.join(self.tree(symbols[:middle]), self.tree(symbols[middle:]))

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.token.__getitem__, ids))

    def entry(self, word: str | int) -> None:
        """Keep a word's ids as text, and what they decode to."""
        ids = [word] if isinstance(word, int) else self.tree(self.start(word))
        if len(self.ids) >= CACHED_WORDS:  # what is kept only saves time
            self.ids.clear()
            self.texts.clear()
        self.ids[word], self.texts[word] = " ".join(map(str, ids)), self.decode(ids)


class _Known(dict):
    """What is known of words; a word not met before is encoded when it is asked for."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, word: str | int) -> str:
        self.vocabulary.entry(word)
        return self[word]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True,
           long_chars: int = LONG_CHARS, task_leaf: int = TASK_LEAF) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if ``ids``, ``ids`` and ``decoded``.

    ``tokenizer`` is the content of a tokenizer file. One row per row of ``docs``, repeated rows and
    null ids included; null text is empty text and has no token. Text is cut at special tokens, put
    into NFC and lower case, and cut into words; a word of more than ``LEAF`` bytes is encoded as a
    tree of halves. Nothing is shuffled but documents with more than ``long_chars`` characters
    without white space: their leaves of ``task_leaf`` bytes are dealt over tasks and joined level
    by level, each level a written table.
    """
    spark = docs.sparkSession
    key = hashlib.sha256(tokenizer.encode()).hexdigest()
    shared = spark.sparkContext.broadcast(tokenizer)  # the tokenizer file: its size is fixed

    def vocabulary() -> Vocabulary:
        if key not in _vocabularies:
            _vocabularies[key] = Vocabulary(shared.value)
        return _vocabularies[key]

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + (["ids", "decoded"] if ids else [])
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (
        ", ids array<int>, decoded string" if ids else "")

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary()
        for block in small_blocks(batches):
            rows = []
            for text in block.column("text").to_pylist():
                words = v.split(text or "")
                spaced, decoded = " ".join(map(v.ids.__getitem__, words)), " ".join(map(v.texts.__getitem__, words))
                rows.append((spaced.count(" ") + 1 if words else 0, _sha(spaced), _sha(decoded),
                             *((list(map(int, spaced.split())), decoded) if ids else ())))
            columns = [block.column("doc_id"), *[pa.array(c, t) for c, t in zip(zip(*rows), types[1:])]]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = plain(docs, id_col, text_col)
    unsplit = F.coalesce(F.col("text").rlike(f"[^\\s]{{{long_chars}}}"), F.lit(False))
    short = rows.where(~unsplit).mapInArrow(whole, schema)
    long = written(rows.where(unsplit).withColumn("uid", F.monotonically_increasing_id()), "bpe-long")
    if long.isEmpty():
        return short

    fields = ["uid", "doc_id", "word", "leaf", "leaves", "raw", "ids"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int32())]
    pieces_schema = "uid long, doc_id long, word long, leaf long, leaves long, raw boolean, ids array<int>"

    def batch_of(parts: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*parts), kinds)], fields)

    def leaves_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Short words as ids, long ones as runs of symbols."""
        v = vocabulary()
        for batch in batches:
            for uid, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("uid", "doc_id", "text"))):
                done: list[int] = []
                word = 0
                for w in v.split(text):
                    symbols = [] if isinstance(w, int) else v.start(w)
                    if len(symbols) <= task_leaf:
                        done += [w] if isinstance(w, int) else v.tree(symbols)
                    if done and (len(symbols) > task_leaf or len(done) > IDS_IN_BATCH):
                        yield batch_of([(uid, doc_id, word, 0, 1, False, done)])
                        word, done = word + 1, []
                    if len(symbols) > task_leaf:
                        count = -(-len(symbols) // task_leaf)
                        for leaf in range(count):
                            run = symbols[leaf * task_leaf:(leaf + 1) * task_leaf]
                            yield batch_of([(uid, doc_id, word, leaf, count, True, run)])
                        word += 1
                yield batch_of([(uid, doc_id, word, 0, 1, False, done)])

    def encode_leaves(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary()
        for batch in batches:
            for row in range(batch.num_rows):
                *head, raw, found = (batch.column(c)[row].as_py() for c in fields)
                yield batch_of([(*head, False, v.tree(found) if raw else found)])

    def join_two(group):
        """The two halves of a node, or a last one without a partner."""
        group = group.sort_values("leaf")
        out = group.iloc[:1].copy()
        if len(group) > 1:
            out["ids"] = [vocabulary().join(*([int(x) for x in half] for half in group["ids"]))]
        out["leaf"] //= 2
        out["leaves"] = (out["leaves"] + 1) // 2
        return out

    def finish(group):
        import pandas as pd

        found = [int(x) for part in group.sort_values("word")["ids"] for x in part]
        decoded = vocabulary().decode(found)
        doc_id = group["doc_id"].iloc[0]
        row = [None if pd.isna(doc_id) else int(doc_id), len(found), _sha(" ".join(map(str, found))), _sha(decoded)]
        return pd.DataFrame([row + ([found, decoded] if ids else [])], columns=names).astype({"doc_id": "Int64"})

    cut = written(long.mapInArrow(leaves_of, pieces_schema), "bpe-leaves")
    cut = written(cut.repartition("uid", "word", "leaf").mapInArrow(encode_leaves, pieces_schema), "bpe-nodes")
    done, nodes = cut.where("leaves = 1"), cut.where("leaves > 1")
    while not nodes.isEmpty():
        level = written(nodes.groupBy("uid", "word", F.floor(F.col("leaf") / 2)).applyInPandas(join_two, pieces_schema),
                        "bpe-nodes")
        done, nodes = done.union(level.where("leaves = 1")), level.where("leaves > 1")
    return short.union(done.groupBy("uid").applyInPandas(finish, schema))
