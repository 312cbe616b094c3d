"""BPE with word ends against the tokenizer library."""

import hashlib
import random
import sys

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gradeflow.llm import wordbpe

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, word string, uid int, `a.h` string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return wordbpe.Vocabulary(wordbpe.read_tokenizer(PATH))


def ids_of(v, text):
    return [x for w in v.split(text) for x in ([w] if isinstance(w, int) else v.tree(v.start(w)))]


def test_any_text(library, vocabulary):
    rng = random.Random(1)
    chars = "abcdefghijklmnopqrstuvwxyzABC  '’éÉ漢字1239½Σσßİ\n\t<|>.!?#️👍🏽‍̸́\x1c\x85꟎"
    for _ in range(4000):
        text = "".join(rng.choices(chars, k=rng.randint(0, 60)))
        if rng.random() < 0.2:
            text += f"<|endoftext|>{text[:5]}<|startoftext|>"
        ids = library.encode(text, add_special_tokens=False).ids
        assert ids_of(vocabulary, text) == ids
        assert vocabulary.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_every_character(library, vocabulary):
    for c in [*range(0xD800), *range(0xE000, sys.maxunicode + 1, 7)]:
        text = f"a{chr(c)}1{chr(c)}!"
        assert ids_of(vocabulary, text) == library.encode(text, add_special_tokens=False).ids, hex(c)


def test_long_words_join_exactly(library, vocabulary):
    rng = random.Random(2)
    for k in range(120):
        text = ["a" * rng.randint(1, 5000), "thequickbrown" * rng.randint(1, 300), "é🙂" * rng.randint(1, 300),
                "".join(rng.choices("abcdehinrst", k=rng.randint(30, 3000)))][k % 4]
        assert ids_of(vocabulary, text) == library.encode(text, add_special_tokens=False).ids
        symbols = vocabulary.start("".join(vocabulary.split(text)) if k % 4 != 2 else "abc" * 50)
        cut = rng.randrange(1, len(symbols)) if len(symbols) > 1 else 0
        if cut:  # any join, not only that of halves
            joined = vocabulary.join(vocabulary.tree(symbols[:cut]), vocabulary.tree(symbols[cut:]))
            assert joined == vocabulary.greedy(symbols)


@pytest.mark.parametrize("long_chars, leaf", [(1 << 16, 1 << 14), (40, 32)])
def test_operator(spark, library, long_chars, leaf):
    rng = random.Random(3)
    rows = [(1, "It's a TEST, isn't it? 42"), (2, ""), (3, None), (3, "twice"), (3, "twice"), (None, "no id"), (4, " \n\t"),
            (5, "<|endoftext|>x<|startoftext|>"), (6, "word " * 500_000),
            (7, "".join(rng.choices("abcdefgh", k=70_000)) + " tail's " + "z" * 3000), (8, "".join(rng.choices("aé漢1", k=500)))]
    docs = spark.createDataFrame([(i, t, "w", 1, "h") for i, t in rows], SCHEMA).repartition(3)
    out = wordbpe.encode(docs, wordbpe.read_tokenizer(PATH), long_chars=long_chars, task_leaf=leaf).collect()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((str(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(decoded.encode()).hexdigest(), ids, decoded))
    assert sorted((str(r.doc_id), *r[1:]) for r in out) == sorted(want)
    assert wordbpe.encode(docs.limit(0), wordbpe.read_tokenizer(PATH), ids=False).collect() == []
