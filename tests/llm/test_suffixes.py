"""Repeated byte strings: many blocks, askers and crowded keys against brute force, and what is moved for copied text."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from gradeflow.llm import suffixes
from gradeflow.llm.common import byte_table, flat_bytes, window_hashes, written


def brute(rows, length=50):
    """(id, bytes, bytes removed, spans, digest of the rest), as of rows with an id."""
    first = {}
    for i, raw in rows:
        for at in range(len(raw) - length + 1) if i is not None else ():
            s = raw[at:at + length]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, raw in rows:
        gone = [False] * len(raw)
        for at in range(len(raw) - length + 1) if i is not None else ():
            if first[raw[at:at + length]] < i:
                gone[at:at + length] = [True] * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((str(i), len(raw), sum(gone), sum(g and not b for b, g in zip([False, *gone], gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def odd_rows(seed):
    """Copies with edits, a common line, periodic texts, short and null ones, ids that repeat or are null."""
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    base, line = [make(700) for _ in range(4)], make(60)
    rows = [(None, base[0]), (3, None), (4, ""), (5, "z" * 300), (6, "y" + "z" * 200), (7, "xyz" * 90), (8, "yzx" * 70), (9, "short")]
    for i in range(10, 70):
        x = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            x[rng.randrange(len(x))] = rng.choice("xyz")
        cut = rng.randrange(300)
        rows.append((i, make(rng.randrange(40)) + "".join(x[cut:cut + rng.randrange(60, 600)]) + make(9) + line + make(rng.randrange(30))))
    rows += [(12, rows[30][1]), (12, base[1]), (40, rows[20][1])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("crowded, bin_bytes", [(2000, 64 << 10), (1, 64 << 10), (2000, 40)])
def test_many_blocks_and_askers(spark, monkeypatch, crowded, bin_bytes):
    for name, value in (("BLOCK", 4000), ("ASKED", 6000), ("RUN", 1500), ("CELL", 128), ("MANY", 1), ("SPANS", 5)):
        monkeypatch.setattr(suffixes, name, value)
    rows = odd_rows(1)
    want = brute([(i, (t or "").encode()) for i, t in rows])
    assert sum(n for _, _, n, *_ in want) > 5000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffixes.remove_repeated_bytes(docs, crowded=crowded, bin_bytes=bin_bytes, content=False).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_copied_text_moves_once(spark, monkeypatch):
    """A long passage of two documents is moved in long slices, not with every run's own overlap."""
    rng = random.Random(2)
    make = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared, moved = make(20_000), []

    def keep(df, name):
        out = written(df, name)
        if "slice" in out.columns:
            moved.append(out.selectExpr("sum(length(slice))").first()[0] or 0)
        return out

    monkeypatch.setattr(suffixes, "written", keep)
    docs = spark.createDataFrame([(i, make(500) + shared * (i < 3) + make(20_000)) for i in range(1, 6)], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffixes.remove_repeated_bytes(docs, content=False).collect()}
    assert got == {1: 0, 2: 20_000, 3: 0, 4: 0, 5: 0}
    assert 40_000 <= moved[0] < 50_000  # both copies and little beside them
    assert sum(moved) < 80_000


@pytest.mark.parametrize("part", [None, 9, 3, 1])
def test_equal_strings_have_equal_keys(part):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(200))).encode() for _ in range(40)] + [b"z" * 130, b"xy" * 70]
    texts += [b"q" * rng.randrange(20) + t + b"r" for t in texts]
    buf, offsets = flat_bytes(pa.array(texts, pa.binary()))
    keys, seen = {}, 0
    for value, text, at, n in zip(*(x.tolist() for x in suffixes.runs_of(buf, offsets, 50, 24, part))):
        for s in range(at, at + n):
            string = texts[text][s:s + 50]
            assert len(string) == 50 and keys.setdefault(string, value) == value
            seen += 1
    assert seen == sum(max(0, len(t) - 49) for t in texts)
    assert part != 1 or len(set(keys.values())) == len(keys)


@pytest.mark.parametrize("bin_bytes", [64 << 10, 300])
def test_pieces_that_overlap_are_sorted(bin_bytes):
    """Distinct slices of a key that hold each other's parts, also more than a bin of them."""
    rng = random.Random(4)
    base = bytes(rng.randrange(97, 101) for _ in range(900))
    held = []
    for k in range(60):
        at = rng.randrange(700)
        piece = bytearray(base[at:at + rng.randrange(50, 400)])
        piece[rng.randrange(len(piece))] = 120
        held.append((k // 30, bytes(piece) if len(piece) >= 50 else base[:50], rng.randrange(50)))
    first = {}
    for h, piece, low in held:
        for at in range(len(piece) - 49):
            first[h, piece[at:at + 50]] = min(first.get((h, piece[at:at + 50]), 99), low)
    # Strings of two keys would be equal only by what the keys leave out: keys of one string are the same.
    for key in (0, 1):
        some = [x for x in held if x[0] == key]
        out = suffixes._known(some, 50, 24, bin_bytes, 81)
        for (h, piece, _), ends, lows in zip(some, out.column("ends").to_pylist(), out.column("lows").to_pylist()):
            got = np.repeat(lows, np.diff([0, *ends])).tolist()
            assert got == [first[h, piece[at:at + 50]] for at in range(len(piece) - 49)]


def test_values_in_one_owner_only():
    value = window_hashes(byte_table("random")[np.frombuffer(b"abcabc", np.uint8)], 1)
    assert suffixes._elsewhere(value, np.array([0, 0, 0, 0, 1, 1])).tolist() == [False, True, True, False, True, True]
