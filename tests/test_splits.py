"""Quoted CSV and JSON files cut at any byte, against Python's own readers."""

import csv
import io
import json
import random

import pytest

from gradeflow import sources
from gradeflow.sources import arrays, quoted


@pytest.fixture()
def tiny_splits(spark):
    settings = {"spark.sql.files.maxPartitionBytes": "67", "spark.sql.files.openCostInBytes": "0",
                "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def csv_bodies(rng):
    marks = ["a", "b", ",", '"', '""', "\n", "\r\n", "\r", '","', '",\n"', " ", '"\r"']
    for k in range(4):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator=["\n", "\r\n", "\r", "\n"][k], quoting=[csv.QUOTE_ALL, csv.QUOTE_MINIMAL][k % 2])
        for _ in range(40):
            writer.writerow(["".join(rng.choices('abc é漢,"\n\r', k=rng.randint(0, 30))) for _ in range(rng.randint(1, 4))])
        yield out.getvalue()
    for _ in range(4):  # quotes where they do not belong
        yield "".join(rng.choices(marks, k=600)) + "\n"


def test_csv_is_what_one_reader_gives(tiny_splits, tmp_path):
    rng = random.Random(4)
    want = []
    for k, body in enumerate(csv_bodies(rng)):
        with open(f"{tmp_path}/{k}.csv", "w", newline="") as out:
            out.write(body)
        want += [(f"{k}.csv", i, r) for i, r in enumerate(csv.reader(io.StringIO(body, newline="")))]
    width = max(len(r) for *_, r in want)
    spaces = " \t\n\r"
    filled = sorted((f, i, [c.strip(spaces) for c in r] + [""] * (width - len(r))) for f, i, r in want if any(c.strip() for c in r))
    rows = sources.read_csv(tiny_splits, str(tmp_path), sep=",", skip_header=False)
    assert rows.rdd.getNumPartitions() > 20
    assert sorted((r["_source_file"].rsplit("/", 1)[1], r["_row_index"], r["raw_data"]) for r in rows.collect()) == filled
    narrow = sources.read_csv(tiny_splits, str(tmp_path), sep=",", width=2).collect()
    assert {len(r["raw_data"]) for r in narrow} == {2} and min(r["_row_index"] for r in narrow) == 0


def test_splits_agree_under_both_assumptions():
    rng = random.Random(11)
    for _ in range(1500):
        body = "".join(rng.choices(["a", "b", ",", '"', '""', "\n", "\r\n", "\r", '","', " "], k=rng.randint(1, 40)))
        lines = [x.encode() for x in body.split("\n")]
        found = quoted.summarise(iter(lines), ",", "utf-8", False)
        for opened in (False, True):
            records, most, head = quoted.Records(iter(lines), ",", "utf-8", opened), 0, (0, 0)
            while records.advance():
                if opened and records.ended == 1:
                    head = records.line + 1, len(records.cells)
                else:
                    most = max(most, len(records.cells))
            plain = (int(records.open), records.ended, most, records.start, records.skip, len(records.cells) if records.open else 0)
            assert (found[6:] if opened else found[:6]) == (plain + head if opened else plain)


def value(rng, depth=0):
    kind = rng.randint(0, 7 if depth < 3 else 4)
    if kind <= 1:
        return "".join(rng.choices('ab{}[],:"\\\n é漢', k=rng.randint(0, 8)))
    if kind <= 4:
        return [1, -2.5, None][kind - 2]
    if kind == 5:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {f"k{i}": value(rng, depth + 1) for i in range(rng.randint(0, 3))}


def test_json_is_what_one_reader_gives(tiny_splits, tmp_path):
    rng = random.Random(9)
    want = []
    for k in range(60):
        root = [{"q": f"{k}.{i}", "more": value(rng)} for i in range(rng.randint(0, 12))] if k % 6 else {"q": f"{k}", "more": value(rng)}
        text = json.dumps(root, ensure_ascii=k % 2 == 0, indent=[None, 1][k % 2])
        if k % 5 == 1:
            text = f"\n {text}" + rng.choice([" ", "\n", "}", "]", ",", "[1]", "x", " {}"])
        if k % 5 == 2:
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(['"', "}", "[", ",", "\\"]) + text[at + 1:]
        with open(f"{tmp_path}/{k}.json", "w") as out:
            out.write(text)
        try:
            read = json.loads(text)
        except ValueError:
            continue
        want += [(f"{k}.json", i, x["q"]) for i, x in enumerate(read if isinstance(read, list) else [read]) if isinstance(x, dict) and "q" in x]
    rows = sources.read_json(tiny_splits, str(tmp_path), "q string").filter("q is not null").collect()
    assert len(want) > 150
    assert sorted((r["_source_file"].rsplit("/", 1)[1], r["_row_index"], r["q"]) for r in rows) == sorted(want)


def test_small_json_files_are_read_once(spark, tmp_path, monkeypatch):
    bodies = ['[{"q": "a"}, {"q": "[,]"}]', ' {"q": "b"} ', '[{"q": "c"}', '[{"q": "d"}]]', '"[', "[]", " \n", "", '[{"q": "e"}] ', '{"q": "f"}{}', "[1, ]"]
    for k, body in enumerate(bodies):
        with open(f"{tmp_path}/{k}.json", "w") as out:
            out.write(body)
    scans = []
    monkeypatch.setattr(arrays, "summaries", lambda pieces, real=arrays.summaries: scans.append(pieces) or real(pieces))
    rows = sources.read_json(spark, str(tmp_path), "q string").filter("q is not null").collect()
    assert sorted((r["_source_file"].rsplit("/", 1)[1], r["_row_index"], r["q"]) for r in rows) == [
        ("0.json", 0, "a"), ("0.json", 1, "[,]"), ("1.json", 0, "b"), ("8.json", 0, "e")]
    assert [s.rdd.getNumPartitions() for s in scans] == [0]


def test_a_large_batch_of_json_is_looked_at_in_short_runs(spark, tmp_path):
    import tracemalloc

    import pyarrow as pa

    want = [{"q": "\\" * (k % 3) * 70_001 + '"[,' + "x" * k, "n": k} for k in range(1, 2000, 100)]
    text = json.dumps(want).encode() + b" " * (3 * arrays.RUN)
    pieces = text.split(b"}")[:-1]
    batch = pa.RecordBatch.from_arrays([pa.array(["f"] * len(pieces)), pa.array(pieces, pa.binary())], ["_file", "value"])
    whole = pa.RecordBatch.from_arrays([pa.array(["f"]), pa.array([text[:-1]], pa.binary())], ["_file", "value"])
    for given, end in ((batch, b""), (whole, b"}")):
        (key, runs), = [(k, list(r)) for k, r in arrays._splits([given], "_file")]
        assert key == ("f",) and max(map(len, runs)) <= 2 * arrays.RUN + 70_001
        assert b"".join(runs) == (text[:-1] + end if end else b"".join(p + b"}" for p in pieces))
    found = list(arrays._whole_file(arrays._runs(text), len(text)))
    assert [json.loads(x[1]) for x in found] == want

    many = pa.RecordBatch.from_arrays([pa.array(["f"] * 8000), pa.array([0] * 8000), pa.array([1 << 40] * 8000),
                                       pa.array([b',{"q": "' + b"x" * 2000 + b'"'] * 8000, pa.binary())], ["_file", "_block", "_size", "value"])
    tracemalloc.start()
    count = sum(levels.sum() for _, texts in arrays._splits([many], "_file", "_block", "_size")
                for _, levels, _ in (arrays.structure(arrays.np.frombuffer(t, "uint8"), False) for t in texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == 0 and peak < 60_000_000  # the batch holds 16 MB, its places and depths hundreds


def test_structure_of_strings_and_escapes():
    import numpy as np

    for text, level, quotes in ((r'{"a\\":"}\"",', 1, 4), (r'["\\\"]",[', 2, 2), ("", None, 0)):
        _, change, count = arrays.structure(np.frombuffer(text.encode(), np.uint8), False)
        assert count == quotes and (level is None or change.sum() == level)
