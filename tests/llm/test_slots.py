"""The table of hash slots against counting, and archive records of rows that repeat."""

import numpy as np
import pytest

from gradeflow.llm import slots, warc


@pytest.mark.parametrize("held", [10, 1 << 20])
def test_table_keeps_all_that_repeat(spark, held, monkeypatch):
    monkeypatch.setattr(slots, "HELD", held)
    rng = np.random.default_rng(3)
    values = rng.integers(0, 2**64, 5_000, dtype=np.uint64)
    values = np.concatenate([values, values[:700], values[:1], values[:1]])
    rng.shuffle(values)
    batches = [b for part in np.array_split(values, 6) for b in slots.gathered(np.array_split(part, 4))]
    rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("block", "seen", "often")))]
    table = slots.repeated_slots(spark.createDataFrame(rows, slots.GATHERED))
    once, counts = np.unique(values, return_counts=True)
    found = slots.may_repeat(table, once)
    assert found[counts > 1].all()
    assert found[counts == 1].mean() < 0.01
    empty = slots.repeated_slots(spark.createDataFrame([], slots.GATHERED))
    assert not slots.may_repeat(empty, once).any()


def test_rows_that_repeat_id_and_payload(spark):
    """One response for all rows of an id and payload: the first by URL, also among equal rows."""
    body = "x" * 1200
    rows = [(20, "u1", body), (20, "u1", body), (20, "u2", body), (19, "u0", body), (21, "v", "y" * 1200), (21, "v", "y" * 1200),
            (21, None, "y" * 1200), (None, "w", "z" * 1200), (None, "w", "z" * 1200), (22, "a", "s"), (22, "a", "s")]
    index = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4))
    got = sorted((str(r.page_id), str(r.url), r.record_type, str(r.refers_to)) for r in index.collect())
    assert got == sorted([("20", "u1", "response", "None"), ("20", "u1", "revisit", "20"), ("20", "u2", "revisit", "20"),
                          ("19", "u0", "revisit", "20"), ("21", "None", "response", "None"), ("21", "v", "revisit", "21"),
                          ("21", "v", "revisit", "21"), ("None", "w", "response", "None"), ("None", "w", "revisit", "None"),
                          ("22", "a", "response", "None"), ("22", "a", "response", "None")])
    assert warc.read_records(index).count() == len(rows)
