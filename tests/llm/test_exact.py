import collections
import random

from hypothesis import given, settings, strategies as st

from gradeflow.llm.exact import exact_dedup, radix_groups


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def check(rows, out):
    groups = collections.defaultdict(list)
    for doc, text in rows:
        groups[lowered(text)].append(doc)
    assert len(out) == len(rows)
    for key, ids in groups.items():
        mine = [r for r in out if lowered(r.text) == key]
        top = max(ids, key=lambda i: (i is not None, i or 0))
        assert sum(r.kept for r in mine) == 1
        assert {(r.keep_id, r.group_size) for r in mine} == {(top, len(ids))}
        assert all(r.doc_id == top for r in mine if r.kept)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.binary(max_size=40), max_size=30))
def test_radix_groups(texts):
    want = collections.defaultdict(list)
    for i, t in enumerate(texts):
        want[t].append(i)
    assert sorted(map(sorted, radix_groups(texts))) == sorted(want.values()) or not texts


def rows_with_everything():
    random.seed(3)
    long = "abc " * 30_000
    rows = [(i, random.choice(["Hot Text", "hot text", "Other É", "other é", "", None, "x" * 20, "x" * 21,
                               "x" * 300 + "a", "x" * 300 + "b"])) for i in range(400)]
    return rows + [(400, long), (401, long.upper()), (402, long + "!"), (403, "solo"), (None, "hot text"),
                   (None, "nobody"), (403, "solo")]


def test_against_brute_force(spark):
    rows = rows_with_everything()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check(rows, exact_dedup(docs).collect())


def test_groups_split_across_the_cluster(spark):
    rows = rows_with_everything()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    check(rows, exact_dedup(docs, leaf_rows=2, leaf_bytes=50, first_bytes=2).collect())


def test_empty_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "A", 5, "z"), (2, "a", 6, "y")], "doc_id long, text string, kept int, `a.b` string")
    out = exact_dedup(docs)
    assert sorted(out.columns) == sorted(["doc_id", "text", "a.b", "keep_id", "group_size", "kept", "text_sha256"])
    assert sorted((r.doc_id, r.kept, r["a.b"]) for r in out.collect()) == [(1, False, "z"), (2, True, "y")]
    assert exact_dedup(docs.limit(0)).count() == 0
