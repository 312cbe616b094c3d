"""One id with several texts, and workers that have no copy of the package."""

import hashlib
import os
import random
import subprocess
import sys

from gradeflow.llm import substring, suffixes

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def rows():
    rng = random.Random(1)
    words = [f"w{k}" for k in range(400)]
    line = lambda n: " ".join(rng.choices(words, k=n))
    shared = line(80)
    out = [(1, f"{line(20)} {shared} {line(5)}"), (2, f"{line(40)} {shared}"), (2, line(200)), (2, f"{shared} {line(30)}"), (2, "short")]
    out += [(3, shared), (3, shared), (4, line(300)), (4, line(120)), (None, shared)]
    return out


def removed(units, ids, length):
    """Units covered by a window that starts in a text of a smaller id; rows apart."""
    first: dict = {}
    for u, i in zip(units, ids):
        for at in range(len(u) - length + 1) if i is not None else ():
            key = tuple(u[at:at + length])
            first[key] = min(i, first.get(key, i))
    out = []
    for u, i in zip(units, ids):
        gone = [False] * len(u)
        for at in range(len(u) - length + 1) if i is not None else ():
            if first[tuple(u[at:at + length])] < i:
                gone[at:at + length] = [True] * length
        out.append(gone)
    return out


def test_one_id_several_texts(spark):
    data = rows()
    ids = [i for i, _ in data]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    words = [t.split() for _, t in data]
    want = []
    for i, w, g in zip(ids, words, removed(words, ids, 50)):
        kept = " ".join(x for x, gone in zip(w, g) if not gone)
        want.append((str(i), len(w), sum(g), hashlib.sha256(kept.encode()).hexdigest()))
    assert sum(n for _, _, n, _ in want) == 4 * 80
    got = substring.remove_repeated(docs, text=False).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(want)
    raw = [t.encode() for _, t in data]
    want = []
    for i, b, g in zip(ids, raw, removed(raw, ids, 50)):
        kept = bytes(x for x, gone in zip(b, g) if not gone)
        want.append((str(i), len(b), sum(g), hashlib.sha256(kept).hexdigest()))
    for crowded in (2000, 1):
        got = suffixes.remove_repeated_bytes(docs, crowded=crowded, content=False).collect()
        assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.kept_sha256) for r in got) == sorted(want)


JOB = """
import sys
sys.path.insert(0, {root!r})
from gradeflow import local_session
from gradeflow.llm import near, substring, suffixes, toxicity, wordbpe
spark = local_session(2, 2, **{{"spark.checkpoint.dir": {shared!r}}})
sys.path.remove({root!r})
docs = spark.createDataFrame([(1, "a b c d e f women and men"), (2, "a b c d e f women and men")], "doc_id long, text string")
labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
assert near.near_duplicates(docs).where("kept").count() == 1
assert substring.remove_repeated(docs).count() == suffixes.remove_repeated_bytes(docs).count() == 2
assert toxicity.score_texts(docs, toxicity.fit(toxicity.sample(docs, labels))).count() == 2
print("done")
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    job = JOB.format(root=ROOT, shared=str(tmp_path))
    done = subprocess.run([sys.executable, "-c", job], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("done"), done.stderr[-3000:]
