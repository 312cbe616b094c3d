"""The operators against brute force, with nulls, empty and very long texts, ties and repeats."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest

from gradeflow.llm import bpe, contamination, langid, licenses, near, substring, suffixes, toxicity, warc

SCHEMA = "doc_id long, text string, node string, row int, `a.h` string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(seed=3, count=60, words=("the", "on", "Éa", "lorem", "ipsum", "x", "license", "mit"), length=70):
    rng = random.Random(seed)
    base = [" ".join(rng.choices(words, k=rng.randint(0, length))) for _ in range(count // 3)]
    texts = []
    for _ in range(count):
        t = rng.choice(base).split()
        if t and rng.random() < 0.6:
            t[rng.randrange(len(t))] = rng.choice(words).upper()
        texts.append(rng.choice([" ", "\n", "\t "]).join(t))
    texts += ["", None, "one two", "ONE  two", "é" * 300, "a" * 500, "a" * 460, base[0], base[0]]
    return [(i * 7 % 1009, t) for i, t in enumerate(texts)]


def frame(spark, rows, parts=5):
    """Columns with names that the operators use inside."""
    return spark.createDataFrame([(i, t, "n", 1, "h") for i, t in rows], SCHEMA).repartition(parts)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingles(text):
    w = WORDS.findall(lower(text or ""))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize("leaf", [24, 0])
def test_near(spark, leaf):
    rows = rows_of(length=200)
    sets = {i: shingles(t) for i, t in rows}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    out = near.near_duplicates(frame(spark, rows), leaf=leaf).collect()
    assert len({find(i) for i in sets}) < len(sets) - 5
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out) == sorted(
        (i, len(s), find(i), find(i) == i) for i, s in sets.items())


def test_near_template_just_below_the_threshold(spark):
    # 200 shingles, 171 of the template: 171 / 229 is not enough; a pair's common word makes it 172 / 228.
    template = [f"t{k}" for k in range(175)]
    rows = [(i, " ".join([*template, f"pair{i // 2}", *(f"own{i}.{k}" for k in range(28))])) for i in range(1000)]
    out = near.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == [(i, 200, i - i % 2) for i in range(1000)]


def test_near_null_id_and_empty(spark):
    docs = frame(spark, [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f")])
    out = near.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in out) == [("1", 1, True), ("1", 1, True), ("None", None, False)]
    assert near.near_duplicates(docs.limit(0)).count() == 0


def brute_removed(units, length):
    first = {}
    for i in sorted(units):
        for at in range(len(units[i]) - length + 1):
            first.setdefault(tuple(units[i][at:at + length]), i)
    gone = {}
    for i, u in units.items():
        gone[i] = [False] * len(u)
        for at in range(len(u) - length + 1):
            if first[tuple(u[at:at + length])] < i:
                gone[i][at:at + length] = [True] * length
    return gone


def test_words(spark):
    rows = rows_of(length=200)
    units = {i: WORDS.findall(t or "") for i, t in rows}
    gone = brute_removed(units, 50)
    out = substring.remove_repeated(frame(spark, rows)).collect()
    assert sum(map(sum, gone.values())) > 500 and len(out) == len(rows)
    for r in out:
        kept = " ".join(w for w, g in zip(units[r.doc_id], gone[r.doc_id]) if not g)
        assert (r.n_words, r.n_removed, r.kept_text) == (len(units[r.doc_id]), sum(gone[r.doc_id]), kept)
        assert r.kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert substring.remove_repeated(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("crowded", [2000, 1])
def test_bytes(spark, crowded):
    rows = rows_of()
    units = {i: (t or "").encode() for i, t in rows}
    gone = brute_removed(units, 50)
    out = suffixes.remove_repeated_bytes(frame(spark, rows), crowded=crowded, bin_bytes=500).collect()
    assert sum(map(sum, gone.values())) > 500 and len(out) == len(rows)
    for r in out:
        g = gone[r.doc_id]
        kept = bytes(b for b, x in zip(units[r.doc_id], g) if not x)
        spans = sum(x and not y for x, y in zip(g, [False] + g))
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == (len(g), sum(g), spans, kept)
    assert suffixes.remove_repeated_bytes(frame(spark, rows).limit(0)).count() == 0


def test_suffix_array():
    rng = random.Random(5)
    for _ in range(2000):
        text = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randrange(60))]
        assert suffixes.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_cover():
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))


def test_bpe_is_the_library(spark):
    import base64

    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(2)
    rows = rows_of(count=12) + [(2000 + k, "".join(rng.choices("ab é漢\n '1s<|>‍🙂", k=200))) for k in range(40)]
    rows += [(3000, "ab" * 20_000), (3001, "<|endoftext|>")]
    for r in bpe.encode(frame(spark, rows), bpe.read_ranks(path), public_tokenizers.PATTERN).collect():
        text = dict(rows)[r.doc_id] or ""
        assert r.ids == library.encode_ordinary(text) and bytes(r.decoded) == text.encode() and r.n_tokens == len(r.ids)


def test_licenses(spark):
    rows = rows_of() + [(5000, licenses.TEMPLATES["bsd"].upper()), (5001, "Apache  License, the MIT-License license")]
    phrases = {tuple(p.split()): label for p, label in licenses.PHRASES.items()}
    out = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
        found = [(at, phrases[p]) for p in phrases for at in range(len(w)) if tuple(w[at:at + len(p)]) == p]
        r = out[i]
        assert (r.n_words, r.n_base) == (len(w), len(found))
        assert (r.first_word, r.last_word) == ((min(found)[0], max(found)[0]) if found else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in found})) and 0 <= r.score <= 1
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    assert out[5000].labels == "bsd" and out[5000].spans[0]["end"] == out[5000].n_words


def test_matching_statistics():
    rng = random.Random(8)
    texts = [[rng.randrange(3) for _ in range(12)] for _ in range(3)]
    automaton = licenses.Automaton()
    for k, t in enumerate(texts):
        automaton.add(t, k)
    known = {tuple(t[a:b]) for t in texts for a in range(12) for b in range(a + 1, 13)}
    query = [rng.randrange(4) for _ in range(200)]
    for at, (_, size) in enumerate(automaton.statistics(query)):
        assert size == max([n for n in range(1, at + 2) if tuple(query[at + 1 - n:at + 1]) in known], default=0)


def test_contamination(spark):
    rng = random.Random(4)
    pool = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choices(pool, k=rng.randint(4, 40)))) for k in range(30)] + [(90, None), (None, "x"), (91, "")]
    texts = [" ".join(rng.choices(pool, k=300)) for _ in range(40)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(100 + k, f"{texts[k]} {items[k][1].upper()}. {texts[k]}") for k in range(30)]
    rows += [(200, None), (201, "")]
    tests = spark.createDataFrame(items, "item_id long, text string")
    out = {r.doc_id: r for r in contamination.contaminated(frame(spark, rows), tests).collect()}
    assert all(k in out[100 + k]["items"] for k in range(30))
    assert not any(out[i].contaminated for i in [*range(40), 200, 201])
    assert contamination.contaminated(frame(spark, rows), tests.limit(0)).where("contaminated").count() == 0


def test_contamination_changed_and_cut(spark):
    rng = random.Random(14)
    pool = [f"w{k}" for k in range(400)]
    items = [(n, rng.sample(pool, n)) for n in range(4, 60)]
    rows, wanted = [], {}

    def leak(k, words):
        wanted[len(rows)] = k
        rows.append((len(rows), " ".join([*rng.choices(pool, k=100), *words, *rng.choices(pool, k=100)])))

    for n, words in items:
        for at in range(n):
            leak(n, [*words[:at], f"x{at}", *words[at + 1:]])
        gone = set(rng.sample(range(n), max(1, n // 10)))
        leak(n, [f"x{k}" if k in gone else w for k, w in enumerate(words)])
        leak(n, [w for k, w in enumerate(words) if k not in gone])
        leak(n, [v for k, w in enumerate(words) for v in ([w, f"x{k}"] if k in gone else [w])])
        if n >= 7:
            leak(n, words[:int(n * 0.85)])
    # Half of an item's words, or all of them in another order, are not the item.
    others = [(100_000 + n, " ".join([*rng.choices(pool, k=50), *f(words), *rng.choices(pool, k=50)]))
              for n, words in items if n >= 20 for f in (lambda w: w[::-1], lambda w: w[:len(w) // 2])]
    tests = spark.createDataFrame([(n, " ".join(w)) for n, w in items], "item_id long, text string")
    out = {}
    for r in contamination.contaminated(frame(spark, rows + others), tests).collect():
        out.setdefault(r.doc_id, set()).update(r["items"])
    assert [i for i, k in wanted.items() if k not in out[i]] == []
    assert not any(i - 100_000 in found for i, found in out.items() if i >= 100_000)


def test_block_max_finds_what_scoring_everything_finds():
    rng = random.Random(9)
    pool = [f"w{k}" for k in range(60)]
    index = contamination.Index([(k, " ".join(rng.choices(pool, k=rng.randint(1, 15)))) for k in range(100)])
    for _ in range(100):
        terms = np.array(sorted(rng.sample(range(len(index.vocabulary)), 20)))
        scores = {}
        for t in terms:
            for item, part in index.postings[t]:
                scores[item] = scores.get(item, 0) + part
        assert sorted(i for i, _ in index.search(terms, 0.5)) == sorted(i for i, s in scores.items() if s >= 0.5 - 1e-12)


def test_warc(spark):
    rows = [(k, f"http://x/{k}", c * 1500) for k, c in enumerate("abacab")]
    rows += [(10, "u", "s"), (11, "u", "s"), (12, None, None), (None, "u\r\nv", "b" * 1500), (13, "u", ""), (14, "é", "é" * 500), (15, "é", "é" * 500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    index = warc.write_archives(pages)
    out = {r.page_id: r for r in warc.read_records(index).collect()}
    assert len(out) == len(rows)
    for i, _, html in rows:
        same = [k for k, _, h in rows if h == html and k is not None]
        raw = (html or "").encode()
        revisit = len(raw) >= 1000 and i != max(same)
        assert (out[i].payload_bytes, out[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (out[i].record_type, out[i].refers_to) == (("revisit", max(same)) if revisit else ("response", None))
        assert bytes(out[i].payload) == (b"" if revisit else raw)
    assert [r.page_id for r in warc.read_records(index.where("page_id = 10")).collect()] == [10]
    assert warc.read_records(warc.write_archives(pages.limit(0))).count() == 0


def test_recurrent_gradient():
    rng = np.random.default_rng(1)
    p = langid.train([b"abc def", b"xyz uvw"], np.array([0, 1]), 2, hidden=3, steps=1)
    p = {k: v.astype(np.float64) for k, v in p.items()}
    x, y = rng.integers(0, 257, (6, 5)), np.array([0, 1, 1, 0, 1])
    _, g = langid.gradients(x, y, p)
    for name in p:
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        up, down = ({**p, name: p[name].copy()} for _ in range(2))
        up[name][at] += 1e-3
        down[name][at] -= 1e-3
        slope = (langid.gradients(x, y, up)[0] - langid.gradients(x, y, down)[0]) / 2e-3
        assert abs(slope - g[name][at]) < 1e-3 * max(1, abs(slope))


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    network, languages = langid.fit(docs.where(~langid.held_out()))
    marked = langid.identify(docs.where(langid.held_out()), network, languages, carry=True)
    right = marked.selectExpr("avg(cast(lang_pred = row.lang as int)) as a").first().a
    assert right > 0.9
    odd = langid.identify(frame(spark, [(1, None), (2, "12 !"), (3, "")]), network, languages).collect()
    assert {(r.lang_pred, r.score) for r in odd} == {("und", 0.0)}
    assert langid.fit(docs.limit(0)) == ({}, [])
    assert langid.identify(frame(spark, [(1, "abc")]), {}, []).first().lang_pred == "und"


def test_toxicity(spark):
    rng = random.Random(6)
    pool = [f"w{k}" for k in range(50)]
    rows, labels = [], []
    for k in range(400):
        bad = k % 2
        words = rng.choices(pool, k=30) + (["vile"] * 2 if bad else [])
        if rng.random() < (0.8 if bad else 0.1):
            words.append("muslim")
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
        labels.append((k, bad))
    marks = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    docs = frame(spark, rows + [(900, None), (901, "")])
    plain_model = toxicity.fit(toxicity.sample(docs, marks), penalty=0.0)
    model = toxicity.fit(toxicity.sample(docs, marks), penalty=20.0)
    out = toxicity.score_texts(docs, model).collect()
    assert sum(r.predicted == r.doc_id % 2 for r in out if r.doc_id < 400) > 390
    assert len(out) == 402 and all(0 <= r.score <= 1 for r in out)
    pair = frame(spark, [(1, "w1 w2 muslim"), (2, "w1 w2 christian")])

    def gap(m):
        scores = {r.doc_id: r.score for r in toxicity.score_texts(pair, m).collect()}
        return abs(scores[1] - scores[2])

    assert gap(model) < 0.5 * gap(plain_model)
    assert toxicity.score_texts(docs, toxicity.fit(toxicity.sample(docs, marks.limit(0)))).where("predicted = 1").count() == 0
