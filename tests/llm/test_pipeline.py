"""Every stage against a plain version on its own input."""

import base64
import re
import zlib

import corpus_pipeline
import public_tokenizers
import tiktoken

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(
            stage(spark, docs, SF).collect(), docs.schema)
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    after = kept["language ID"]
    assert set(after) <= set(source) and len(after) > 0.98 * len(source)
    best = {}
    for i, t in after.items():
        best[re.sub("[A-Z]", lambda m: m[0].lower(), t)] = max(i, best.get(re.sub("[A-Z]", lambda m: m[0].lower(), t), -1))
    assert set(kept["exact dedup"]) == set(best.values())
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {i for i, t in kept["near dedup"].items() if any(x in t for x in items)}
    assert not leaks & set(kept["benchmark decontamination"])
    assert len(kept["benchmark decontamination"]) >= len(kept["near dedup"]) - len(leaks) - 1
    ranks = {base64.b64decode(a): int(b) for a, b in (
        x.split() for x in open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    final = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in final} == set(kept["benchmark decontamination"])
    assert all(r.ids == library.encode_ordinary(source[r.doc_id]) for r in final)


def test_language_stage_keeps_what_it_cannot_judge(spark):
    def kept(rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        return sorted(r.doc_id for r in corpus_pipeline.language_id(spark, docs, SF).collect())

    texts = ["the cat is on the mat", "le chat est sur la table", "12 !", None, "", "Ж"]
    assert kept([(i, t, None) for i, t in enumerate(texts)]) == [0, 1, 5]  # no label at all
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 3 == 1][:6]
    # All labelled rows are held out; one language rejects nothing.
    assert kept([(i, t, "en") for i, t in zip(held, texts)]) == sorted([held[0], held[1], held[5]])
    assert len(kept([(i, texts[k % 2] * 20, "enfr"[k % 2 * 2:][:2]) for k, i in enumerate(held)])) == 6


def test_language_cut_follows_the_number_of_languages():
    cuts = [corpus_pipeline.least_score(n) for n in (1, 2, 4, 100)]
    assert cuts[0] == 0 and 0.5 < cuts[1] < 0.7 and abs(cuts[2] - 0.4) < 1e-9 and 0.01 < cuts[3] < cuts[2]


def test_columns_of_any_name_come_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    docs = docs.withColumn("a.h", docs.lang).withColumn("kept", docs.doc_id % 2 == 0).withColumn("row", docs.doc_id)
    want = {r.doc_id: tuple(r) for r in docs.collect()}
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(step(spark, docs, SF).collect(), docs.schema)
        rows = docs.collect()
        assert rows and all(tuple(r) == want[r.doc_id] for r in rows)


def test_scratch_of_a_stage_goes_with_the_next(spark):
    import os

    from gradeflow.session import shared_folder

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = dict(corpus_pipeline.STAGES)["exact dedup"](spark, docs, SF)
    first.collect()
    held = [p.rsplit("/", 1)[1] for _, p in corpus_pipeline._held]
    assert held and all(os.path.isdir(f"{shared_folder(spark)}/{h}") for h in held)
    corpus_pipeline.decontamination(spark, docs, SF).collect()
    assert not any(os.path.isdir(f"{shared_folder(spark)}/{h}") for h in held)
