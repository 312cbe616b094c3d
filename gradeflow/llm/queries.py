"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (bpe, contamination, exact, langid, licenses, near, negatives, search, substring, suffixes, toxicity, warc,
               wordbpe)

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(toxicity.sample(docs, labels.where(~toxicity.held_out())))
    return toxicity.score_texts(docs, model).select(
        "doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeated(table(spark, sf_dir, "documents"), text=False)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_records(warc.write_archives(table(spark, sf_dir, "pages")), content=False)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeated_bytes(table(spark, sf_dir, "documents"), content=False)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, ids=False)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"), spans=False)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    network, languages = langid.fit(docs.where(~langid.held_out()))
    return langid.identify(docs, network, languages).select(
        "doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op11_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = wordbpe.read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    return wordbpe.encode(table(spark, sf_dir, "documents"), tokenizer, ids=False)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


LLM_QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_toxicity, op3_decontamination, op4_substring_dedup, op5_exact_dedup, op6_warc, op7_suffix_dedup, op8_byte_bpe,
                                      op9_license_scan, op10_language_id, op11_word_bpe, op12_hard_negatives, op13_ranked_search)}

LLM_ORACLES = {
    "op1_near_dedup": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all({LOWER.format("text")}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE
                  WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3),
                                                           lambda i: array_to_string(words[i:i + 4], ' '))
                  WHEN len(words) > 0 THEN [array_to_string(words, ' ')] END) AS shingle FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (shingle)
                   WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
                 WHERE 100 * c >= 75 * (x.n + y.n - c)),
        reach AS (SELECT doc_id, doc_id AS other FROM documents
                  UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other)
        SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(other) AS component_id,
               doc_id = min(other) AS kept
        FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id""",
    "op4_substring_dedup": """
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
        win AS (SELECT doc_id, unnest(range(1, len(words) - 48)) AS i,
                       unnest(list_transform(range(1, len(words) - 48), lambda i: sha256(array_to_string(words[i:i + 49], ' ')))) AS h
                FROM w WHERE len(words) >= 50),
        low AS (SELECT h, min(doc_id) AS low FROM win GROUP BY h),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM win JOIN low USING (h) WHERE doc_id > low),
        all_gone AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
        each_word AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
        kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.i) AS kept
                 FROM each_word e ANTI JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i GROUP BY e.doc_id)
        SELECT doc_id, len(words) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN all_gone USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op5_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {LOWER.format("coalesce(text, '')")} AS low FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY low) AS keep_id,
               count(*) OVER (PARTITION BY low) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY low) AS kept, sha256(low) AS text_sha256
        FROM t""",
    "op6_warc": """
        WITH t AS (SELECT page_id, coalesce(html, '') AS body, encode(coalesce(html, '')) AS raw FROM pages),
             g AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS best, octet_length(raw) AS n FROM t)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest,
               CASE WHEN n < 1000 OR page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN n < 1000 OR page_id = best THEN NULL ELSE best END AS refers_to
        FROM g""",
    "op12_hard_negatives": """
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
                   FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
              FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
              QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id,
               positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id)
        WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= 10""",
    "op13_ranked_search": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents),
        i AS (SELECT item_id, unnest(regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark),
        s AS (SELECT count(*) AS docs, sum(len(words))::BIGINT AS total FROM d WHERE len(words) > 0),
        p AS (SELECT doc_id, len(words) AS n, unnest(words) AS term FROM d),
        t AS (SELECT doc_id, n, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM i) GROUP BY ALL),
        w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, s GROUP BY term),
        x AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // total))))::BIGINT AS score
              FROM i JOIN t USING (term) JOIN w USING (term), s GROUP BY ALL),
        r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM x WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10""",
}
