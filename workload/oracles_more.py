"""SQL for the queries of ``queries_more``, written independently of the Spark plans."""

from __future__ import annotations

from .oracles import ANSWERS, ORACLES, SCORES, SPACE, accuracy, distinct_n, strip

_LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip('x')}), lambda x: x <> '')"

# The tree, node by node: path, weight, data set.
_NODES = """(VALUES
    ('A', 1.0, NULL), ('B', 0.5, NULL), ('src7', 1.0, 'src7'),
    ('A/x', 0.6, NULL), ('A/y', 0.4, NULL), ('A/src6', 0.2, 'src6'), ('B/none', 1.0, NULL),
    ('A/x/p', 1.0, NULL), ('A/x/q', 2.0, NULL), ('A/y/r', 1.0, NULL), ('B/none/never_run', 1.0, 'never_run'),
    ('A/x/p/i', 1.0, NULL), ('A/x/p/j', 0.5, NULL), ('A/x/q/k', 1.0, NULL), ('A/y/r/l', 1.0, NULL),
    ('A/x/p/i/src0', 1.0, 'src0'), ('A/x/p/i/src1', 0.5, 'src1'), ('A/x/p/j/src2', 1.0, 'src2'), ('A/x/p/j/src3', 0.0, 'src3'),
    ('A/x/q/k/src4', 1.0, 'src4'), ('A/x/q/k/src12', 2.0, 'src12'), ('A/y/r/l/src5', 1.0, 'src5'), ('A/y/r/l/src13', 1.0, 'src13'))"""


def _level(n: int) -> str:
    """Nodes of one level: their own scores, or the weighted mean of the level below."""
    own = f"SELECT path, model, w, score FROM leaf WHERE depth = {n}"
    if n == 5:
        return f"l5 AS ({own})"
    below = f"""SELECT n.path, b.model, n.w, b.score FROM n JOIN (
        SELECT regexp_replace(path, '/[^/]+$', '') AS path, model, sum(w * score) / sum(w) AS score
        FROM l{n + 1} GROUP BY ALL HAVING sum(w) > 0) b USING (path) WHERE n.dataset IS NULL"""
    return f"l{n} AS ({own} UNION ALL {below})"


ORACLES_MORE: dict[str, str] = {
    "distinct_sketched": f"SELECT lang, distinct_ngrams, total_ngrams, TRUE AS close FROM ({distinct_n(3, 'lang')})",
    "csv_split": f"SELECT doc_id, lang, md5({strip('text')}) AS digest, TRUE AS in_order FROM documents",
    "csv_ragged": f"""
        WITH c AS (SELECT doc_id, {_LINES} AS c, len(string_split(text, chr(10))) + 1 AS width FROM documents)
        SELECT doc_id, len(c) AS cells, max(width) OVER () AS width, md5(array_to_string(c, '|')) AS digest FROM c""",
    "csv_delimiters": "SELECT o_orderkey, o_custkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders",
    "json_split": """
        SELECT doc_id, source, md5(text) AS digest, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS row_index
        FROM documents""",
    "excluded_files": "SELECT doc_id FROM documents WHERE lang NOT IN ('fr', 'de')",
    "json_written": "SELECT doc_id, lang, md5(text) AS digest FROM documents",
    "chunk_files": """
        WITH n AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents)
        SELECT doc_id, lang, md5(text) AS digest, 'part_' || lpad(CAST(n // 300 AS VARCHAR), 4, '0') || '.json' AS file,
               n % 300 AS row_index FROM n""",
    "score_tree": ORACLES["score_files"],
    "rollup_five_levels": f"""
        WITH {SCORES},
        n AS (SELECT path, CAST(w AS DOUBLE) AS w, dataset FROM {_NODES} v(path, w, dataset)),
        leaf AS (SELECT path, model, w, score, len(string_split(path, '/')) AS depth
                 FROM n JOIN scores USING (dataset) WHERE score IS NOT NULL),
        {", ".join(_level(k) for k in (5, 4, 3, 2, 1))}
        SELECT model, path, round(score, 6) AS score FROM (
            SELECT * FROM l1 WHERE path NOT LIKE '%/%' UNION ALL SELECT * FROM l2 WHERE path LIKE '%/%'
            UNION ALL SELECT * FROM l3 UNION ALL SELECT * FROM l4 UNION ALL SELECT * FROM l5)""",
    "samples_per_dataset": """
        WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('3:' || doc_id), doc_id) AS r
                   FROM documents)
        SELECT doc_id, source FROM r
        WHERE r <= CASE source WHEN 'src0' THEN 5 WHEN 'src1' THEN 40 WHEN 'src2' THEN 1e9 WHEN 'src3' THEN 1e6
                               WHEN 'src4' THEN 17 ELSE 0 END""",
    "repeated_responses": accuracy("model"),
    "arriving_twice": accuracy("model"),
    # Costs of the cheapest cut of every rest of a turn, from its end; lists hold those of the next places.
    "segmented_turns": """
        WITH RECURSIVE f AS (
            SELECT word, count(*) AS n FROM (
                SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark
                UNION ALL SELECT chr(CAST(97 + i AS INTEGER)) FROM range(26) t(i)) GROUP BY word),
        d AS (SELECT word, len(word) AS l, CAST(floor((ln(CAST(sum(n) OVER () AS DOUBLE)) - ln(CAST(n AS DOUBLE))) * 1000) AS BIGINT) AS cost FROM f),
        m AS (SELECT max(l) AS most FROM d),
        walk AS (
            SELECT conv_id, turn, regexp_replace(lower(text), '[^a-z]', '', 'g') AS run,
                   len(regexp_replace(lower(text), '[^a-z]', '', 'g')) AS i,
                   [struct_pack(cost := 0::BIGINT, n := 0::BIGINT, q := 0::BIGINT)] AS after
            FROM conversations
            UNION ALL
            SELECT conv_id, turn, any_value(run), i - 1,
                   list_prepend(min_by(struct_pack(cost := d.cost + after[k].cost, n := 1 + after[k].n, q := k * k + after[k].q),
                                       struct_pack(a := d.cost + after[k].cost, b := -k)),
                                any_value(after)[1:(SELECT most FROM m)])
            FROM (SELECT *, unnest(range(1, CAST(least(len(run) - i + 1, (SELECT most FROM m)) AS BIGINT) + 1)) AS k FROM walk WHERE i > 0) w
            JOIN d ON d.word = substr(w.run, w.i, w.k)
            GROUP BY conv_id, turn, i)
        SELECT conv_id, turn, after[1].n AS n, after[1].q AS squares FROM walk WHERE i = 0""",
    "unclean_tokens": f"""
        WITH t AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), '[\\x{{4e00}}-\\x{{9fa5}}]|[\\p{{L}}\\p{{N}}]+|[^{SPACE}]') AS w
                   FROM pages)
        SELECT page_id, len(w) AS n, md5(array_to_string(w, ' ')) AS digest FROM t""",
    "all_metrics": f"""
        WITH {ANSWERS}, placed AS (
          SELECT model, dataset, is_correct, predicted_answer,
                 ascii(correct_answer) - 64 AS g, ascii(predicted_answer) - 64 AS p FROM results)
        SELECT model, dataset, round(count(*) FILTER (is_correct) / count(*), 6) AS overall,
               count(*) FILTER (is_correct) AS correct_count, count(*) AS total_count,
               round(avg(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END), 6) AS recall_1,
               round(avg(CASE WHEN is_correct OR near THEN 1.0 ELSE 0.0 END), 6) AS recall_2,
               round(avg(CASE WHEN is_correct THEN 1.0 WHEN near THEN 0.5 ELSE 1 / g END), 6) AS mrr
        FROM (SELECT *, predicted_answer <> 'UNKNOWN' AND abs(g - p) <= 1 AS near FROM placed) GROUP BY model, dataset""",
    "hashed_vectors": """
        SELECT vec_id, sha256('{"embedding": [' || array_to_string(list_transform(embedding, lambda x: CAST(CAST(x AS DOUBLE) AS VARCHAR)), ', ')
                              || '], "vec_id": ' || vec_id || '}') AS hash
        FROM embeddings""",
}
