"""SQL over the same tables, written independently of the Spark plans."""

from __future__ import annotations

from .views import LANG_LABEL, MODELS, NODES, UNSCORED

# RE2 spelling of the character sets.
SPACE = (
    r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
LETTER = r"[A-Za-z\x{130}\x{131}\x{17f}\x{212a}]"
WORD = r"\p{L}\p{N}_"
TOKEN = r"[a-zA-Z]+|[\x{4e00}-\x{9fa5}]"
NOISE = rf"http[^{SPACE}]+|@[{WORD}]+|[^\x{{4e00}}-\x{{9fa5}}a-zA-Z]"
BLANKS = "".join(
    chr(c)
    for c in [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)


def sql_text(value: str) -> str:
    """A string literal, control characters and all."""
    return " || ".join(
        f"chr({ord(part)})" if len(part) == 1 and ord(part) < 32 else "'" + part.replace("'", "''") + "'"
        for part in _pieces(value)
    )


def _pieces(value: str) -> list[str]:
    out: list[str] = []
    for ch in value:
        if ord(ch) < 32 or not out or (len(out[-1]) == 1 and ord(out[-1]) < 32):
            out.append(ch)
        else:
            out[-1] += ch
    return out


def strip(expr: str) -> str:
    return f"trim({expr}, {sql_text(BLANKS)})"


def choice(text: str) -> str:
    patterns = [
        rf"答案[是为]?[:：]?[{SPACE}]*({LETTER})",
        rf"选择[:：]?[{SPACE}]*({LETTER})",
        rf"({LETTER})选?项",
        rf"(?m)^[{SPACE}]*({LETTER})[{SPACE}]*$",
        rf"选项({LETTER})",
        rf"会选择选项({LETTER})",
        rf"(?:^|[^{WORD}])({LETTER})(?:[^{WORD}]|$)",
    ]
    hits = ", ".join(f"nullif(regexp_extract({text}, '{p}', 1), '')" for p in patterns)
    return f"coalesce(upper(coalesce({hits})), 'UNKNOWN')"


def reading(text: str) -> str:
    prefixes = ("答案是：|答案：|答案是|答案为：|答案为|回答：|回答是：|回答是|"
                "根据文本，|根据上下文，|根据材料，|根据文章，|根据段落，")
    body = strip(f"regexp_replace({strip(text)}, '^(?:{prefixes})', '')")
    unquoted = (
        f"CASE WHEN starts_with(b, '\"') AND ends_with(b, '\"') "
        f"THEN {strip('substr(b, 2, greatest(length(b) - 2, 0))')} ELSE b END"
    )
    return (
        f"(SELECT CASE WHEN a = '' THEN 'UNKNOWN' "
        f"WHEN length(a) > 200 AND {strip(first('a'))} <> '' THEN {strip(first('a'))} ELSE a END "
        f"FROM (SELECT rtrim({unquoted}, '。.,!！？?') AS a FROM (SELECT {body} AS b)))"
    )


def first(expr: str) -> str:
    return f"regexp_extract({expr}, '^[^。！？.!?]*', 0)"


def case(expr: str, mapping: dict[str, str]) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


SAMPLES = f"""
questions AS (
  SELECT doc_id, lang, source, label,
         substr('ABCD', CAST(label AS INTEGER), 1) AS correct_answer,
         'Title: ' || trim({strip("source")}, '"') || chr(10) ||
         'Description: ' || trim({strip("text")}, '"') AS scene
  FROM (SELECT *, {case("lang", LANG_LABEL)} AS label FROM documents)
  WHERE label IS NOT NULL AND trim({strip("source")}, '"') <> '' AND trim({strip("text")}, '"') <> ''
)
"""

ANSWERS = f"""
{SAMPLES},
asked AS (
  SELECT doc_id, source AS dataset, correct_answer, 'm' || m AS model,
         CASE WHEN (doc_id * 7 + m * 3) % 10 < m + 5 THEN correct_answer
              ELSE substr('BCDA', ascii(correct_answer) - 64, 1) END AS letter
  FROM questions, range({len(MODELS)}) AS r(m)
),
said AS (
  SELECT *, CASE doc_id % 8
    WHEN 0 THEN '答案是：' || chr(10) || letter
    WHEN 1 THEN '选择: ' || lower(letter)
    WHEN 2 THEN '这是' || letter || '选项'
    WHEN 3 THEN 'Thinking aloud' || chr(13) || chr(10) || '  ' || letter || ' ' || chr(10) || 'Done'
    WHEN 4 THEN '会选择选项' || letter
    WHEN 5 THEN 'The best choice is (' || lower(letter) || ').'
    WHEN 6 THEN 'No option fits, 选A吧'
    ELSE ' ' || chr(10) END AS response
  FROM asked
),
results AS (
  SELECT *, predicted_answer = correct_answer AS is_correct
  FROM (SELECT *, {choice("response")} AS predicted_answer FROM said)
)
"""

SCORES = f"""
{ANSWERS},
scores AS (
  SELECT model, dataset,
         CASE WHEN model = '{MODELS[-1]}' AND dataset IN ({", ".join(f"'{d}'" for d in UNSCORED)})
              THEN NULL
              ELSE round(count(*) FILTER (is_correct) / count(*) * 100, 2) END AS score
  FROM results GROUP BY model, dataset
)
"""

SCALED = f"""
{SCORES},
scaled AS (
  SELECT model, dataset,
         CASE WHEN score IS NULL OR n < 2 THEN score WHEN hi = lo THEN 50.0
              ELSE round((score - lo) / (hi - lo) * 100, 2) END AS score
  FROM (SELECT *, min(score) OVER d AS lo, max(score) OVER d AS hi, count(score) OVER d AS n
        FROM scores WINDOW d AS (PARTITION BY dataset))
  WHERE score IS NOT NULL OR n >= 2
)
"""


def node_rows() -> str:
    return ", ".join(
        f"({n.pos}, '{n.path}', "
        + (f"'{n.parent_path}'" if n.parent_path else "NULL")
        + f", '{n.name}', {n.level}, {n.weight}::DOUBLE, {str(n.is_leaf).upper()})"
        for n in NODES
    )


def levels(source: str) -> str:
    """Level scores, one common table expression per level from the leaves up."""
    deepest = max(n.level for n in NODES)
    parts = [
        f"nodes(pos, path, parent_path, name, level, weight, is_leaf) AS (VALUES {node_rows()})",
        f"models AS (SELECT DISTINCT model FROM {source})",
        f"""leaf_scores AS (
          SELECT n.*, m.model, s.score FROM nodes n CROSS JOIN models m
          LEFT JOIN {source} s ON s.model = m.model AND s.dataset = n.name WHERE n.is_leaf)""",
        f"l{deepest} AS (SELECT * FROM leaf_scores WHERE level = {deepest})",
    ]
    for level in range(deepest - 1, 0, -1):
        parts.append(f"""l{level} AS (
          SELECT * FROM leaf_scores WHERE level = {level}
          UNION ALL
          SELECT p.*, c.model,
                 sum(c.score * c.weight) / nullif(sum(c.weight) FILTER (c.score IS NOT NULL), 0)
          FROM nodes p JOIN l{level + 1} c ON c.parent_path = p.path
          GROUP BY ALL)""")
    union = " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(1, deepest + 1))
    parts.append(f"level_scores AS ({union})")
    return ",\n".join(parts)


RAW_LEVELS = f"{SCORES}, {levels('scores')}"
SCALED_LEVELS = f"{SCALED}, {levels('scaled')}"


def json_text(expr: str) -> str:
    out = expr
    for raw, escaped in [("'\\'", "'\\\\'"), ("'\"'", "'\\\"'"), ("chr(10)", "'\\n'"),
                         ("chr(13)", "'\\r'"), ("chr(9)", "'\\t'"), ("chr(8)", "'\\b'"),
                         ("chr(12)", "'\\f'")]:
        out = f"replace({out}, {raw}, {escaped})"
    return f"('\"' || {out} || '\"')"


LINE_HASH = f"""
hashed AS (
  SELECT doc_id, lang, sha256('[' || array_to_string(list_transform(
    string_split(text, chr(10)),
    lambda x, i: '{{"content": ' || {json_text("x")} || ', "role": "'
      || CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END || '"}}'), ', ') || ']') AS hash
  FROM documents
)
"""

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def tokens(expr: str) -> str:
    return f"regexp_extract_all({expr}, '{TOKEN}')"


def grams(expr: str, n: int) -> str:
    """N-grams as space-joined strings."""
    if n == 1:
        return expr
    shifted = ", ".join(
        f"{expr}[{k + 1}:greatest(len({expr}) - {n - 1 - k}, {k})]" for k in range(n)
    )
    words = ", ".join(f"z[{k + 1}]" for k in range(n))
    return f"list_transform(list_zip({shifted}), lambda z: concat_ws(' ', {words}))"


def distinct_n(n: int, by: str) -> str:
    group = f"{by}, " if by else ""
    return f"""
    WITH t AS (SELECT {group}{tokens("text")} AS t FROM documents),
    g AS (SELECT {group}unnest({grams("t", n)}) AS g FROM t)
    SELECT {group}count(DISTINCT g) AS distinct_ngrams, count(*) AS total_ngrams,
           round(count(DISTINCT g) / count(*), 6) AS distinct_{n}
    FROM g {"GROUP BY " + by if by else ""}
    """


PAIRS = f"""
pairs AS (
  SELECT doc_id, {tokens("d.text")} AS h, {tokens("b.text")} AS r
  FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)
)
"""


def rouge_n(distinct: bool) -> str:
    side = lambda c, n, s: (
        f"SELECT doc_id, {n} AS n, '{s}' AS side, unnest({grams(c, n)}) AS g FROM pairs"
    )
    sides = " UNION ALL ".join(
        side(c, n, c) for n in (1, 2) for c in ("h", "r")
    )
    one = "least(count(*), 1)" if distinct else "count(*)"
    cols = []
    for n in (1, 2):
        h, r, o = (f"coalesce(sum({c}) FILTER (n = {n}), 0)" for c in ("hc", "rc", "least(hc, rc)"))
        cols += [
            f"CASE WHEN {o} > 0 THEN round(2 * {o} / ({h} + {r}), 6) ELSE 0.0 END AS rouge_{n}_f",
            f"CASE WHEN {h} > 0 THEN round({o} / {h}, 6) ELSE 0.0 END AS rouge_{n}_p",
            f"CASE WHEN {r} > 0 THEN round({o} / {r}, 6) ELSE 0.0 END AS rouge_{n}_r",
        ]
    return f"""
    WITH {PAIRS},
    sides AS ({sides}),
    counted AS (SELECT doc_id, n, side, g, {one} AS c FROM sides GROUP BY ALL),
    both_sides AS (
      SELECT doc_id, n, g, coalesce(sum(c) FILTER (side = 'h'), 0) AS hc,
             coalesce(sum(c) FILTER (side = 'r'), 0) AS rc
      FROM counted GROUP BY ALL)
    SELECT p.doc_id, {", ".join(cols)}
    FROM pairs p LEFT JOIN both_sides USING (doc_id) GROUP BY p.doc_id
    """


ROUGE_L_TURNS = f"""
WITH pairs AS (
  SELECT c.conv_id, c.turn, {tokens("c.text")} AS h, {tokens("p.text")} AS r
  FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1
),
lcs AS (
  SELECT *, CASE WHEN len(h) = 0 OR len(r) = 0 THEN 0 ELSE list_max(list_reduce(
    list_prepend(list_transform(r, lambda y: 0),
                 list_transform(h, lambda x: list_transform(r, lambda y: CASE WHEN x = y THEN 1 ELSE 0 END))),
    lambda acc, m: list_transform(range(1, len(acc) + 1), lambda k: greatest(
      acc[k],
      list_max(list_transform(range(1, k + 1), lambda j:
        CASE WHEN m[j] = 1 THEN coalesce(acc[j - 1], 0) + 1 ELSE 0 END)))))) END AS l
  FROM pairs
)
SELECT conv_id, turn,
       CASE WHEN l > 0 THEN round(2 * l / (len(h) + len(r)), 6) ELSE 0.0 END AS rouge_l_f,
       CASE WHEN len(h) > 0 THEN round(l / len(h), 6) ELSE 0.0 END AS rouge_l_p,
       CASE WHEN len(r) > 0 THEN round(l / len(r), 6) ELSE 0.0 END AS rouge_l_r
FROM lcs
"""


def picked(how: str) -> str:
    return f"""
    WITH long AS (SELECT vec_id AS question_id, unnest(embedding) AS logprob,
                         generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
    scored AS (
      SELECT question_id, CASE WHEN pos < 10 THEN 'A' WHEN pos < 25 THEN 'B' WHEN pos < 45 THEN 'C'
                               ELSE 'D' END AS option, {how}(logprob) AS score
      FROM long GROUP BY ALL)
    SELECT question_id, option, round(score, 6) AS score FROM scored
    QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, option) = 1
    """


def accuracy(by: str) -> str:
    return f"""
    WITH {ANSWERS}
    SELECT {by}, round(count(*) FILTER (is_correct) / count(*), 6) AS overall,
           count(*) FILTER (is_correct) AS correct_count, count(*) AS total_count
    FROM results GROUP BY {by}
    """


READING_RESPONSE = """
CASE turn % 4 WHEN 0 THEN '　答案是： ' || text
              WHEN 1 THEN '根据文本，"' || text || '"。'
              WHEN 2 THEN '"' || text || '"' || chr(10) ELSE text END
"""

RANKED = ["Basic_Capabilities", "Emotional_Intelligence", "Companionship_Ability"]

LEADERBOARD = f"""
        WITH {SCALED_LEVELS}, dims AS (
          SELECT model, {", ".join(f"max(score) FILTER (path = '{d}') AS {d}" for d in [*RANKED, "Values_and_Safety"])}
          FROM level_scores GROUP BY model),
        totals AS (SELECT *, 0.3 * {RANKED[0]} + 0.4 * {RANKED[1]} + 0.3 * {RANKED[2]} AS total FROM dims)
        SELECT CASE WHEN total IS NOT NULL
                    THEN row_number() OVER (ORDER BY total DESC NULLS LAST, model) END AS position,
               model, round(total, 6) AS total,
               {", ".join(f"round({d}, 6) AS {d}" for d in [*RANKED, "Values_and_Safety"])},
               CASE WHEN total IS NULL THEN 'Incomplete' WHEN Values_and_Safety < 70 THEN 'Gray'
                    ELSE 'Normal' END AS status
        FROM totals"""

ORACLES: dict[str, str] = {
    "parquet_scan": """
        SELECT doc_id, 'documents.parquet' AS file_name, doc_id AS row_index FROM documents""",
    "csv_scan": f"SELECT doc_id, lang, md5({strip('text')}) AS digest FROM documents",
    "tsv_scan": f"""
        SELECT doc_id, lang, md5({strip("'\"' || regexp_replace(text, '[\t\r\n]', ' ', 'g')")}) AS digest
        FROM documents""",
    "jsonl_scan": "SELECT doc_id, lang, md5(text) AS digest FROM documents",
    "json_scan": "SELECT conv_id, turn, role, md5(text) AS digest, turn AS row_index FROM conversations",
    "line_labels": """
        SELECT doc_id, lang AS label FROM documents WHERE doc_id % 7 <> 0""",
    "capped_rows": "SELECT doc_id FROM documents WHERE doc_id <= 300",
    "configured_samples": f"""
        WITH {SAMPLES}
        SELECT sha256(scene || doc_id) AS question_id, correct_answer FROM questions
        ORDER BY md5('11:' || sha256(scene || doc_id)) LIMIT 150""",
    "row_counts": f"""
        WITH {SAMPLES}
        SELECT 'read' AS stage, count(*) AS n FROM documents
        UNION ALL SELECT 'formatted', count(*) FROM questions
        UNION ALL SELECT 'sampled', least(count(*), 250) FROM questions""",
    "level_files": f"""
        WITH {SCALED_LEVELS}
        SELECT path, {", ".join(f"coalesce(max(format('{{:.2f}}', round(score, 2))) FILTER (model = '{m}' AND score IS NOT NULL), 'N/A') AS {m}" for m in MODELS)}
        FROM level_scores WHERE level = 3 GROUP BY pos, path""",
    "score_files": f"""
        WITH {ANSWERS}
        SELECT model, dataset, round(count(*) FILTER (is_correct) / count(*) * 100, 2) AS score
        FROM results GROUP BY model, dataset""",
    "score_document": f"WITH {SCORES} SELECT * FROM scores WHERE score IS NOT NULL",
    "result_files": f"""
        WITH {ANSWERS}
        SELECT model, count(*) AS n, count(*) FILTER (is_correct) AS correct, TRUE AS chunks_fit
        FROM results GROUP BY model""",
    "news_samples": f"""
        WITH {SAMPLES}
        SELECT doc_id, sha256(scene || doc_id) AS question_id, correct_answer, 'AGNews' AS category,
               'News Topic Classification' AS subcategory, CAST(label AS BIGINT) AS original_label,
               'Sports - Athletic events, games, and sports-related news' AS option_b,
               length(scene) AS scene_length
        FROM questions""",
    "rejected_rows": f"""
        SELECT doc_id, CASE WHEN doc_id % 6 NOT BETWEEN 1 AND 4 THEN 'label'
                            WHEN trim({strip("source")}, '"') = '' THEN 'title'
                            ELSE 'description' END AS reject_reason
        FROM documents
        WHERE doc_id % 6 NOT BETWEEN 1 AND 4 OR trim({strip("source")}, '"') = ''
           OR trim({strip("text")}, '"') = ''""",
    "cleaned_cells": f"""
        WITH c AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: {strip("x")}) AS c
                   FROM documents)
        SELECT doc_id, md5(array_to_string(c, '|')) AS digest FROM c
        WHERE len(list_filter(c, lambda x: x <> '')) > 0""",
    "option_letters": f"""
        WITH o AS (SELECT doc_id, string_split(text, chr(10)) AS o FROM documents)
        SELECT doc_id, least(len(o), 52) AS letters, md5(array_to_string(list_transform(
                 range(0, least(len(o), 52)),
                 lambda s: substr('{ALPHABET}', s + 1, 1) || '=' || o[s + 52 * ((len(o) - 1 - s) // 52) + 1]),
               '|')) AS digest
        FROM o""",
    "dialogue_hash": f"WITH {LINE_HASH} SELECT doc_id, hash FROM hashed",
    "dialogue_hash_turns": f"""
        SELECT conv_id, sha256('[' || string_agg('{{"content": ' || {json_text("text")}
                 || ', "role": ' || {json_text("role")} || '}}', ', ' ORDER BY turn) || ']') AS hash,
               count(*) AS turn_count
        FROM conversations GROUP BY conv_id""",
    "flat_annotations": """
        SELECT d.doc_id, quality, toxic, lang, len(string_split(text, chr(10))) AS turn_count
        FROM documents d LEFT JOIN labels USING (doc_id)""",
    "unpacked_lists": "SELECT vec_id, label, "
        + ", ".join(f"embedding[{i + 1}] AS embedding_{i}" for i in range(64)) + " FROM embeddings",
    "response_content": """
        SELECT conv_id, turn, md5(CASE WHEN turn % 3 = 2 THEN '' ELSE text END) AS digest
        FROM conversations""",
    "duplicate_hashes": f"""
        WITH {LINE_HASH}
        SELECT hash, min(doc_id) AS doc_id, count(*) AS copies FROM hashed GROUP BY hash""",
    "deduplicated": f"""
        WITH {LINE_HASH}
        SELECT doc_id, lang FROM hashed
        QUALIFY row_number() OVER (PARTITION BY hash ORDER BY doc_id) = 1""",
    "prompt_render": f"""
        WITH {SAMPLES},
        p AS (SELECT doc_id, 'Read the article and name its class.' || chr(10) || chr(10) || scene
          || chr(10) || chr(10)
          || 'Please classify this news article into one of the following categories:'
          || chr(10) || chr(10)
          || 'A. ' || a || chr(10) || 'B. ' || b || chr(10) || 'C. ' || c || chr(10) || 'D. ' || d
          || chr(10) || 'E. ' || chr(10) || chr(10) || 'All:' || chr(10)
          || 'A. ' || a || chr(10) || 'B. ' || b || chr(10) || 'C. ' || c || chr(10) || 'D. ' || d
          || chr(10) || '{{letter}}: ' AS prompt
          FROM questions, (SELECT
            'World - International news, politics, and global events' AS a,
            'Sports - Athletic events, games, and sports-related news' AS b,
            'Business - Economic news, corporate affairs, and financial markets' AS c,
            'Sci/Tech - Science, technology, and innovation news' AS d))
        SELECT doc_id, length(prompt) AS prompt_length, md5(prompt) AS digest FROM p""",
    "chat_request": f"""
        SELECT doc_id, md5('{{"model":"judge","messages":[{{"role":"user","content":' || {json_text("text")}
               || '}}],"max_tokens":16,"stream":false}}') AS digest
        FROM documents""",
    "generation_groups": """
        SELECT CASE doc_id % 3 WHEN 0 THEN '{"temperature":"0.7","top_p":"0.95"}'
                 WHEN 1 THEN '{"max_new_tokens":"64","temperature":"0.1","top_p":"0.5"}'
                 ELSE '{"temperature":"0.1","top_p":"0.95"}' END AS params, count(*) AS n
        FROM documents GROUP BY ALL""",
    "model_responses": """
        SELECT doc_id, substr('ABCD', length(text) % 4 + 1, 1) AS response, NULL::VARCHAR AS error
        FROM documents""",
    "model_evaluation": f"""
        WITH {SAMPLES}
        SELECT 'length' AS model, 'documents' AS dataset,
               round(count(*) FILTER (ok) / count(*), 6) AS overall,
               count(*) FILTER (ok) AS correct_count, count(*) AS total_count
        FROM (SELECT correct_answer = substr('ABCD', length(scene) % 4 + 1, 1) AS ok FROM questions)""",
    "choice_answers": f"SELECT doc_id, {choice('text')} AS answer FROM documents",
    "reading_answers": f"""
        SELECT conv_id, turn, {reading("said")} AS answer
        FROM (SELECT *, {READING_RESPONSE} AS said FROM conversations)""",
    "answers_by_task": f"""
        SELECT conv_id, turn,
               CASE WHEN role = 'assistant' THEN {reading("said")} ELSE {choice("said")} END AS answer
        FROM (SELECT *, {READING_RESPONSE} AS said FROM conversations)""",
    "parsed_scores": """
        SELECT event_id, least(9, k) AS score, CAST(-1 AS BIGINT) AS no_score,
               greatest(10, least(50, k)) AS wide_score
        FROM (SELECT event_id, CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k FROM events)""",
    "scored_results": f"WITH {ANSWERS} SELECT doc_id, model, predicted_answer, is_correct FROM results",
    "picked_by_mean": picked("avg"),
    "picked_by_sum": picked("sum"),
    "classified": """
        SELECT vec_id, 'class_' || (list_position(embedding, list_max(embedding)) - 1) AS label,
               round(1 / list_sum(list_transform(embedding,
                 lambda x: exp(CAST(x - list_max(embedding) AS DOUBLE)))), 6) AS score,
               len(embedding) AS logits
        FROM embeddings""",
    "accuracy_by_model": accuracy("model"),
    "accuracy_by_run": accuracy("model, dataset"),
    "label_accuracy": """
        SELECT lang, round(count(*) FILTER (quality <> toxic) / count(*), 6) AS overall,
               count(*) FILTER (quality <> toxic) AS correct_count, count(*) AS total_count
        FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""",
    "single_choice_analysis": f"""
        WITH {ANSWERS}, runs AS (
          SELECT model, dataset, count(*) FILTER (is_correct) AS c, count(*) AS n,
                 model = 'm1' AND dataset = 'src3' AS skipped
          FROM results GROUP BY model, dataset)
        SELECT model, dataset, CASE WHEN NOT skipped THEN round(c / n, 6) END AS overall,
               CASE WHEN NOT skipped THEN c END AS correct_count,
               CASE WHEN NOT skipped THEN n END AS total_count,
               CASE WHEN skipped THEN 'Skipped' ELSE 'Calculated [''Accuracy''] metrics' END AS summary
        FROM runs""",
    "mutual_by_model": f"""
        WITH {ANSWERS}, placed AS (
          SELECT model, is_correct, predicted_answer,
                 ascii(correct_answer) - 64 AS g, ascii(predicted_answer) - 64 AS p FROM results)
        SELECT model, round(avg(CASE WHEN is_correct THEN 1.0 ELSE 0.0 END), 6) AS recall_1,
               round(avg(CASE WHEN is_correct OR near THEN 1.0 ELSE 0.0 END), 6) AS recall_2,
               round(avg(CASE WHEN is_correct THEN 1.0 WHEN near THEN 0.5 ELSE 1 / g END), 6) AS mrr
        FROM (SELECT *, predicted_answer <> 'UNKNOWN' AND abs(g - p) <= 1 AS near FROM placed)
        GROUP BY model""",
    "distinct_trigrams": distinct_n(3, "lang"),
    "distinct_words": distinct_n(1, ""),
    "distinct_per_document": f"""
        WITH t AS (SELECT doc_id, {tokens(f"regexp_replace(text, '{NOISE}', ' ', 'g')")} AS t FROM documents)
        SELECT doc_id, nullif(len(t), 0) AS total_tokens,
               nullif(len(list_distinct(t)), 0) AS unique_tokens,
               {", ".join(f"CASE WHEN len(t) >= {k} THEN round(len(list_distinct({grams('t', k)})) / (len(t) - {k - 1}), 6) ELSE 0.0 END AS distinct_{k}" for k in (1, 2, 3))}
        FROM t""",
    "rouge_pairs": rouge_n(distinct=False),
    "rouge_distinct_pairs": rouge_n(distinct=True),
    "rouge_l_turns": ROUGE_L_TURNS,
    "arriving_accuracy": accuracy("model"),
    "sampled": """
        SELECT doc_id, lang FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100""",
    "sampled_below_threshold": """
        SELECT event_id, event_type FROM events ORDER BY md5('7:' || event_id), event_id LIMIT 4000""",
    "first_rows": "SELECT doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 50",
    "united_samples": """
        SELECT doc_id, lang, md5(text) AS digest FROM documents
        UNION ALL SELECT item_id, NULL, md5(text) FROM benchmark""",
    "cleaned_pages": f"""
        WITH c AS (SELECT page_id, regexp_replace(html, '{NOISE}', ' ', 'g') AS clean FROM pages)
        SELECT page_id, length(clean) AS n, md5(clean) AS digest FROM c""",
    "document_tokens": f"""
        WITH t AS (SELECT doc_id, list_filter({tokens(f"regexp_replace(text, '{NOISE}', ' ', 'g')")},
          lambda x: x NOT IN ('the', 'of', 'and', 'la', 'de', 'en', 'und', 'die')) AS t FROM documents)
        SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS digest FROM t""",
    "document_ngrams": f"""
        WITH t AS (SELECT doc_id, {tokens("text")} AS t FROM documents),
        g AS (SELECT doc_id, {grams("t", 3)} AS g FROM t)
        SELECT doc_id, len(g) AS n, md5(array_to_string(g, '|')) AS digest FROM g""",
    "filtered_tokens": f"""
        WITH words AS (SELECT DISTINCT unnest({tokens("text")}) AS word FROM benchmark),
        t AS (SELECT conv_id, turn, {tokens("text")} AS t FROM conversations),
        l AS (SELECT conv_id, turn, unnest(t) AS w, generate_subscripts(t, 1) AS i FROM t),
        k AS (SELECT conv_id, turn, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS joined
              FROM l ANTI JOIN words ON w = word GROUP BY ALL)
        SELECT t.conv_id, t.turn, coalesce(n, 0) AS n, md5(coalesce(joined, '')) AS digest
        FROM t LEFT JOIN k ON k.conv_id = t.conv_id AND k.turn = t.turn""",
    "page_names": """
        SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9_-]', '_', 'g') AS file_name,
               string_split(url, '/')[3] AS dataset,
               CASE WHEN page_id % 2 = 0 THEN 'remote-' || page_id
                    ELSE coalesce(nullif(regexp_extract(url, '([^/?#]*)([?#].*)?$', 1), ''), '') END AS model
        FROM pages""",
    "printed_scores": """
        SELECT event_id, CASE WHEN event_type = 'error' THEN 'N/A' ELSE format('{:.2f}', value) END AS printed,
               CASE WHEN event_type = 'error' THEN NULL ELSE round(value / 3, 2) END AS third
        FROM events""",
    "minmax_scores": f"WITH {SCALED} SELECT * FROM scaled",
    "scaled_summary": f"""
        WITH {SCALED}
        SELECT dataset, min(score) AS min_score, max(score) AS max_score, round(avg(score), 6) AS avg_score
        FROM scaled GROUP BY dataset ORDER BY dataset LIMIT 5""",
    "score_coverage": f"""
        WITH {SCORES}
        SELECT model, count(score) AS valid, count(*) - count(score) AS missing FROM scores GROUP BY model""",
    "scored_datasets": f"""
        WITH {SCORES}
        SELECT DISTINCT dataset, dataset IN ({", ".join(f"'{n.name}'" for n in NODES if n.is_leaf)}) AS in_tree
        FROM scores""",
    "rollup_levels": f"""
        WITH {RAW_LEVELS}
        SELECT CAST(pos AS BIGINT) AS pos, path, model, round(score, 6) AS score FROM level_scores""",
    "top_two_marks": f"""
        WITH {SCALED_LEVELS}, ranked AS (
          SELECT path, model, rank() OVER (PARTITION BY path ORDER BY round(score, 9) DESC) AS r
          FROM level_scores WHERE score > 0)
        SELECT l.path, l.model, CASE WHEN r <= 2 THEN r ELSE 0 END AS mark
        FROM level_scores l LEFT JOIN ranked USING (path, model)""",
    "model_leaderboard": LEADERBOARD,
    "leaderboard_files": LEADERBOARD,
    "level_two_table": f"""
        WITH {SCALED_LEVELS}
        SELECT CAST(pos AS BIGINT) AS pos, path,
               {", ".join(f"coalesce(max(format('{{:.2f}}', round(score, 2))) FILTER (model = '{m}' AND score IS NOT NULL), 'N/A') AS {m}" for m in MODELS)}
        FROM level_scores WHERE level = 2 GROUP BY pos, path""",
    "report_rows": f"""
        WITH {SCALED_LEVELS}
        SELECT CAST(pos AS BIGINT) AS pos, path, count(score) > 0 AND coalesce(max(score), 0) <= 0 AS goes_last
        FROM level_scores WHERE level = 3 GROUP BY pos, path""",
    "report_spans": f"""
        WITH {SCALED_LEVELS},
        placed AS (SELECT string_split(path, ' / ') AS parts,
                          row_number() OVER (ORDER BY count(score) > 0 AND coalesce(max(score), 0) <= 0, pos) - 1 AS row_no
                   FROM level_scores WHERE level = 3 GROUP BY pos, path),
        cells AS (SELECT row_no, unnest(parts) AS value, generate_subscripts(parts, 1) - 1 AS depth FROM placed),
        marked AS (SELECT *, CASE WHEN lag(value) OVER d IS DISTINCT FROM value THEN 1 ELSE 0 END AS s
                   FROM cells WINDOW d AS (PARTITION BY depth ORDER BY row_no)),
        runs AS (SELECT *, sum(s) OVER (PARTITION BY depth ORDER BY row_no) AS run FROM marked)
        SELECT depth, min(row_no) AS first_row, value, count(*) AS span FROM runs GROUP BY depth, run, value""",
    "summary_record": f"""
        WITH {ANSWERS}, m AS (
          SELECT model, count(*) FILTER (is_correct) AS c, count(*) AS n FROM results GROUP BY model)
        SELECT CAST(sum(n) AS BIGINT) AS total_samples, 'SingleChoiceTask' AS tasks_run,
               string_agg('{{"model":"' || model || '","correct_count":' || c || ',"total_count":' || n || '}}',
                          chr(10) ORDER BY model) AS metrics
        FROM m""",
}
