import math
import random
import re

import pytest
from pyspark.sql import functions as F

from gradeflow.functions import answers, canonical, logits, prompts, text


def column(spark, values, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"i long, v {kind}")


def apply(spark, values, fn, kind="string"):
    out = column(spark, values, kind).select("i", fn(F.col("v")).alias("r")).collect()
    return [r["r"] for r in sorted(out, key=lambda r: r["i"])]


def random_texts(pieces, count, longest, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(pieces) for _ in range(rng.randrange(longest))) for _ in range(count)]


# The answer patterns as Python reads them.
PYTHON_PATTERNS = [
    r"答案[是为]?[:：]?\s*([A-Z])", r"选择[:：]?\s*([A-Z])", r"([A-Z])选?项", r"^\s*([A-Z])\s*$",
    r"选项([A-Z])", r"会选择选项([A-Z])", r"\b([A-Z])\b",
]


def expected_choice(value):
    for pattern in PYTHON_PATTERNS:
        found = re.search(pattern, value or "", re.I | re.M)
        if found:
            return found.group(1).upper()
    return "UNKNOWN"


def test_extract_choice_agrees_with_python_on_odd_texts(spark):
    pieces = ["答案", "是", "为", "：", ":", "选择", "选", "项", "会选择选项", " ", "\n", "\r\n", "\r",
              "\u3000", "\x85", "\u2028", "\x1c", "a", "B", "ſ", "K", "ı", "é", "9", "_", "-", ".",
              "吧", "word", "\u0301", "²", "٣"]
    values = random_texts(pieces, 1500, 9, seed=1) + [
        "", None, "   ", "选A吧", "答案是：b", "C选项", "it is a B", "x\r\nD", "D\n", "a_b", "(c)", "é",
    ]
    assert apply(spark, values, answers.extract_choice) == [expected_choice(v) for v in values]


def test_extract_choice_keeps_the_article_as_an_answer(spark):
    assert apply(spark, ["it is a B"], answers.extract_choice) == ["A"]


def test_strip_agrees_with_python(spark):
    pieces = ["\t", "\n", "\x0b", "\x1c", "\x1f", " ", "\x85", "\xa0", "\u1680", "\u2007", "\u2028",
              "\u202f", "\u205f", "\u3000", "\u200b", "x", "é"]
    values = random_texts(pieces, 300, 7, seed=2)
    assert apply(spark, values, text.strip) == [v.strip() for v in values]


@pytest.mark.parametrize("raw, want", [
    ("答案是：北京。", "北京"),
    ("答案是北京", "北京"),
    ("答案为：上海！！", "上海"),
    ("根据文本， “x”", "“x”"),
    ('回答："quoted text"', "quoted text"),
    ('"both sides".', '"both sides"'),
    ('"', "UNKNOWN"),
    ("回答：回答：twice", "回答：twice"),
    ("", "UNKNOWN"), (None, "UNKNOWN"), (" \u3000", "UNKNOWN"), ("。。", "UNKNOWN"),
    ("答案：", "UNKNOWN"),
    ("a" * 150 + ". " + "b" * 100, "a" * 150),
    ("." + "b" * 250, "." + "b" * 250),
    ("b" * 200 + "!", "b" * 200),
])
def test_extract_reading(spark, raw, want):
    assert apply(spark, [raw], answers.extract_reading) == [want]


def test_extract_answer_dispatches_per_row(spark):
    df = spark.createDataFrame(
        [(1, "答案是：b", "choice"), (2, "答案是：b", "reading_comprehension"), (3, "答案是：b", None)],
        "i long, v string, t string",
    )
    out = df.orderBy("i").select(answers.extract_answer(F.col("v"), F.col("t")).alias("r")).collect()
    assert [r["r"] for r in out] == ["B", "b", "B"]


def test_parse_score(spark):
    values = ["8", "score: 12", "-5", "none", "", None, "3.9", "9" * 60, "００７ points", "٣", "x0y4"]
    want = [8, 9, 5, -1, -1, -1, 3, 9, 7, 3, 0]
    assert apply(spark, values, answers.parse_score) == want
    assert apply(spark, ["3", "70"], lambda c: answers.parse_score(c, 10, 50)) == [10, 50]


def test_extract_content(spark):
    values = [
        "plain", None, '{"choices":[{"message":{"content":"hi"}}]}', '{"error":"timeout"}',
        '{"error":null,"choices":[{"message":{"content":"ok"}}]}', '{"error":{"code":1},"choices":[]}',
        '{"choices":[]}', '{"choices":[{"message":{}}]}', "{not json", '{"other":1}',
        '{"error":"","choices":[{"message":{"content":"fine"}}]}',
        '{"choices":[{"message":{"content":"hi"}}]} and more text', ' {"error":"e"}\n',
    ]
    want = ["plain", "", "hi", "", "ok", "", "", "", "{not json", '{"other":1}', "fine",
            '{"choices":[{"message":{"content":"hi"}}]} and more text', ""]
    assert apply(spark, values, answers.extract_content) == want


def test_clean_text_agrees_with_python(spark):
    pieces = ["http://a.b/ç ", "https://x\n", "@name_9é", "@", "http", "词", "a", "Z", "é", "1", ".",
              " ", "\u3000", "\x1c", "_", "²"]
    values = random_texts(pieces, 400, 8, seed=3)
    want = [re.sub(r"http\S+|@\w+|[^\u4e00-\u9fa5a-zA-Z]", " ", v) for v in values]
    assert apply(spark, values, text.clean_text) == want


def test_preprocess_blanks_links_and_drops_stop_words(spark):
    got = apply(spark, ["the cat http://the.cat @dog 看 the书 cat"],
                lambda c: text.preprocess(c, ["the", "书"]))
    assert got == [["cat", "看", "cat"]]
    cut = text.segmenter(lambda t: t.split(" "))
    got = apply(spark, ["the cat1 http://the.cat", None], lambda c: text.preprocess(c, ["the"], cut))
    assert got == [["cat"], []]


def test_ngrams(spark):
    values = [["a", "b", "c"], ["a"], []]
    got = apply(spark, values, lambda c: text.ngrams(c, 2), "array<string>")
    assert got == [[["a", "b"], ["b", "c"]], [], []]


def test_ngram_keys_tell_apart_any_tokens(spark):
    values = [["a\x1f", "b"], ["a", "\x1fb"]]
    keys = apply(spark, values, lambda c: text.ngram_keys(c, 2, plain=False), "array<string>")
    assert keys[0] != keys[1]


def test_small_scalars(spark):
    assert apply(spark, [1.0, None, 0.0, -3.456], text.format_score, "double") == [
        "1.00", "N/A", "0.00", "-3.46"]
    assert apply(spark, ["a b/ç-_9"], text.safe_name) == ["a_b__-_9"]
    assert apply(spark, ["AGNewsFormatter", "x_format", "plain", "", None], text.dataset_name) == [
        "AGNews", "x", "plain", "unknown_dataset", "unknown_dataset"]
    got = apply(spark, ["/a/b/model-7B", "", None], lambda c: text.model_name(F.lit(None), c, F.lit("k")))
    assert got == ["model-7B", "k", "k"]
    assert apply(spark, ["/a/b"], lambda c: text.model_name(F.lit("gpt"), c, F.lit("k"))) == ["gpt"]


def test_json_string_agrees_with_python(spark):
    import json

    values = ["".join(map(chr, range(0, 0x30))), "é词\u2028\x7f", '\\u000B "q"', ""]
    want = [json.dumps(v, ensure_ascii=False) for v in values]
    assert apply(spark, values, canonical.json_string) == want


def test_canonical_json_agrees_with_python(spark):
    import json

    value = [{"role": "user", "content": 'a "b"\n词', "n": 3, "ok": True, "tags": ["x", "y"]}]
    kind = "array<struct<role:string,content:string,n:int,ok:boolean,tags:array<string>>>"
    df = spark.createDataFrame([(value,)], f"v {kind}")
    got = df.select(canonical.canonical_json(F.col("v"), df.schema["v"].dataType)).first()[0]
    assert got == json.dumps(value, sort_keys=True, ensure_ascii=False)


def test_classify_logits(spark):
    rows = [[1.0, 3.0, 2.0], [5.0, 5.0], [1000.0, -1000.0]]
    got = apply(spark, rows, lambda c: logits.classify_logits(c, ["a", "b", "c"]), "array<double>")
    for values, out in zip(rows, got):
        top = max(values)
        assert out["label"] == "abc"[values.index(top)]
        assert math.isclose(out["score"], 1 / sum(math.exp(v - top) for v in values))
        assert out["logits"] == values


def test_render_prompt(spark):
    df = spark.createDataFrame(
        [("S", "Q", {"B": "two", "A": "one"}), (None, "Q2", {"A": "x"})],
        "scene string, question_text string, options map<string,string>",
    )
    template = "{scene}|{question}|{option_A}|{option_B}|{options}|{nothing}|{{kept}}"
    out = [r[0] for r in df.select(prompts.render_prompt(df, template)).collect()]
    assert sorted(out) == ["S|Q|one|two|A. one\nB. two||{kept}", "|Q2|x||A. x||{kept}"]


def test_chat_request_and_generation_key(spark):
    df = spark.createDataFrame([('say "hi"', {"top_p": "0.5"}), ("x", None)], "p string, o map<string,string>")
    body = df.select(prompts.to_chat_request(F.col("p"), "m", {"max_tokens": 5})).first()[0]
    assert body == '{"model":"m","messages":[{"role":"user","content":"say \\"hi\\""}],"max_tokens":5}'
    keys = [r[0] for r in df.select(
        prompts.generation_group_key({"top_p": "0.9", "a": "1"}, F.col("o"))).collect()]
    assert keys == ['{"a":"1","top_p":"0.5"}', '{"a":"1","top_p":"0.9"}']
    assert df.select(prompts.generation_group_key({}, F.col("o"))).collect()[1][0] == "{}"
