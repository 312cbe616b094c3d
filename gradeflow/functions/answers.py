"""Answer extraction from free text (R1-R4) and from response envelopes (F8)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from .chars import LETTER, SPACE, WORD
from .strict_json import parse_whole
from .text import ascii_digits, bind, strip

UNKNOWN = "UNKNOWN"

# The answer patterns, tried in this order, each with the text it cannot
# match without.
CHOICE_PATTERNS = (
    ("答案", rf"答案[是为]?[:：]?[{SPACE}]*({LETTER})"),
    ("选择", rf"选择[:：]?[{SPACE}]*({LETTER})"),
    ("项", rf"({LETTER})选?项"),
    ("", rf"(?:^|\n)[{SPACE}]*({LETTER})[{SPACE}]*(?:\n|\z)"),
    ("选项", rf"选项({LETTER})"),
    ("会选择选项", rf"会选择选项({LETTER})"),
    ("", rf"(?<![{WORD}])({LETTER})(?![{WORD}])"),
)

# Answer prefixes, in the order they are tried.
READING_PREFIXES = (
    "答案是：", "答案：", "答案是", "答案为：", "答案为",
    "回答：", "回答是：", "回答是",
    "根据文本，", "根据上下文，", "根据材料，", "根据文章，", "根据段落，",
)

# Punctuation dropped at the end, and sentence ends.
READING_TRAILING = "。.,!！？?"
SENTENCE_ENDS = "。！？.!?"
READING_LIMIT = 200


def extract_choice(response: Column) -> Column:
    """The letter found by the first pattern that matches, upper-cased, else UNKNOWN.

    A byte search for the pattern's fixed text spares most texts most patterns.
    """
    text = F.coalesce(response, F.lit(""))

    def hit(needle: str, pattern: str) -> Column:
        found = F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
        return F.when(text.contains(needle), found) if needle else found

    return F.coalesce(F.upper(F.coalesce(*[hit(*p) for p in CHOICE_PATTERNS])), F.lit(UNKNOWN))


def _unquote(text: Column) -> Column:
    quoted = text.startswith('"') & text.endswith('"')
    inner = F.substring(text, F.lit(2), F.greatest(F.char_length(text) - 2, F.lit(0)))
    return F.when(quoted, strip(inner)).otherwise(text)


def _first_sentence(text: Column) -> Column:
    first = strip(F.regexp_extract(text, f"^[^{SENTENCE_ENDS}]*", 0))
    return F.when((F.char_length(text) > READING_LIMIT) & (first != ""), first).otherwise(text)


def extract_reading(response: Column) -> Column:
    """R2: the answer text without prefix, quotes and trailing punctuation.

    An answer longer than 200 characters is reduced to its first sentence, which
    is the rule itself; nothing else shortens the text.
    """
    text = strip(F.coalesce(response, F.lit("")))
    prefix = "^(?:" + "|".join(READING_PREFIXES) + ")"
    body = strip(F.regexp_replace(text, F.lit(prefix), F.lit("")))
    bare = bind(body, lambda b: F.rtrim(_unquote(b), F.lit(READING_TRAILING)))
    answer = bind(bare, _first_sentence)
    return F.coalesce(F.nullif(answer, F.lit("")), F.lit(UNKNOWN))


def extract_answer(response: Column, task_type: Column | str = "choice") -> Column:
    """R2 for reading comprehension, R1 for every other task type, also per row."""
    kind = F.lit(task_type) if isinstance(task_type, str) else task_type
    return F.when(kind == "reading_comprehension", extract_reading(response)).otherwise(
        extract_choice(response)
    )


def parse_score(text: Column, lo: int = 0, hi: int = 9) -> Column:
    """First run of digits clamped to ``[lo, hi]``; -1 where there is none."""
    run = F.regexp_extract(F.coalesce(text, F.lit("")), r"\p{Nd}+", 0)
    # More than 38 digits do not fit a decimal, but are certainly above ``hi``.
    value = F.coalesce(ascii_digits(run).try_cast("decimal(38,0)"), F.lit(hi).cast("decimal(38,0)"))
    clamped = F.greatest(F.lit(lo), F.least(F.lit(hi), value)).cast("int")
    return F.when(run == "", F.lit(-1)).otherwise(clamped)


RESPONSE_SCHEMA = "error string, choices array<struct<message:struct<content:string>>>"


def extract_content(response: Column) -> Column:
    """F8: plain text as it is; a JSON envelope gives its first choice's content.

    A JSON object counts as an envelope if it has an ``error`` or ``choices`` key.
    An envelope with an error, or without content, gives the empty string.
    """

    def unpack(parsed: Column) -> Column:
        error, choices = parsed["error"], parsed["choices"]
        failed = error.isNotNull() & ~error.isin("", "false", "0", "{}", "[]")
        content = F.coalesce(F.get(choices, F.lit(0))["message"]["content"], F.lit(""))
        is_envelope = error.isNotNull() | choices.isNotNull()
        return F.when(is_envelope, F.when(failed, F.lit("")).otherwise(content)).otherwise(response)

    # The whole text has to be the object: one with anything behind it is plain text.
    parsed = parse_whole(strip(response), T.StructType.fromDDL(RESPONSE_SCHEMA))
    opened = F.when(strip(response).startswith("{"), bind(parsed, unpack)).otherwise(response)
    return F.coalesce(opened, F.lit(""))
