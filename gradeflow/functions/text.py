"""Text scalars and token arrays (T1-T7, L6) as JVM-side column expressions."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

from .chars import CJK, SPACE, WHITESPACE, WORD

# URL, @handle, or any character that is neither CJK nor ASCII letter.
LINK_PATTERN = rf"http[^{SPACE}]+|@[{WORD}]+"
NOISE_PATTERN = rf"{LINK_PATTERN}|[^{CJK}a-zA-Z]"

# A token is a run of ASCII letters or one CJK character.
TOKEN_PATTERN = rf"[a-zA-Z]+|[{CJK}]"

SEPARATOR = "\x1f"  # fixed value: between the words of an n-gram


def strip(col: Column) -> Column:
    """Trim all Unicode white space at both ends."""
    return F.btrim(col, F.lit(WHITESPACE))


@cache
def _decimal_digits() -> tuple[str, str]:
    """All Unicode decimal digits beyond ASCII, and the ASCII digit each one stands for."""
    chars = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"]
    return "".join(chars), "".join(str(unicodedata.digit(c)) for c in chars)


def ascii_digits(col: Column) -> Column:
    """Decimal digits of any script as 0-9."""
    source, target = _decimal_digits()
    return F.when(col.rlike(r"[^\x00-\x7f]"), F.translate(col, source, target)).otherwise(col)


def clean_text(col: Column) -> Column:
    """URLs, handles and non-letters become one space each match."""
    return F.regexp_replace(col, F.lit(NOISE_PATTERN), F.lit(" "))


def tokenize(col: Column) -> Column:
    """Words and single CJK characters.

    A dictionary segmenter keeps multi-character Chinese words together; plug one
    in with :func:`segmenter` where that matters.
    """
    return F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit(TOKEN_PATTERN), 0)


# Bytes of text whose words are held as Python objects at once; a longer text is held alone.
SLICE = 1 << 18


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        done = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, done + SLICE, "right")))
        yield texts[start:end]
        start = end


def word_lists(cut: Callable[[str], list[str]]) -> Callable[[Column], Column]:
    """``cut(text) -> words`` as an Arrow function; null counts as empty.

    Words are many times larger as Python objects than as text, so a batch is cut in small slices.
    """

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            for part in _slices(texts):
                yield pa.array([cut(t or "") for t in part.to_pylist()], pa.list_(pa.string()))

    return run


def segmenter(cut: Callable[[str], Iterable[str]]) -> Callable[[Column], Column]:
    """T2 hook: wrap ``cut(text) -> words`` as an Arrow function; blank words are dropped."""
    return word_lists(lambda t: [w for w in cut(t) if w.strip()])


def preprocess(col: Column, stop_words: Iterable[str] = (), tokenizer=tokenize) -> Column:
    """Clean, tokenise and drop stop words.

    The default tokeniser skips everything but letters by itself, so for it only URLs
    and handles have to be blanked beforehand.
    """
    if tokenizer is tokenize:
        blanked = F.regexp_replace(col, F.lit(LINK_PATTERN), F.lit(" "))
        clean = F.when(col.contains("http") | col.contains("@"), blanked).otherwise(col)
    else:
        clean = strip(clean_text(col))
    return remove_stop_words(tokenizer(clean), stop_words)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it any number of times in ``body``.

    An expression placed inside an array lambda is otherwise evaluated again for
    every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """Sliding n-grams as arrays; none if there are fewer than ``n`` tokens."""

    def slide(t: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(t) - (n - 1))
        return F.when(F.size(t) >= n, F.transform(starts, lambda i: F.slice(t, i, n))).otherwise(
            F.array().cast("array<array<string>>")
        )

    return bind(tokens, slide)


def ngram_keys(tokens: Column, n: int, plain: bool = True) -> Column:
    """Sliding n-grams, one string each, so that Spark can hash them.

    ``plain`` promises that no token holds the unit separator (true for
    :func:`tokenize`).  Otherwise each token is prefixed with its length, which
    keeps different n-grams different whatever the tokens contain.
    """
    if n == 1 and plain:
        return tokens

    def piece(token: Column) -> Column:
        return token if plain else F.concat(F.length(token).cast("string"), F.lit(":"), token)

    def slide(t: Column) -> Column:
        keys = F.transform(
            F.sequence(F.lit(0), F.size(t) - n),
            lambda i: F.concat_ws(SEPARATOR, *[piece(F.get(t, i + k)) for k in range(n)]),
        )
        return F.when(F.size(t) >= n, keys).otherwise(F.array().cast("array<string>"))

    return bind(tokens, slide)


def remove_stop_words(tokens: Column, stop_words: Iterable[str]) -> Column:
    """L6 for a list held by the driver; ``isin`` over literals is a hash lookup per token."""
    words = sorted(set(stop_words))
    return F.filter(tokens, lambda t: ~t.isin(words)) if words else tokens


def format_score(col: Column) -> Column:
    """T4: two decimals, or ``N/A`` where there is no score."""
    return F.when(col.isNull(), F.lit("N/A")).otherwise(F.format_string("%.2f", col))


def round2(col: Column) -> Column:
    """T5: two decimals, halves away from zero on the printed value."""
    return F.round(col, 2)


def safe_name(col: Column) -> Column:
    """Every character outside ``[a-zA-Z0-9_-]`` becomes an underscore."""
    return F.regexp_replace(col, F.lit("[^a-zA-Z0-9_-]"), F.lit("_"))


def dataset_name(formatter: Column) -> Column:
    """The data set's name is its formatter's name without the suffix."""
    name = F.regexp_replace(formatter, F.lit("(Formatter|_format)$"), F.lit(""))
    return F.when(F.coalesce(formatter, F.lit("")) == "", "unknown_dataset").otherwise(name)


def model_name(identifier: Column, model_path: Column, key: Column) -> Column:
    """Remote identifier, else last part of the model path, else the config key."""

    def filled(c: Column) -> Column:
        return F.when(c != "", c)

    return F.coalesce(
        filled(identifier),
        F.element_at(F.split(filled(model_path), "/"), -1),
        filled(key),
        F.lit("unknown_model"),
    )
