"""Parsing a text as exactly one JSON value."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from .text import bind

# An explicit mode keeps Spark from narrowing the parse to the columns used later,
# which would let malformed rows pass.
STRICT = {"mode": "PERMISSIVE", "allowSingleQuotes": "false"}


def parse_whole(text: Column, dtype: T.DataType) -> Column:
    """The text's JSON value as ``dtype``; null if it is malformed or not alone.

    Spark's parser stops after the first value and ignores what follows.  Read as the
    only element of an array, a value followed by anything else is an error.
    """
    wrapped = F.concat(F.lit("["), text, F.lit("]"))
    values = F.from_json(wrapped, T.ArrayType(dtype), STRICT)
    return bind(values, lambda v: F.when(F.size(v) == 1, F.get(v, F.lit(0))))
