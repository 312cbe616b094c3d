"""Canonical JSON text for content hashes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from .numbers import float_text

# Two-character escapes of JSON text; other control characters are \u00xx.
ESCAPES = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def json_string(col: Column) -> Column:
    """A JSON string literal: only quotes, backslashes and control characters are escaped."""
    out = col
    for raw, escaped in ESCAPES.items():
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    rare = out
    for code in (c for c in range(0x20) if chr(c) not in ESCAPES):
        rare = F.replace(rare, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    out = F.when(col.rlike(r"[\x00-\x07\x0b\x0e-\x1f]"), rare).otherwise(out)
    return F.concat(F.lit('"'), out, F.lit('"'))


def canonical_json(col: Column, dtype: T.DataType) -> Column:
    """JSON with sorted keys, ``", "`` and ``": "`` separators and raw non-ASCII text.

    A null struct field counts as an absent key, since a fixed schema cannot tell
    the two apart; a null array element prints ``null``.
    """
    if isinstance(dtype, T.StructType):
        pairs = [
            F.concat(F.lit(f'"{f.name}": '), canonical_json(col[f.name], f.dataType))
            for f in sorted(dtype.fields, key=lambda f: f.name)
        ]
        text = F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}"))
    elif isinstance(dtype, T.ArrayType):
        items = F.transform(
            col, lambda x: F.coalesce(canonical_json(x, dtype.elementType), F.lit("null"))
        )
        text = F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    elif isinstance(dtype, T.MapType):
        items = F.transform(
            F.array_sort(F.map_entries(col)),
            lambda e: F.concat(
                json_string(e["key"]),
                F.lit(": "),
                F.coalesce(canonical_json(e["value"], dtype.valueType), F.lit("null")),
            ),
        )
        text = F.concat(F.lit("{"), F.array_join(items, ", "), F.lit("}"))
    elif isinstance(dtype, T.StringType):
        text = json_string(col)
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        text = float_text(col)
    else:
        text = col.cast("string")
    return F.when(col.isNotNull(), text)
