"""Prompt and chat-request rendering."""

from __future__ import annotations

from collections.abc import Mapping
from string import Formatter

from pyspark.sql import Column, DataFrame, functions as F


def options_text(options: Column) -> Column:
    """``K. text`` lines, sorted by letter."""
    lines = F.transform(
        F.array_sort(F.map_entries(options)),
        lambda e: F.concat(e["key"], F.lit(". "), F.coalesce(e["value"], F.lit(""))),
    )
    return F.array_join(lines, "\n")


def _placeholder(df: DataFrame, name: str) -> Column:
    if name == "options":
        return options_text(F.col("options")) if "options" in df.columns else F.lit("")
    if name in df.columns:
        return F.col(name).cast("string")
    if name.startswith("option_"):
        letter = name.split("_")[1]
        return F.try_element_at("options", F.lit(letter)) if "options" in df.columns else F.lit("")
    if name in ("question", "question_text"):
        known = [F.col(c) for c in ("question_text", "question") if c in df.columns]
        return F.coalesce(*known) if known else F.lit("")
    return F.lit("")


def render_prompt(df: DataFrame, template: str) -> Column:
    """Fill ``{name}`` placeholders of ``template`` from the sample's columns.

    The template is taken apart once, on the driver; what Spark evaluates is one
    ``concat``.  Unknown or missing values render as the empty string; a placeholder
    that is no plain name, or has a format, is an error (write ``{{`` for a brace).
    """
    parts: list[Column] = []
    for literal, name, spec, conversion in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None and (not name.isidentifier() or spec or conversion):
            raise ValueError(f"placeholder {name!r} of the prompt template is not a plain name")
        if name:
            parts.append(F.coalesce(_placeholder(df, name), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def to_chat_request(prompt: Column, model: Column | str, params: Mapping[str, object] | None = None) -> Column:
    """Chat request body as JSON; generation parameters follow the message."""
    message = F.struct(F.lit("user").alias("role"), prompt.alias("content"))
    name = F.lit(model) if isinstance(model, str) else model
    extra = [
        (v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in (params or {}).items()
    ]
    return F.to_json(F.struct(name.alias("model"), F.array(message).alias("messages"), *extra))


def generation_group_key(defaults: Mapping[str, str], overrides: Column) -> Column:
    """Model defaults overlaid by the row's own parameters, as key-sorted JSON.

    Rows with equal parameters get equal keys, so ``repartition`` or ``groupBy`` on
    it forms the generation groups.
    """
    rows = F.coalesce(overrides, F.create_map().cast("map<string,string>"))
    if defaults:
        base = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
        # Dropping overridden defaults first keeps keys unique without a session setting.
        rows = F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(rows, k)), rows)
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(rows))))
