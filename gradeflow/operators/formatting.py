"""Row cleaning and normalisation into question samples."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.chars import SPACE
from ..functions.text import ascii_digits, bind, strip
from ..registry import formatters


def clean_cells(df: DataFrame, cells: str = "raw_data") -> DataFrame:
    """trim every cell and drop rows whose cells are all blank."""
    filled = df.filter(F.exists(cells, lambda c: c.rlike(f"[^{SPACE}]")))
    return filled.withColumn(cells, F.transform(cells, lambda c: strip(F.coalesce(c, F.lit("")))))


@dataclass(frozen=True)
class Classification:
    """What turns a labelled title/description row into a single-choice question."""

    dataset: str
    question_text: str
    category: str
    subcategory: str
    options: Mapping[str, str]
    answers: Mapping[int, str]


# Question text, options and label letters of the news topic set.
NEWS = Classification(
    dataset="agnews",
    question_text="Please classify this news article into one of the following categories:",
    category="AGNews",
    subcategory="News Topic Classification",
    options={
        "A": "World - International news, politics, and global events",
        "B": "Sports - Athletic events, games, and sports-related news",
        "C": "Business - Economic news, corporate affairs, and financial markets",
        "D": "Sci/Tech - Science, technology, and innovation news",
    },
    answers={1: "A", 2: "B", 3: "C", 4: "D"},
)


def _literal_map(entries: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for kv in entries.items() for x in kv])


def format_classification(
    df: DataFrame,
    spec: Classification,
    label: Column,
    title: Column,
    description: Column,
    id_parts: Sequence[Column] = (),
    keep: Sequence[str] = (),
) -> DataFrame:
    """question samples, with a ``reject_reason`` that is null for valid rows.

    ``question_id`` hashes the scene.  Exact copies of a text share it, so pass
    ``id_parts`` (a row id) wherever responses are joined by ``question_id``.
    """
    text = ascii_digits(strip(label))
    number = F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("int"))
    base = df.select(
        *keep,
        number.alias("_label"),
        F.btrim(strip(title), F.lit('"')).alias("_title"),
        F.btrim(strip(description), F.lit('"')).alias("_description"),
        *[p.cast("string").alias(f"_part{i}") for i, p in enumerate(id_parts)],
    )
    scene = F.concat(
        F.lit("Title: "), F.col("_title"), F.lit("\nDescription: "), F.col("_description")
    )
    reason = (
        F.when(~F.coalesce(F.col("_label").isin(*spec.answers), F.lit(False)), "label")
        .when(F.coalesce(F.col("_title"), F.lit("")) == "", "title")
        .when(F.coalesce(F.col("_description"), F.lit("")) == "", "description")
    )
    parts = [F.col(f"_part{i}") for i in range(len(id_parts))]
    # Never null, so that a join on it does not filter by hashing every text once more.
    question_id = F.coalesce(F.sha2(F.concat(F.col("scene"), *parts), 256), F.lit(""))
    return base.withColumn("scene", scene).select(
        *keep,
        question_id.alias("question_id"),
        "scene",
        F.lit(spec.question_text).alias("question_text"),
        _literal_map(spec.options).alias("options"),
        F.element_at(_literal_map(spec.answers), F.col("_label")).alias("correct_answer"),
        F.lit(spec.category).alias("category"),
        F.lit(spec.subcategory).alias("subcategory"),
        F.struct(
            F.lit(spec.dataset).alias("dataset_name"),
            F.col("_title").alias("title"),
            F.col("_description").alias("description"),
            F.col("_label").alias("original_label"),
        ).alias("other_info"),
        reason.alias("reject_reason"),
    )


def accepted(formatted: DataFrame) -> DataFrame:
    """the valid samples."""
    return formatted.filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejects(formatted: DataFrame) -> DataFrame:
    """the rejected rows with their reason."""
    return formatted.filter(F.col("reject_reason").isNotNull())


def format_news_all(
    df: DataFrame, cells: str = "raw_data", keep: Sequence[str] = (), id_parts: Sequence[Column] = ()
) -> DataFrame:
    """F2 over positional cells, rejected rows included."""
    cell = lambda i: F.get(cells, F.lit(i))
    return format_classification(df, NEWS, cell(0), cell(1), cell(2), id_parts=id_parts, keep=keep)


@formatters.register("AGNewsFormatter")
def format_news(df: DataFrame) -> DataFrame:
    """label, title and description cells to news topic samples.

    Where the reader gives a row's place, it is kept and is part of ``question_id``, so
    that copies of a text are questions of their own.
    """
    place = [c for c in ("_source_file", "_row_index") if c in df.columns]
    if len(place) < 2:
        return accepted(format_news_all(df))
    name = F.regexp_extract("_source_file", "[^/]*$", 0)
    return accepted(format_news_all(df, keep=place, id_parts=[F.lit("\n"), name, F.lit("\n"), F.col("_row_index")]))


# Option letters, which repeat after 52.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def options_to_letters(options: Column) -> Column:
    """letter -> option; beyond 52 options the later one takes the letter.

    For each letter in use, the last option of its residue class is picked
    directly, so the map never has duplicate keys.
    """
    period = len(ALPHABET)

    def letters(opts: Column) -> Column:
        size = F.size(opts)
        last_round = lambda s: period * F.floor((size - 1 - s) / period).cast("int")
        entries = F.transform(
            F.sequence(F.lit(0), F.least(size, F.lit(period)) - 1),
            lambda s: F.struct(
                F.substring(F.lit(ALPHABET), s + 1, F.lit(1)).alias("key"),
                F.get(opts, s + last_round(s)).alias("value"),
            ),
        )
        return F.when(size > 0, F.map_from_entries(entries)).otherwise(
            F.create_map().cast("map<string,string>")
        )

    return bind(options, letters)


def _leaf_columns(schema: T.StructType, prefix: tuple[str, ...]) -> Iterable[tuple[str, ...]]:
    for field in schema.fields:
        path = prefix + (field.name,)
        if isinstance(field.dataType, T.StructType):
            yield from _leaf_columns(field.dataType, path)
        else:
            yield path


def flatten_annotations(
    df: DataFrame,
    annotation: str = "dialogue_annotation",
    dialogues: str = "dialogues",
    keep: Sequence[str] = (),
) -> DataFrame:
    """one dotted column per leaf of the annotation struct, and ``turn_count``."""
    leaves: list[Column] = []
    if annotation in df.columns:
        for path in _leaf_columns(df.schema[annotation].dataType, ()):
            source = ".".join(f"`{p}`" for p in (annotation, *path))
            leaves.append(F.col(source).alias(".".join(path)))
    turns = F.coalesce(F.size(dialogues), F.lit(0)) if dialogues in df.columns else F.lit(0)
    # size() of a null array is -1 in legacy mode; a missing dialogue has no turns.
    return df.select(*keep, *leaves, F.greatest(turns, F.lit(0)).alias("turn_count"))


def unpack_lists(df: DataFrame) -> DataFrame:
    """each list column becomes ``name_0 .. name_k``; shorter lists are padded with null.

    The widths come from one aggregate (a single row); a list column that is
    everywhere null stays as it is.
    """
    lists = [f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)]
    if not lists:
        return df
    quoted = {c: f"`{c}`" for c in df.columns}
    widths = df.agg(*[F.max(F.size(quoted[c])).alias(c) for c in lists]).first().asDict()
    out = [F.col(quoted[c]) for c in df.columns if c not in lists or (widths[c] or -1) < 0]
    for c in lists:
        for i in range(max(widths[c] or 0, 0)):
            out.append(F.get(F.col(quoted[c]), F.lit(i)).alias(f"{c}_{i}"))
    return df.select(*out)
