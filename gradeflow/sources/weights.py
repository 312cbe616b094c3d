"""Weighted ability tree."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

SEPARATOR = " / "

NODE_SCHEMA = (
    "pos int, path string, parent_path string, parts array<string>, name string, "
    "level int, weight double, is_leaf boolean, dataset string"
)


@dataclass(frozen=True)
class Node:
    """One node; ``pos`` is its place in configuration order, parents first."""

    pos: int
    path: str
    parent_path: str | None
    parts: tuple[str, ...]
    name: str
    level: int
    weight: float
    is_leaf: bool
    dataset: str | None

    def row(self) -> tuple:
        return (
            self.pos, self.path, self.parent_path, list(self.parts), self.name,
            self.level, self.weight, self.is_leaf, self.dataset,
        )


def _children(value: object) -> tuple[Mapping, bool]:
    """Child nodes, and whether a leaf of this kind of tree names a data set."""
    if not isinstance(value, Mapping):
        return {}, True
    if isinstance(value.get("children"), Mapping):
        return value["children"], True
    if isinstance(value.get("sub_tasks"), Mapping):
        return value["sub_tasks"], False
    pairs = {k: v for k, v in value.items() if k != "weight" and isinstance(v, (int, float))}
    return pairs, True


def _walk(tree: Mapping, parents: tuple[str, ...], named: bool) -> Iterator[tuple]:
    for name, value in tree.items():
        parts = parents + (str(name),)
        number = isinstance(value, (int, float))
        weight = value if number else (value or {}).get("weight", 1.0)
        children, child_named = _children(value)
        # In a sub_tasks tree only a plain number names a data set; a node that has
        # nothing but a weight was never broken down and takes no part.
        yield parts, float(weight), not children, str(name) if (named or number) else None
        if children:
            yield from _walk(children, parts, child_named)


def flatten_weights(tree: Mapping) -> list[Node]:
    """Nested configuration to nodes; a missing weight is 1.0."""
    nodes = []
    for pos, (parts, weight, leaf, dataset) in enumerate(_walk(tree, (), True)):
        nodes.append(
            Node(
                pos, SEPARATOR.join(parts), SEPARATOR.join(parts[:-1]) or None, parts,
                parts[-1], len(parts), weight, leaf, dataset if leaf else None,
            )
        )
    return nodes


def load_weights(spark: SparkSession, source: str | Mapping) -> list[Node]:
    """The tree from a mapping or from a YAML file; the file is small configuration."""
    if isinstance(source, Mapping):
        return flatten_weights(source)
    try:
        import yaml
    except ImportError as missing:
        raise ImportError("reading a YAML tree needs pyyaml; pass a mapping instead") from missing
    text = spark.read.text(source, wholetext=True).first()["value"]
    return flatten_weights(yaml.safe_load(text))


def weights_frame(spark: SparkSession, nodes: list[Node]) -> DataFrame:
    """The node table, one row per node of the configuration."""
    return spark.createDataFrame([n.row() for n in nodes], NODE_SCHEMA)
