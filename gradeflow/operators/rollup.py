"""Score normalisation and the weighted roll-up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..sources.weights import Node, weights_frame
from ..storage import keep


def scores_from_metrics(metrics: DataFrame) -> DataFrame:
    """Accuracy rows to percent scores ``model, dataset, score``, two decimals."""
    return metrics.select("model", "dataset", F.round(F.col("overall") * 100, 2).alias("score"))


def minmax_by_dataset(scores: DataFrame) -> DataFrame:
    """Scores scaled to 0-100 within each data set.

    Fewer than two scores: kept as they are, and null rows disappear.  Equal scores:
    50.  The bounds are a combining aggregate joined back, so a data set holding most
    of the rows is never gathered in one task as a window would do.
    """
    bounds = scores.groupBy("dataset").agg(
        F.min("score").alias("_lo"), F.max("score").alias("_hi"), F.count("score").alias("_n")
    )
    lo, hi, x = F.col("_lo"), F.col("_hi"), F.col("score")
    scaled = (
        F.when(x.isNull() | (F.col("_n") < 2), x)
        .when(hi == lo, F.lit(50.0))
        .otherwise(F.round((x - lo) / (hi - lo) * 100, 2))
    )
    return (
        scores.join(bounds, "dataset")
        .filter(x.isNotNull() | (F.col("_n") >= 2))
        .select("model", "dataset", scaled.alias("score"))
    )


def normalization_summary(
    scaled: DataFrame, first: int = 5, raw: DataFrame | None = None
) -> DataFrame:
    """Bounds and mean of the first data sets by name; a report of five rows.

    With ``raw`` the first names are taken from the unscaled scores, where a data set
    without any score still takes up a place.
    """
    if raw is not None:
        names = raw.select("dataset").distinct().orderBy("dataset").limit(first)
        scaled = scaled.join(names, "dataset", "left_semi")
    return (
        scaled.groupBy("dataset")
        .agg(
            F.min("score").alias("min_score"),
            F.max("score").alias("max_score"),
            F.avg("score").alias("avg_score"),
        )
        .orderBy("dataset")
        .limit(first)
        .filter(F.col("min_score").isNotNull())
    )


def datasets_in(nodes: DataFrame) -> DataFrame:
    """The data sets a weight tree names, each once."""
    return nodes.filter(F.col("dataset").isNotNull()).select("dataset").distinct()


def discover(scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The models and the data sets that have a score row."""
    return scores.select("model").distinct(), scores.select("dataset").distinct()


def coverage(scores: DataFrame) -> DataFrame:
    """How many scores each model has and lacks."""
    return scores.groupBy("model").agg(
        F.count_if(F.col("score").isNotNull()).alias("valid"),
        F.count_if(F.col("score").isNull()).alias("missing"),
    )


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _weighted_mean(children: list[Node], column: Callable[[Node], str]) -> str:
    """Mean over the children that have a score; null if none has, or weights are zero.

    Written as SQL text, since a tree has many nodes and a text is one call to the JVM.
    """
    known = {c: f"({column(c)} IS NOT NULL AND NOT isnan({column(c)}))" for c in children}
    total = " + ".join(f"IF({ok}, {c.weight!r}D, 0D)" for c, ok in known.items())
    value = " + ".join(f"IF({ok}, {column(c)} * {c.weight!r}D, 0D)" for c, ok in known.items())
    return f"IF({total} > 0, ({value}) / ({total}), NULL)"


def weighted_mean_rollup(scores: DataFrame, nodes: list[Node]) -> DataFrame:
    """One row per model and tree node, ``score`` null where nothing is known.

    The tree is configuration, so its shape becomes column expressions: one combining
    aggregate spreads a model's scores over the leaf columns (the only shuffle), and
    each level is then computed from the level below inside the row, in configuration
    order.  Weights renormalise at every level.
    """
    datasets = sorted({n.dataset for n in nodes if n.dataset is not None})
    at = {d: f"d{i}" for i, d in enumerate(datasets)}
    leaves = [f"max(score) FILTER (WHERE dataset = {_text(d)}) AS {c}" for d, c in at.items()]
    # The row count keeps the aggregate valid for a tree that names no data set.
    wide = scores.groupBy("model").agg(F.count(F.lit(1)), *[F.expr(e) for e in leaves])

    def column(node: Node) -> str:
        if not node.is_leaf:
            return f"n{node.pos}"
        return at[node.dataset] if node.dataset else "CAST(NULL AS DOUBLE)"

    children: dict[str | None, list[Node]] = {}
    for node in nodes:
        children.setdefault(node.parent_path, []).append(node)
    for level in sorted({n.level for n in nodes}, reverse=True):
        inner = [n for n in nodes if n.level == level and not n.is_leaf]
        if inner:
            means = [f"{_weighted_mean(children[n.path], column)} AS n{n.pos}" for n in inner]
            wide = wide.selectExpr("*", *means)
    cells = ", ".join(f"named_struct('pos', {n.pos}, 'score', {column(n)})" for n in nodes)
    long = wide.selectExpr("model", f"inline(array({cells}))")
    # The node table has one row per line of the configuration file.
    tree = weights_frame(scores.sparkSession, nodes)
    return long.join(F.broadcast(tree), "pos").select(
        "pos", "path", "parent_path", "parts", "name", "level", "weight", "is_leaf", "model", "score"
    )


NODE_COLUMNS = ("path", "parent_path", "level", "weight", "dataset")


def rollup_table(scores: DataFrame, nodes: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A7 for a weight tree that is a table: model, path, level, score of every known node.

    ``nodes`` has ``path``, ``parent_path``, ``level``, ``weight`` and ``dataset`` (null for inner
    nodes); with ``by``, rows of ``nodes`` and ``scores`` share these columns and there is a tree
    for each of their values, such as one per model.  Levels are joined from the deepest up,
    each a combining aggregate over the edges of that level only, so the plan grows with the
    depth and not with the number of nodes.  A node is known if a child with a score has a
    weight; other nodes have no row.  A missing weight is 1.
    """
    edges = keep(nodes.select(*by, *NODE_COLUMNS).withColumn("weight", F.coalesce("weight", F.lit(1.0))), "edges")
    known = scores.where(F.col("score").isNotNull() & ~F.isnan("score"))
    # Several scores of a data set: the largest, as in the plan for small trees.
    best = known.groupBy(*dict.fromkeys([*by, "model", "dataset"])).agg(F.max("score").alias("score"))
    key = [*dict.fromkeys([*by, "model"])]
    deepest = edges.agg(F.max("level")).first()[0] or 0
    leaves = keep(edges.where("dataset IS NOT NULL").join(best, [*by, "dataset"]).select(
        *key, "path", "parent_path", "level", "weight", "score"), "leaf-scores")
    done = [leaves]
    below = leaves.where(F.col("level") == deepest)
    for level in range(deepest - 1, 0, -1):
        total = F.sum("weight")
        means = below.groupBy(*key, F.col("parent_path").alias("path")).agg(
            F.when(total > 0, F.sum(F.col("weight") * F.col("score")) / total).alias("score"))
        inner = edges.where((F.col("level") == level) & F.col("dataset").isNull()).drop("dataset")
        here = keep(means.where("score IS NOT NULL").join(inner, [*by, "path"]).select(
            *key, "path", "parent_path", "level", "weight", "score"), "level-scores")
        done.append(here)
        below = here.union(leaves.where(F.col("level") == level))
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.select(*key, "path", "level", "score")
