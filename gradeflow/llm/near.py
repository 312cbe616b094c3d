"""Near-duplicate documents: a chosen-path similarity join over word shingles."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from .common import (as_long, byte_table, components, flat_bytes, mix, plain, small_blocks, window_hashes,
                     word_bounds, word_hashes, written)
from .slots import GATHERED, gathered, may_repeat, packed_slots, shared_table, table_of

SHINGLE = 5
PERCENT = 75   # of the union that two documents must share
TREES = 24     # a pair at the threshold shares a path of two tokens in a tree with 0.5625: no
LEVELS = 2     # tree brings it to one node with 0.4375 ** 24, below 1e-8; in a node nothing is lost
LEAF = 24      # members outside its largest component up to which a node is compared exhaustively
RANKS = 20     # bits of the table of counts that orders tokens from rare to frequent
PARITY = 11    # bits of a token that choose its place in the parity bits of a set
FEW = 500_000  # pairs or ids that are broadcast: some megabytes
HEADS = 8      # further members that all others of a node with many components are compared with


def shingle_sets(block: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingles behind one another, sorted in each text, and their offsets."""
    buf, offsets = flat_bytes(block.column("text"))
    buf = byte_table("lower")[buf]
    starts, ends, firsts = word_bounds(buf, offsets)
    values = word_hashes(buf, starts, ends)
    windows = window_hashes(values, SHINGLE)
    sets = []
    for lo, hi in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
        if hi - lo >= SHINGLE:
            sets.append(np.unique(windows[lo:hi - SHINGLE + 1]))
        elif hi > lo:
            sets.append(window_hashes(values[lo:hi], hi - lo) ^ np.uint64(hi - lo))
        else:
            sets.append(values[:0])
    ends_ = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=ends_[1:])
    return np.concatenate(sets) if sets else values[:0], ends_


def branch(values: np.ndarray, offsets: np.ndarray, paths: np.ndarray) -> np.ndarray:
    """The child node of each set: its path, longer by the token that is least under the path's
    own hash function. Every set must have a member."""
    sizes = np.diff(offsets)
    order = mix(values ^ np.repeat(paths, sizes))
    return mix(np.minimum.reduceat(order, offsets[:-1]) + mix(paths + np.uint64(1)))


def parities(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each set, whether the tokens of each place are odd in number: 2 ** PARITY bits as 64-bit words.

    A token that only one of two sets holds changes one bit, so two sets differ in at least as
    many tokens as their bits differ.
    """
    out = np.zeros((len(offsets) - 1, 1 << (PARITY - 6)), np.int64)
    place = (values >> np.uint64(64 - PARITY)).astype(np.int64)
    for lo in range(0, len(out), 1 << 10):
        edges = offsets[lo:lo + (1 << 10) + 1]
        row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        odd = np.bincount((row << PARITY) + place[edges[0]:edges[-1]], minlength=(len(edges) - 1) << PARITY) & 1
        out[lo:lo + len(edges) - 1] = np.packbits(odd.astype(bool)).view(np.int64).reshape(len(edges) - 1, -1)
    return out


def _lists(words: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(words) + 1) * words.shape[1], pa.int32()), pa.array(words.reshape(-1)))


def _alike(x: str, y: str, percent: int) -> str:
    """SQL: the parity bits do not exclude that two sets are similar enough."""
    apart = " + ".join(f"bit_count({x}.parity[{i}] ^ {y}.parity[{i}])" for i in range(1 << (PARITY - 6)))
    return f"{100 + percent} * ({apart}) <= {100 - percent} * ({x}.n + {y}.n)"


def _described(docs: DataFrame, trees: int, levels: int) -> DataFrame:
    """n_shingles, a 128-bit signature of the set, its parity bits and the nodes it reaches."""
    seeds = mix(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in small_blocks(batches):
            values, offsets = shingle_sets(block)
            sizes = np.diff(offsets)
            some = np.flatnonzero(sizes)
            edges = np.append(offsets[:-1][some], offsets[-1])
            nodes = np.zeros((len(some), trees), np.uint64)
            sums = np.zeros((2, block.num_rows), np.uint64)
            if len(some):
                for tree, seed in enumerate(seeds):
                    path = np.full(len(some), seed)
                    for _ in range(levels):
                        path = branch(values, edges, path)
                    nodes[:, tree] = path
                for k in range(2):
                    sums[k, some] = np.add.reduceat(mix(values + np.uint64(0xABCD + k)), edges[:-1])
            reached = iter(np.ascontiguousarray(nodes).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(sizes), as_long(sums[0]), as_long(sums[1]),
                 pa.array([next(reached) if size else [] for size in sizes], pa.list_(pa.int64())),
                 _lists(parities(values, offsets))],
                ["doc_id", "n_shingles", "s1", "s2", "nodes", "parity"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, s1 long, s2 long, nodes array<long>, parity array<long>")


def _id_hashes(column: pa.Array) -> np.ndarray:
    return mix(column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))


def _slots_of(ids: DataFrame) -> Broadcast:
    """A fixed-size table of the slots of all ids, by which a scan leaves out other texts."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from gathered(np.repeat(_id_hashes(batch.column(0)), 2) for batch in batches if batch.num_rows)

    return shared_table(ids, packed_slots(ids.mapInArrow(run, GATHERED)))


def _asked(batches: Iterable[pa.RecordBatch], slots: Broadcast) -> Iterator[pa.RecordBatch]:
    """Blocks of the rows whose ids are in the table, and of few others that share a slot."""
    table = table_of(slots)
    yield from small_blocks(batch.filter(pa.array(may_repeat(table, _id_hashes(batch.column("doc_id"))))) for batch in batches)


def _met(classes: DataFrame) -> DataFrame:
    """rep, n, node of the nodes that may have several members; most nodes have one and never leave their task."""
    def node_slots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from gathered(batch.column("nodes").flatten().to_numpy().view(np.uint64) for batch in batches if batch.num_rows)

    several = shared_table(classes, packed_slots(classes.select("nodes").mapInArrow(node_slots, GATHERED)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(several)
        for batch in batches:
            lists = batch.column("nodes")
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            nodes = lists.flatten().to_numpy()
            keep = may_repeat(table, nodes.view(np.uint64))
            rows = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays(
                [batch.column("rep").take(rows), batch.column("n_shingles").take(rows), pa.array(nodes[keep])], ["rep", "n", "node"])

    return classes.select("rep", "n_shingles", "nodes").mapInArrow(run, "rep long, n long, node long")


def _few(rows: DataFrame) -> DataFrame:
    """Broadcast a written table of pairs or ids if it is small; else what it is joined with moves to it."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def _linked(pairs: DataFrame, bits: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose whole shingle sets are similar enough.

    The parity bits exclude most others first. Texts stay where they are: the scan makes the sets
    of those that are asked for, and only sets move.
    """
    few = _few(pairs)
    x, y = (few.join(bits.withColumnRenamed("doc_id", side), side).alias(name) for side, name in (("a", "x"), ("b", "y")))
    pairs = written(x.join(y, ["a", "b"]).where(_alike("x", "y", percent)).select("a", "b").distinct(), "alike")
    wanted = _slots_of(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _asked(batches, wanted):
            values, offsets = shingle_sets(block)
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), as_long(values))],
                ["doc_id", "set"])

    sets = written(docs.mapInArrow(run, "doc_id long, set array<long>"), "sets")
    both = (_few(pairs).join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("x")), "a")
            .join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("y")), "b"))
    shared = F.size(F.array_intersect("x", "y"))
    return both.withColumn("shared", shared).where(
        f"100 * shared >= {percent} * (size(x) + size(y) - shared)").select("a", "b").distinct()


def _sized(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs that their set sizes alone do not exclude, each once."""
    return pairs.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT,
                    trees: int = TREES, levels: int = LEVELS, leaf: int = LEAF) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of ``docs``.

    Documents with equal sets are one class and only its smallest id goes on. Each tree takes a
    class down a path of selected minwise tokens to a node. In every node all members are
    compared with its smallest one and, while very many are in different components, with a few
    more. Where members are then still in different components, nodes
    with few members outside their largest component are compared exhaustively across components;
    the members of the others go through an exact join on the rarest tokens of their sets. Links
    are confirmed on whole sets, so only confirmed ones count.

    Null or empty text has no shingles and is linked with nothing. A null id gets a null
    component and is not kept; rows that repeat an id are one document in the links.
    """
    source = plain(docs, id_col, text_col)
    named = source.where("doc_id is not null")
    described = written(_described(source, trees, levels), "paths")
    some = described.where("n_shingles > 0 and doc_id is not null")
    bits = some.select("doc_id", F.col("n_shingles").alias("n"), "parity")
    classes = written(some.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min("nodes").alias("nodes")), "classes")
    same = some.join(classes.select("s1", "s2", "n_shingles", "rep"), ["s1", "s2", "n_shingles"]).select(
        F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a != b")
    links = written(same.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "same")
    # One entry for each class and node; a node with one member has nothing to compare.
    nodes = written(_met(classes), "met")
    heads = nodes.groupBy("node").agg(F.min(F.struct("rep", "n")).alias("head"), F.max("rep").alias("last")).where("head.rep < last")
    nodes = written(nodes.join(heads.drop("last"), "node"), "nodes")
    star = _sized(nodes.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("head.rep").alias("b"),
                               F.col("head.n").alias("nb")), percent)
    star = written(star, "star")
    reps = written(_linked(star, bits, named, percent), "links")
    mixed = _mixed(nodes, reps)
    # Where the smallest member is similar to few others, another one may be similar to most.
    many = mixed.where(F.col("outside") > leaf)
    if not many.isEmpty():
        names = [f"head_{k}" for k in range(HEADS)]
        heads = many.groupBy("node").agg(*[
            F.min(F.struct(F.xxhash64("rep", F.lit(name)).alias("order"), "rep", "n", "component")).alias(name) for name in names])
        tried = many.join(heads, "node").select("rep", "n", "component", F.explode(F.array(*names)).alias("head"))
        tried = written(_sized(tried.where("component != head.component").select(
            F.col("rep").alias("a"), F.col("n").alias("na"), F.col("head.rep").alias("b"), F.col("head.n").alias("nb")), percent)
            .join(star, ["a", "b"], "left_anti"), "tried")
        found = written(_linked(tried, bits, named, percent), "links")
        star = star.unionByName(tried)
        if not found.isEmpty():
            reps = reps.unionByName(found)
            mixed = _mixed(nodes, reps)
    few = mixed.where(F.col("outside") <= leaf)
    left = few.where("component != top").select("node", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"))
    right = few.select("node", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"))
    more = written(_sized(left.join(right, "node").where("ca != cb"), percent).join(
        star, ["a", "b"], "left_anti"), "cross")
    large = mixed.where(F.col("outside") > leaf).select(F.col("rep").alias("doc_id"), "component").distinct()
    large = written(large, "large")
    if not large.isEmpty():
        more = more.unionByName(_rare(large, bits, named, percent).join(star, ["a", "b"], "left_anti")).distinct()
        more = written(more, "cross")
    if not more.isEmpty():
        reps = reps.unionByName(written(_linked(more, bits, named, percent), "links"))
    everything = links.unionByName(reps.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    groups = components(everything)
    return (described.join(groups, described.doc_id == groups.node, "left")
            .withColumn("component_id", F.coalesce("component", "doc_id"))
            .select("doc_id", "n_shingles", "component_id",
                    F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")))


def _mixed(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, rep, n, component, top, outside of the nodes whose members are in several components."""
    groups = written(components(links), "groups")
    mixed = (nodes.select("node", "rep", "n").join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left")
             .withColumn("component", F.coalesce("component", "rep")))
    mixed = written(mixed.join(mixed.groupBy("node").agg(F.min("component").alias("low"), F.max("component").alias("high"))
                               .where("low < high").select("node"), "node", "left_semi")
                    .select("node", "rep", "n", "component"), "mixed")
    # Members outside the largest component of a node; where they are few, they are compared
    # with all members of other components: at most leaf rows for a member.
    parts = mixed.groupBy("node", "component").agg(F.count("*").alias("size"))
    most = parts.groupBy("node").agg(F.max(F.struct("size", "component")).alias("top"), F.sum("size").alias("all")).select(
        "node", F.col("top.component").alias("top"), (F.col("all") - F.col("top.size")).alias("outside"))
    return written(mixed.join(most, "node"), "mixed")


def _rare(large: DataFrame, bits: DataFrame, named: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of different components that can be similar enough, by a prefix filter.

    Tokens are in one fixed order, about from rare to frequent. The first token that a similar
    pair shares is among the first ``n - needed + 1`` of both sets: in the smaller (n, id) set at
    least 2 * percent / (100 + percent) of its tokens are needed, in the greater one percent / 100.
    The order only decides how many pairs there are to confirm, so counts by hash suffice.
    """
    spark = named.sparkSession
    wanted = _slots_of(large.select("doc_id"))
    shift = np.uint64(64 - RANKS)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _asked(batches, wanted):
            slot, n = np.unique(shingle_sets(block)[0] >> shift, return_counts=True)
            yield pa.RecordBatch.from_arrays([as_long(slot), pa.array(n.astype(np.int64))], ["slot", "n"])

    found = named.mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << RANKS, np.int64)  # at most one row for each slot comes to the driver
    counts[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    shared = spark.sparkContext.broadcast(counts)

    def prefixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _asked(batches, wanted):
            values, offsets = shingle_sets(block)
            sizes = np.diff(offsets)
            row = np.repeat(np.arange(len(sizes)), sizes)
            values = values[np.lexsort((values, shared.value[values >> shift], row))]
            at, n = np.arange(len(values)) - offsets[row], sizes[row]
            keep = at <= n - -(-percent * n // 100)
            values, row, at, n = values[keep], row[keep], at[keep], n[keep]
            yield pa.RecordBatch.from_arrays(
                [as_long(values), block.column("doc_id").take(pa.array(row)), pa.array(n), pa.array(at),
                 pa.array(at <= n - -(-2 * percent * n // (100 + percent)))],
                ["token", "rep", "n", "at", "early"])

    rows = written(named.mapInArrow(prefixes, "token long, rep long, n long, at long, early boolean").join(
        large.withColumnRenamed("doc_id", "rep"), "rep"), "prefixes")
    # One side is outside the largest component of its token: a large group is not paired with itself.
    parts = rows.groupBy("token", "component").agg(F.count("*").alias("size"))
    top = parts.groupBy("token").agg(F.max(F.struct("size", "component")).alias("top"), F.count("*").alias("kinds")).where(
        "kinds > 1").select("token", F.col("top.component").alias("top"))
    own = bits.join(_few(large.select("doc_id")), "doc_id", "left_semi").withColumnRenamed("doc_id", "rep")
    rows = written(rows.join(top, "token"), "rare").join(own, ["rep", "n"])
    left, right = rows.where("component != top").alias("x"), rows.alias("y")
    pairs = left.join(right, F.expr(f"""x.token = y.token and x.component != y.component
        and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)
        and if(struct(x.n, x.rep) < struct(y.n, y.rep), x.early, y.early)
        and {100 + percent} * least(x.n - x.at, y.n - y.at) >= {percent} * (x.n + y.n)
        and {_alike("x", "y", percent)}"""))
    return pairs.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).where("a < b").distinct()
