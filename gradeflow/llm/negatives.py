"""Hard negatives: threshold joins of anchors with all rows, with thresholds lowered until windows fill."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import scratch_path, written

BLOCK_BYTES = 32 << 20  # of anchors that one pass over the rows carries
ANCHORS = 512           # in one index
ROWS = 1024             # that meet an index at once
RUN = 8                 # dimensions accumulated at once
SPARSE = 0.05           # share of pairs left below which each is finished alone
EXPECTED = 4            # rows aimed at for each row wanted, at first; then EXPECTED ** 3
TRIES = 2               # estimated thresholds; after them a window's own lower end is the threshold
UNBOUNDED = 2**62
SLACK = 1e-9            # of bounds in floating point; products themselves are exact below 2 ** 53

Found = tuple[np.ndarray, np.ndarray, np.ndarray]


class Index:
    """Anchors by dimension, without the dimensions that cannot bring a row to their threshold.

    An anchor whose dimensions from some run on have a norm below ``threshold / largest row
    norm`` is left out of those runs: a row that shares only these stays below the threshold.
    """

    def __init__(self, vectors: np.ndarray, least: np.ndarray, largest: float):
        """``least``: the threshold of each anchor. ``largest``: no row's norm is above it."""
        rest = _norms_from(vectors)
        runs = rest.shape[1] - 1
        covered = rest[:, :-1] * largest * (1 + SLACK) < least[:, None]
        width = runs - covered[:, ::-1].cumprod(1).sum(1) if runs else np.zeros(len(vectors), np.int64)
        self.anchor = np.argsort(-width, kind="stable")  # those in most runs first
        self.width, self.rest = width[self.anchor], rest[self.anchor]
        self.vectors, self.least, self.runs = vectors[self.anchor], least[self.anchor].astype(np.float64), runs
        self.held = [int((self.width > run).sum()) for run in range(runs)]
        self.postings = [np.ascontiguousarray(self.vectors[:n, run * RUN:(run + 1) * RUN].T)
                         for run, n in enumerate(self.held)]

    def raise_to(self, least: np.ndarray) -> None:
        """Higher thresholds than those the index was built for."""
        self.least = np.maximum(self.least, least[self.anchor])

    def search(self, rows: np.ndarray) -> Found:
        """Pairs (anchor, row, score) with scores at or above the anchors' thresholds."""
        rest = _norms_from(rows)
        partial = np.zeros((len(rows), len(self.vectors)))
        for run in range(self.runs):
            partial[:, :self.held[run]] += rows[:, run * RUN:(run + 1) * RUN] @ self.postings[run]
            if run % 2 or run + 1 == self.runs:
                alive = self._alive(partial, rest, run + 1)
                if run + 1 < self.runs and alive.mean() < SPARSE:
                    return self._whole(rows, *np.nonzero(alive))
        if not self.runs:
            alive = self._alive(partial, rest, 0)
        exact = self.width == self.runs
        at, place = np.nonzero(alive & exact)
        full = self._found(at, place, partial[at, place])
        if exact.all():
            return full
        others = self._whole(rows, *np.nonzero(alive & ~exact))
        return tuple(np.concatenate(x) for x in zip(full, others))

    def _alive(self, partial: np.ndarray, rest: np.ndarray, runs: int) -> np.ndarray:
        """Pairs whose partial score and remaining norms reach the threshold."""
        seen = np.minimum(self.width, runs)
        most = rest[:, seen] * np.take_along_axis(self.rest, seen[:, None], 1)[:, 0]
        most *= 1 + SLACK
        most += partial
        return most >= self.least - SLACK * np.abs(self.least)

    def _whole(self, rows: np.ndarray, at: np.ndarray, place: np.ndarray) -> Found:
        score = np.zeros(len(at))
        for k in range(0, len(at), 1 << 16):
            part = slice(k, k + (1 << 16))
            score[part] = np.einsum("ij,ij->i", rows[at[part]], self.vectors[place[part]])
        return self._found(at, place, score)

    def _found(self, at: np.ndarray, place: np.ndarray, score: np.ndarray) -> Found:
        good = score >= self.least[place]
        return self.anchor[place[good]], at[good], score[good].astype(np.int64)


def _norms_from(vectors: np.ndarray) -> np.ndarray:
    """The norm of each vector's dimensions from every run on, and 0 behind the last."""
    totals = np.cumsum(vectors[:, ::-1]**2, 1)[:, ::-1][:, ::RUN]
    return np.sqrt(np.concatenate([totals, np.zeros((len(vectors), 1))], 1))


def matrix(vectors: list, width: int) -> np.ndarray:
    """Vectors as rows of one array; a shorter one ends in zeros."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Rows that take part: uid, vec_id, label and q, the components as whole numbers."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"),
                          F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & sound).select(
        F.monotonically_increasing_id().alias("uid"), "vec_id", "label",
        F.transform("v", lambda x: F.floor(x * 256).cast("double")).alias("q"))


def _moments(rows: DataFrame, width: int) -> tuple[int, np.ndarray, np.ndarray, float]:
    """How many rows, their mean and covariance, and the largest norm."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, most, sums, squares = 0, 0.0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            q = matrix(batch.column("q").to_pylist(), width)
            n, sums, squares = n + len(q), sums + q.sum(0), squares + q.T @ q
            most = max(most, np.sqrt((q**2).sum(1)).max(initial=0.0))
        totals = np.concatenate([[n], sums, squares.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([most]), pa.array([totals])], ["most", "totals"])

    parts = rows.select("q").mapInArrow(run, "most double, totals array<double>")
    found = (parts.select("most", F.posexplode("totals").alias("at", "v")).groupBy("at")
             .agg(F.sum("v").alias("v"), F.max("most").alias("most")).collect())  # as many as dimensions, squared
    totals = np.array([r["v"] for r in sorted(found, key=lambda r: r["at"])]) if found else np.zeros(1 + width + width**2)
    n = max(1.0, totals[0])
    mean, squares = totals[1:1 + width] / n, totals[1 + width:].reshape(width, width) / n
    return int(totals[0]), mean, squares - np.outer(mean, mean), found[0]["most"] if found else 0.0


class Join:
    """Joins of windows of scores with all rows.

    A window has an anchor, a lowest and a highest score, and wants its first rows, those of the
    anchor's label or those of others. A first threshold is the score above which a normal
    distribution with the scores' true mean and variance has a few times the rows wanted; windows
    that do not fill get a lower one, at last their own lowest score.
    """

    def __init__(self, rows: DataFrame):
        self.rows = rows
        self.width = rows.agg(F.max(F.size("q")).alias("w")).first()["w"] or 0
        self.count, self.mean, self.spread, self.largest = _moments(rows, self.width)

    def first(self, windows: DataFrame, keep: int, same: bool) -> DataFrame:
        """window, place (from 1), uid, vec_id, score of the first ``keep`` rows of each window.

        ``windows``: window, anchor, label, q, low, high (long); written. All rows of a window
        that reach its threshold are found, so a window with ``keep`` rows is whole; so is one
        whose threshold was its own lowest score.
        """
        done = []
        order = Window.partitionBy("window").orderBy(F.desc("score"), "vec_id", "uid")
        for attempt in range(TRIES + 1):
            found = self._pass(windows, keep, same, attempt)
            found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)
            if attempt == TRIES:
                return self._union(done, found)
            found = written(found, "negatives-first")
            full = found.where(F.col("place") == keep).select("window")
            done.append(found.join(full, "window", "left_semi"))
            windows = written(windows.join(full, "window", "left_anti"), "negatives-open")
            if windows.isEmpty():
                return self._union(done)
        raise AssertionError("unreachable")

    @staticmethod
    def _union(frames: list[DataFrame], *more: DataFrame) -> DataFrame:
        first, *rest = [*frames, *more]
        for frame in rest:
            first = first.unionByName(frame)
        return first

    def _pass(self, windows: DataFrame, keep: int, same: bool, attempt: int) -> DataFrame:
        """Every block of windows against all rows."""
        spark = self.rows.sparkSession
        size = windows.count() * 8 * (self.width + 6)
        blocks = -(-size // BLOCK_BYTES) or 1
        path = scratch_path(spark, "negatives-pass")
        for block in range(blocks):
            held = windows.where(F.pmod(F.xxhash64("anchor"), F.lit(blocks)) == block).toPandas()  # about BLOCK_BYTES
            shared = spark.sparkContext.broadcast(self._thresholds(held, keep, same, attempt))
            scan = _scanner(shared, self.width, self.largest, keep, same)
            (self.rows.mapInArrow(scan, "window long, uid long, vec_id long, score long")
             .write.mode("append").option("compression", "zstd").parquet(path))
            shared.unpersist()
        return spark.read.schema("window long, uid long, vec_id long, score long").parquet(path)

    def _thresholds(self, held: pd.DataFrame, keep: int, same: bool, attempt: int) -> dict:
        """The anchors and windows of a block, with the scores from which rows are looked for."""
        held = held.sort_values(["anchor", "window"]).reset_index(drop=True)
        anchors = held.drop_duplicates("anchor")
        vectors = matrix(anchors["q"].tolist(), self.width)
        place = np.searchsorted(anchors["anchor"].to_numpy(), held["anchor"].to_numpy())
        low, high = held["low"].to_numpy(np.int64).copy(), held["high"].to_numpy(np.int64)
        if attempt < TRIES:
            aim = keep * EXPECTED ** (1 + 2 * attempt) / max(1, self.count)
            mean = (vectors @ self.mean)[place]
            sd = np.sqrt(np.maximum(0.0, np.einsum("ij,jk,ik->i", vectors, self.spread, vectors)))[place]
            if same:  # of a label's rows; how many there are comes with the window
                aim = aim * self.count / np.maximum(1, held["rows"].to_numpy())
            normal = NormalDist()
            for i, share in enumerate(np.broadcast_to(aim, len(held)).tolist()):
                if sd[i] > 0:
                    left = (1.0 if high[i] >= UNBOUNDED else normal.cdf((high[i] - mean[i]) / sd[i])) - share
                    if left > 1e-12:
                        low[i] = max(low[i], int(mean[i] + sd[i] * normal.inv_cdf(left)))
        return {"anchor": anchors["anchor"].to_numpy(np.int64), "label": anchors["label"].to_numpy(np.int64),
                "vectors": vectors, "window": held["window"].to_numpy(np.int64), "place": place, "low": low, "high": high}


def _scanner(shared, width: int, largest: float, keep: int, same: bool):
    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        low, place = block["low"].copy(), block["place"]
        parts = []
        for a in range(0, len(block["vectors"]), ANCHORS):
            mine = np.arange(*np.searchsorted(place, [a, a + ANCHORS]))  # windows, by anchor
            starts = np.searchsorted(place[mine], np.arange(a, min(a + ANCHORS, len(block["vectors"])) + 1))
            least = np.minimum.reduceat(low[mine], starts[:-1])
            parts.append((a, mine, starts, Index(block["vectors"][a:a + ANCHORS], least, largest)))
        best = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("w", "uid", "vec_id", "score")})
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                q = matrix(rows.column("q").to_pylist(), width)
                uid, vec_id, label = (rows.column(c).to_numpy() for c in ("uid", "vec_id", "label"))
                fresh = [best]
                for a, mine, starts, index in parts:
                    anchor, row, score = index.search(q)
                    good = (label[row] == block["label"][a + anchor]) == same
                    if same:
                        good &= uid[row] != block["anchor"][a + anchor]
                    anchor, row, score = anchor[good], row[good], score[good]
                    count = (starts[1:] - starts[:-1])[anchor]  # one line for each window of the anchor
                    w = mine[np.repeat(starts[anchor] - np.cumsum(count) + count, count) + np.arange(count.sum())]
                    row, score = np.repeat(row, count), np.repeat(score, count)
                    good = (score >= low[w]) & (score <= block["high"][w])
                    row, score, w = row[good], score[good], w[good]
                    if len(w):
                        fresh.append(pd.DataFrame({"w": w, "uid": uid[row], "vec_id": vec_id[row], "score": score}))
                if len(fresh) > 1:
                    best = pd.concat(fresh).sort_values(["w", "score", "vec_id", "uid"], ascending=[True, False, True, True])
                    number = best.groupby("w").cumcount()
                    last = best[number == keep - 1]
                    best = best[number < keep]
                    # A window with enough rows here takes no lower score from this task.
                    low[last["w"].to_numpy()] = np.maximum(low[last["w"].to_numpy()], last["score"].to_numpy())
                    for a, mine, starts, index in parts:
                        index.raise_to(np.minimum.reduceat(low[mine], starts[:-1]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(block["window"][best["w"].to_numpy()]), *[pa.array(best[c].to_numpy()) for c in ("uid", "vec_id", "score")]],
            ["window", "uid", "vec_id", "score"])

    return scan


def hard_negatives(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding",
                   label_col: str = "label", positives: int = 5, negatives: int = 10,
                   least: int = 30, most: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows for which ``is_anchor``, over ``vec_id``, holds. A score is the inner product of
    components ``floor(256 * x)``; higher ones come first, ties by smaller id. An anchor's positives
    are its first ``positives`` other rows of its label; for each, its negatives are the first
    ``negatives`` rows of other labels with ``least`` to ``most`` percent of the positive's score.
    Fewer are returned where there are no more.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. A vector
    that is shorter than others ends in zeros. Rows that repeat an id are rows of their own. Scores
    are exact below 2 ** 53. A positive with a negative score has no negatives.
    """
    rows = written(usable(vectors, id_col, vector_col, label_col), "negatives-rows")
    join = Join(rows)
    sizes = rows.groupBy("label").agg((F.count("*") - 1).alias("rows"))
    anchors = written(rows.where(is_anchor).join(sizes, "label").select(
        F.col("uid").alias("window"), F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "q", "rows",
        F.lit(-UNBOUNDED).alias("low"), F.lit(UNBOUNDED).alias("high")), "negatives-anchors")
    near = join.first(anchors, positives, same=True).select(
        F.col("window").alias("anchor"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    windows = near.where("positive_score >= 0").join(anchors.select("anchor", "anchor_id", "label", "q"), "anchor").select(
        F.monotonically_increasing_id().alias("window"), "*",
        F.expr(f"({least} * positive_score + 99) div 100").alias("low"),
        F.expr(f"({most} * positive_score) div 100").alias("high"))
    windows = written(windows, "negatives-windows")
    found = join.first(windows.drop("anchor_id", "positive_id", "positive_score"), negatives, same=False)
    return found.join(windows.select("window", "anchor_id", "positive_id", "positive_score"), "window").select(
        "anchor_id", "positive_id", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
