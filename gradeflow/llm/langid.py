"""Language of documents: a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from .common import flat_bytes, small_blocks

HIDDEN = 8
SPAN = 32           # bytes that the network sees at a time
SAMPLE_ROWS = 400   # training documents per language
SNIPPET = 512       # bytes or characters of each, from a place drawn by hash
STEPS = 240
BATCH = 256
LANES = 8192        # spans labelled together


def _gates(x: np.ndarray, p: dict, side: str, keep: bool):
    """Hidden states (time, lanes, hidden) over byte codes ``x`` (time, lanes)."""
    h_size = p["U" + side].shape[0]
    h = np.zeros((x.shape[1], h_size), np.float32)
    out = np.empty((*x.shape, h_size), np.float32)
    held = []
    for t in (range(len(x)) if side == "f" else range(len(x) - 1, -1, -1)):
        given = p["W" + side][x[t]]
        zr = given[:, :2 * h_size] + h @ p["U" + side]
        np.tanh(zr, out=zr)  # a logistic gate is (1 + tanh) / 2
        zr += 1
        zr *= 0.5
        z, r = zr[:, :h_size], zr[:, h_size:]
        rh = r * h
        c = np.tanh(given[:, 2 * h_size:] + rh @ p["V" + side])
        new = c + z * (h - c)
        if keep:
            held.append((t, h, z, r, rh, c))
        out[t] = h = new
    return out, held


def label_positions(x: np.ndarray, p: dict, keep: bool = False):
    """Probability of each language at each position; code 256 is padding and is never a byte."""
    f, held_f = _gates(x, p, "f", keep)
    b, held_b = _gates(x, p, "b", keep)
    both = np.concatenate([f, b], axis=2)
    score = both @ p["O"] + p["o"]
    score -= score.max(axis=2, keepdims=True)
    np.exp(score, out=score)
    score /= score.sum(axis=2, keepdims=True)
    return score, both, held_f, held_b


def gradients(x: np.ndarray, y: np.ndarray, p: dict) -> tuple[float, dict]:
    """Mean cross entropy over all positions, and its gradient by backpropagation through time."""
    prob, both, held_f, held_b = label_positions(x, p, True)
    real = (x < 256)
    count = max(1, real.sum())
    lanes = np.arange(x.shape[1])
    loss = -(np.log(prob[:, lanes, y] + 1e-9) * real).sum() / count
    d = prob.copy()
    d[:, lanes, y] -= 1
    d *= (real / count).astype(np.float32)[:, :, None]
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["O"] = np.einsum("tlh,tlc->hc", both, d)
    g["o"] = d.sum(axis=(0, 1))
    back = d @ p["O"].T
    n = p["Uf"].shape[0]
    for side, held, part in (("f", held_f, back[:, :, :n]), ("b", held_b, back[:, :, n:])):
        U, V = p["U" + side], p["V" + side]
        dh = np.zeros_like(held[0][1])
        for t, h, z, r, rh, c in reversed(held):
            dh = dh + part[t]
            dc = dh * (1 - z) * (1 - c * c)
            drh = dc @ V.T
            dz = dh * (h - c) * z * (1 - z) * 2
            dr = drh * h * r * (1 - r) * 2
            dzr = np.concatenate([dz, dr], axis=1)
            g["U" + side] += h.T @ dzr
            g["V" + side] += rh.T @ dc
            np.add.at(g["W" + side], x[t], np.concatenate([dzr, dc], axis=1))
            dh = dh * z + drh * r + dzr @ U.T
    return float(loss), g


def train(texts: list[bytes], labels: np.ndarray, classes: int, hidden: int = HIDDEN, steps: int = STEPS,
          seed: int = 7) -> dict:
    rng = np.random.default_rng(seed)

    def drawn(*shape):
        return (rng.standard_normal(shape) * 0.3).astype(np.float32)

    p = {"O": drawn(2 * hidden, classes), "o": np.zeros(classes, np.float32)}
    for side in "fb":
        p |= {"W" + side: drawn(257, 3 * hidden), "U" + side: drawn(hidden, 2 * hidden), "V" + side: drawn(hidden, hidden)}
    by_class = [np.flatnonzero(labels == c) for c in range(classes)]
    m, v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
    for step in range(1, steps + 1):
        y = rng.integers(0, classes, BATCH)
        x = np.full((SPAN, BATCH), 256, np.int64)
        for lane, c in enumerate(y):
            text = texts[by_class[c][rng.integers(len(by_class[c]))]]
            at = rng.integers(0, max(1, len(text) - SPAN + 1))
            piece = text[at:at + SPAN]
            x[:len(piece), lane] = np.frombuffer(piece, np.uint8)
        _, g = gradients(x, y, p)
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        rate = 0.03 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k in p:
            a = g[k] * min(1.0, 1.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * a
            v[k] = 0.99 * v[k] + 0.01 * a * a
            p[k] = p[k] - np.float32(rate) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)
            p[k] = p[k].astype(np.float32)
    return p


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, label_col: str = "lang", text_col: str = "text", rows: int = SAMPLE_ROWS) -> tuple[dict, list[str]]:
    """Network and languages, from at most ``rows`` documents of each language.

    Rows without label or text are not used. The sample is drawn by a hash of the text, and of
    each document ``SNIPPET`` characters from a place that the hash gives. Without any row the
    languages are empty and nothing can be predicted.
    """
    drawn = docs.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text")).where(
        "label is not null and length(text) > 0").withColumn("draw", F.xxhash64("text"))
    place = F.expr(f"cast(1 + pmod(draw, greatest(1, length(text) - {SNIPPET - 1})) as int)")
    best = (drawn.select("label", "draw", F.substring("text", place, F.lit(SNIPPET)).alias("piece"))
            .withColumn("n", F.expr("row_number() over (partition by label order by draw, piece)"))
            .where(F.col("n") <= rows).select("label", "piece"))
    found = sorted((r.label, r.piece) for r in best.collect())  # bounded: rows per language
    languages = sorted({label for label, _ in found})
    if not languages:
        return {}, []
    labels = np.array([languages.index(label) for label, _ in found])
    return train([piece.encode() for _, piece in found], labels, len(languages)), languages


def pooled(block: pa.RecordBatch, p: dict) -> np.ndarray:
    """Mean probability of each language over all bytes of each text; zero for an empty text."""
    buf, offsets = flat_bytes(block.column("text"))
    sizes = np.diff(offsets)
    lanes = (sizes + SPAN - 1) // SPAN
    doc = np.repeat(np.arange(len(sizes)), lanes)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    start = offsets[doc] + within * SPAN
    size = np.minimum(offsets[doc + 1] - start, SPAN)
    padded = np.concatenate([buf, np.zeros(SPAN, np.uint8)])
    total = np.zeros((len(sizes), len(p["o"])))
    for at in range(0, len(doc), LANES):
        some = slice(at, at + LANES)
        steps = np.arange(SPAN)[:, None]
        real = steps < size[some][None, :]
        x = np.where(real, padded[start[some][None, :] + steps].astype(np.int64), 256)
        prob = label_positions(x, p)[0]
        lane = (prob * real[:, :, None]).sum(axis=0)
        for c in range(total.shape[1]):
            total[:, c] += np.bincount(doc[some], lane[:, c], len(sizes))
    return total / np.maximum(1, sizes)[:, None]


def identify(docs: DataFrame, network: dict, languages: list[str], id_col: str = "doc_id",
             text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, lang_pred, score; with ``carry`` also the row itself as struct ``row``.

    Every byte of a text is labelled and the probabilities are averaged; the score is the mean
    probability of the predicted language. Null text and text without a letter is ``und`` with
    score 0. One row per row of ``docs``, no shuffle; equal means go to the first language.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False)).alias("lettered"),
                       *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in small_blocks(batches):
            mean = pooled(block, network) if languages else np.zeros((block.num_rows, 1))
            best = mean.argmax(axis=1)
            sure = [bool(languages) and x for x in block.column("lettered").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array([languages[b] if s else "und" for b, s in zip(best, sure)], pa.string()),
                 pa.array([float(min(1.0, mean[i, b])) if s else 0.0 for i, (b, s) in enumerate(zip(best, sure))], pa.float64()),
                 *([block.column("row")] if carry else [])],
                ["doc_id", "lang_pred", "score"] + (["row"] if carry else []))

    schema = StructType.fromDDL("doc_id long, lang_pred string, score double")
    return rows.mapInArrow(run, schema.add(rows.schema["row"]) if carry else schema)
