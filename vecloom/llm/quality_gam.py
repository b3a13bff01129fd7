"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are binned at quantiles. Cyclic boosting goes round the features; each turn fits a tree of at most four leaves
to one feature's bins and adds it, shrunk, to that feature's lookup table. Then the PAIRS strongest pairs get tables of their own
from trees with a cut on each axis. A score is a sum of table entries, one bin look-up a table, through the logistic function.

Training takes at most SAMPLE_ROWS labelled rows, those of least hash of doc_id among rows with crc32(doc_id) mod 3 <> 1; scoring reads
every whole text. Neither doc_id, labels, lang nor source are features. Null and empty texts have features like any others (all
zero). Null labels and ids are not learnt from; of repeated labels all count. Without labels of both kinds the score is the share
of label 1, or 0.5. Columns besides those named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.llm.common import BLANK_WORDS, slices, text_bytes, trim

SAMPLE_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 120, 40, 0.15, 2.0

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "blank": b" \t\r\x0b\x0c", "line": b"\n",
    "stop": b".,;:?'\"()-", "bang": b"!", "bar": b"|", "mark": b"%$#&*", "other": b"<>{}[]=+/\\@^~`_", "wide": bytes(range(192, 256)),
}
NAMES = [*_CLASSES, "words", "word_len", "distinct", "top_word", "line_len", "lines_distinct"]


def features(text: pa.Array) -> np.ndarray:
    """(texts, features), float64."""
    out = np.zeros((len(text), len(NAMES)))
    for a, b in slices(text):
        raw, o = text_bytes(text.slice(a, b - a))
        size = np.maximum(np.diff(o), 1)
        f = out[a:b]
        counts = {}
        for i, (name, chars) in enumerate(_CLASSES.items()):
            table = np.zeros(256, np.int64)
            table[list(chars)] = 1
            total = np.concatenate([[0], np.cumsum(table[raw])])
            counts[name] = total[o[1:]] - total[o[:-1]]
            f[:, i] = counts[name] / size
        h, first = BLANK_WORDS.hashes(raw, o)
        n = np.diff(first)
        base = len(_CLASSES)
        f[:, base] = np.log1p(n)
        f[:, base + 1] = (size - counts["blank"] - counts["line"]) / np.maximum(n, 1)
        for r in np.flatnonzero(n):
            _, c = np.unique(h[first[r] : first[r + 1]], return_counts=True)
            f[r, base + 2], f[r, base + 3] = len(c) / n[r], c.max() / n[r]
        f[:, base + 4] = np.log1p(n / (counts["line"] + 1))
        for r, t in enumerate(text.slice(a, b - a).to_pylist()):
            lines = (t or "").split("\n")
            f[r, base + 5] = len(set(lines)) / len(lines)
    return out


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + RIDGE)


def _cut(g: np.ndarray, h: np.ndarray) -> int:
    """Where to part the bins in two, 0 for nowhere."""
    if len(g) < 2:
        return 0
    lg, lh = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    rg, rh = g.sum() - lg, h.sum() - lh
    gain = lg**2 / (lh + RIDGE) + rg**2 / (rh + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    return int(np.argmax(gain)) + 1 if gain.max() > 1e-9 else 0


def tree_steps(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Values by bin of a tree of the given depth over ordered bins."""
    at = _cut(g, h) if depth else 0
    if not at:
        return np.full(len(g), _leaf(g.sum(), h.sum()))
    return np.concatenate([tree_steps(g[:at], h[:at], depth - 1), tree_steps(g[at:], h[at:], depth - 1)])


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, table) of the best cut of a grid of bins on both axes."""
    cg, ch = (np.pad(x, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for x in (g, h))
    best, where = -1.0, (1, 1)
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            gain = 0.0
            for r0, r1 in ((0, i), (i, g.shape[0])):
                for c0, c1 in ((0, j), (j, g.shape[1])):
                    s, t = (x[r1, c1] - x[r0, c1] - x[r1, c0] + x[r0, c0] for x in (cg, ch))
                    gain += s * s / (t + RIDGE)
            if gain > best:
                best, where = gain, (i, j)
    table = np.zeros_like(g)
    i, j = where
    for r in (slice(0, i), slice(i, None)):
        for c in (slice(0, j), slice(j, None)):
            table[r, c] = _leaf(g[r, c].sum(), h[r, c].sum())
    return best, table


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    bias: float = 0.0
    edges: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    coarse: list = field(default_factory=list)
    pairs: dict = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for j, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(e, x[:, j], side="right")]
        for (i, j), t in self.pairs.items():
            z += t[tuple(np.searchsorted(self.coarse[k], x[:, k], side="right") for k in (i, j))]
        return _sigmoid(z)


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    if not len(y):
        return Model()
    p = y.mean()
    bias = float(np.log(p / (1 - p))) if 0 < p < 1 else float(np.clip((p - 0.5) * 80, -40, 40))
    if not 0 < p < 1:
        return Model(bias)
    quantiles = lambda n: [np.unique(np.quantile(x[:, j], np.linspace(0, 1, n + 1)[1:-1])) for j in range(x.shape[1])]
    m = Model(bias, quantiles(BINS), [], quantiles(PAIR_BINS))
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(m.edges)]
    z = np.full(len(y), bias)
    for _ in range(ROUNDS):
        for b, t in zip(bins, m.tables, strict=True):
            q = _sigmoid(z)
            step = RATE * tree_steps(np.bincount(b, y - q, len(t)), np.bincount(b, q * (1 - q), len(t)))
            t += step
            z += step[b]
    rough = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(m.coarse)]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray, tuple]:
        shape = (len(m.coarse[i]) + 1, len(m.coarse[j]) + 1)
        flat, q = rough[i] * shape[1] + rough[j], _sigmoid(z)
        size = shape[0] * shape[1]
        return np.bincount(flat, y - q, size).reshape(shape), np.bincount(flat, q * (1 - q), size).reshape(shape), shape

    many = [(i, j) for i in range(x.shape[1]) for j in range(i) if len(m.coarse[i]) and len(m.coarse[j])]
    chosen = sorted(many, key=lambda ij: -quadrants(*grid(*ij)[:2])[0])[:PAIRS]
    m.pairs = {ij: np.zeros(grid(*ij)[2]) for ij in chosen}
    for _ in range(PAIR_ROUNDS):
        for (i, j), t in m.pairs.items():
            g, h, _ = grid(i, j)
            step = RATE * quadrants(g, h)[1]
            t += step
            z += step[rough[i], rough[j]]
    return m


def fold(key: str = "doc_id") -> Column:
    """The held-out remainder: crc32 of the id as text, mod 3; null for null."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Model:
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    known = known.where((fold() != 1) & F.col("y").isin(0, 1))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)  # at most rows ids and labels: broadcast

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column(1))
            lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), lists], ["doc_id", "y", "h", "x"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("doc_id", "text", "y", F.xxhash64("text").alias("h"))
    rated = own.mapInArrow(scan, "doc_id long, y int, h long, x array<double>")
    # documents of one id are rows of their own: again the first by hashes, so that the model does not depend on the order of tasks
    got = rated.orderBy(F.xxhash64("doc_id"), "doc_id", "y", "h").limit(rows).toArrow()
    x = got["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(NAMES)) if len(got) else np.zeros((0, len(NAMES)))
    return fit(x, got["y"].to_numpy().astype(float))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score)"""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(features(b.column(1))))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted)"""
    out = scored(docs, train(docs, labels))
    return out.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, that score 0.5 or more. One pass, no join."""
    at = docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(at)):
                part = batch.slice(a, b - a)
                yield part.filter(pa.array(model.score(features(part.column(at))) >= 0.5))
        trim()

    return docs.mapInArrow(scan, docs.schema)
