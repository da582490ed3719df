"""Quality classifier: Bradley-Terry ranking of documents by features of their whole texts.

Preference pairs (a document of label 1 over one of label 0) give a logistic loss on feature
differences; Newton steps fit the weights. The threshold is a quantile of the training
scores, the one that separates the labels best, and scores map to 0..1 so that it falls on
``THRESHOLD``.

Learning uses about ``sample_rows`` labelled rows and 64 MB of text of each label (chosen by hash of
the id, then of id and text) and ``pairs`` pairs drawn from them with a fixed seed; every document is scored.

Cases: null and empty texts are scored as texts without words; without rows of both labels
every score is 0.5; labels other than 0 and 1 are left out; repeated label rows count once, documents that share a
labelled id each count; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidemark.llm.common import byte_view, column, held_out, slices, small_batches
from tidemark.llm.language_id import bounded_sample
from tidemark.llm.shingles import words

THRESHOLD = 0.7
_CLASS = np.zeros((256, 7), np.float32)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"|", b"#$%&*@^~<>{}[]\\=+", b"!?", b".,;:", b"\n")):
    _CLASS[list(_chars), _i] = 1
_NAMES = ("upper", "digits", "bars", "symbols", "shouts", "stops", "lines")


def features(text: pa.Array) -> np.ndarray:
    """One row of features a text: shares of byte classes, word lengths, repetition."""
    out = []
    for _, part in slices(text):
        raw, ends = byte_view(part)
        n = np.diff(ends)
        # running sums by class give each text's counts, empty texts included
        shares = np.empty((len(n), _CLASS.shape[1]))
        for i in range(_CLASS.shape[1]):
            total = np.concatenate([[0], np.cumsum(_CLASS[:, i][raw], dtype=np.float64)])
            shares[:, i] = np.diff(total[ends]) / np.maximum(n, 1)
        hashes, first = words(part)
        count = np.diff(first)
        same = np.concatenate([[0], np.cumsum(np.concatenate([[False], hashes[1:] == hashes[:-1]]))]) if len(hashes) else np.zeros(1)
        repeats = (same[first[1:]] - same[first[:-1]]) / np.maximum(count, 1)
        distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(first[:-1].tolist(), first[1:].tolist())])
        sizes = np.log1p(count)
        rows = [shares, np.log1p(40 * shares), repeats[:, None], np.log1p(40 * repeats)[:, None], (distinct / np.maximum(count, 1))[:, None], (distinct / np.maximum(count, 1) * sizes)[:, None], sizes[:, None], (n / np.maximum(count, 1))[:, None] / 10, (count == 0)[:, None]]
        out.append(np.hstack(rows))
    return np.vstack(out) if out else np.zeros((0, 2 * len(_NAMES) + 7))


@dataclass(frozen=True)
class Ranking:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float
    scale: float

    def score(self, x: np.ndarray) -> np.ndarray:
        s = np.clip((x - self.mean) / self.spread, -8, 8) @ self.weights
        z = (s - self.cut) / self.scale + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, pairs: int = 60_000, ridge: float = 1e-3, steps: int = 12, seed: int = 17) -> Ranking | None:
    """Weights of the ranking from features and labels of the sample."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.clip((x - mean) / spread, -8, 8)
    draw = np.random.default_rng(seed)
    d = z[draw.choice(good, pairs)] - z[draw.choice(bad, pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))  # chance given to the wrong order
        gradient = -(d.T @ p) / pairs + ridge * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w))
        w = w - np.linalg.solve(hessian, gradient)
    s = z @ w
    # candidates for the threshold: quantiles of the sample's scores
    grid = np.quantile(s, np.linspace(0.002, 0.998, 499))
    ranked_bad, ranked_good = np.sort(s[bad]), np.sort(s[good])
    right = np.searchsorted(ranked_bad, grid) / len(bad) + 1 - np.searchsorted(ranked_good, grid) / len(good)
    best = np.flatnonzero(right >= right.max() - 1e-9)
    return Ranking(mean, spread, w, float(grid[best[len(best) // 2]]), float(s.std() / 4 + 1e-9))


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000) -> Ranking | None:
    """Fit on a bounded sample of labelled documents; only its features come to the driver."""
    small_batches(docs.sparkSession)
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "quality")
    sample = bounded_sample(marked, "quality", sample_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # a few thousand ids and labels
    rows = bounded_sample(rows, "quality", sample_rows)  # an id may have any number of rows
    width = features(pa.array([""])).shape[1]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(column(batch, "text"))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "quality").cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    found = rows.mapInArrow(measure, T.StructType([docs.schema["doc_id"], T.StructField("quality", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])).orderBy("doc_id", "quality").toArrow()
    x = np.array(found.column("x").to_pylist(), float).reshape(-1, width)
    return fit(x, found.column("quality").to_numpy())


def score(docs: DataFrame, ranking: Ranking | None) -> DataFrame:
    """doc_id, score and predicted of every document."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(column(batch, "text"))
            s = ranking.score(x) if ranking is not None else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(s, pa.float64())], names=schema.names)

    found = docs.select("doc_id", "text").mapInArrow(rate, schema)
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def predict_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from labels that are not held out, score all documents."""
    ranking = learn(docs, labels.where(~held_out(F.col("doc_id"))))
    return score(docs, ranking).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
