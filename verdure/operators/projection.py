"""A learned projection of embeddings: the hidden layer of a small classifier."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdure.operators.sampling import drop_small_classes

LEAST_ROWS, LEAST_CLASSES, LEAST_OF_CLASS = 15, 2, 3


def _train(x: np.ndarray, y: np.ndarray, hidden: int, epochs: int, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of the hidden layer after full-batch steps with momentum."""
    rng = np.random.default_rng(seed)
    k = int(y.max()) + 1
    a, b = rng.normal(size=(x.shape[1], hidden)) * np.sqrt(2 / x.shape[1]), np.zeros(hidden)
    c, d = rng.normal(size=(hidden, k)) * np.sqrt(1 / hidden), np.zeros(k)
    moves = [np.zeros_like(p) for p in (a, b, c, d)]
    for _ in range(epochs):
        h = np.maximum(x @ a + b, 0)
        z = h @ c + d
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        back = (p @ c.T) * (h > 0)
        for param, move, grad in zip((a, b, c, d), moves, (x.T @ back, back.sum(0), h.T @ p, p.sum(0))):
            move *= 0.9
            move -= rate * grad
            param += move
    return a, b


def fit(rows: DataFrame, label: str, vector: str, *, hidden: int = 64, epochs: int = 200, rate: float = 0.5, most: int = 20_000, seed: int = 1) -> tuple[np.ndarray, np.ndarray] | None:
    """The projection learned from at most ``most`` labelled rows; None if there are too few rows or classes.

    Vectors with components that aren't finite count as zero; classes of under three rows are dropped.
    """
    kept = drop_small_classes(rows.where(F.col(label).isNotNull() & F.col(vector).isNotNull()), label, LEAST_OF_CLASS)
    some = kept.select(label, F.col(vector).cast("array<double>").alias("x")).orderBy(F.xxhash64(vector)).limit(most).collect()
    names = sorted({r[label] for r in some})
    if len(names) < LEAST_CLASSES or len(some) < LEAST_ROWS:
        return None
    x = np.array([r["x"] for r in some], float)
    x[~np.isfinite(x).all(axis=1)] = 0
    return _train(x, np.array([names.index(r[label]) for r in some]), hidden, epochs, rate, seed)


def project(rows: DataFrame, key: str, vector: str, weights: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """(key, v): the normalised hidden activations, or the vectors as they are without a projection."""
    if weights is None:
        return rows.select(key, F.col(vector).cast("array<double>").alias("v"))
    a, b = weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            bad = ~np.isfinite(x).all(axis=1)
            x[bad] = 0
            h = np.maximum(x @ a + b, 0)
            h /= np.maximum(np.linalg.norm(h, axis=1, keepdims=True), 1e-8)
            h[bad] = 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(h.reshape(-1)), h.shape[1]).cast(pa.list_(pa.float64()))], names=[key, "v"])

    kind = dict(rows.dtypes)[key]
    return rows.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>")).mapInArrow(run, f"`{key}` {kind}, v array<double>")
