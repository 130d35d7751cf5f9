"""Linear classifier heads: scoring, calibration, retraining."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdure.functions.vectors import dot
from verdure.session import cut

#: Partial gradients that come to the driver.
SUMS = 8


def classify(points: DataFrame, head: list[tuple[int, float, list[float]]], key: str, vector: str, healthy: int = 0) -> DataFrame:
    """(key, defect, best): 1 less the healthy class's softmax share, and the strongest other class, the first of equals.

    ``head`` holds (class, intercept, coefficients), a handful of rows; without the healthy class defect is 1.
    """
    x = F.col(vector).cast("array<double>")
    scores = F.array(*[F.struct(F.lit(c).alias("class"), (dot(x, F.lit(list(map(float, w)))) + F.lit(float(b))).alias("z")) for c, b, w in head])
    out = points.select(key, scores.alias("s"))
    top = F.array_max(F.transform("s", lambda e: e["z"]))
    out = out.withColumn("e", F.transform("s", lambda e: F.struct(e["class"].alias("class"), F.exp(e["z"] - top).alias("e"))))
    total = F.aggregate("e", F.lit(0.0), lambda a, e: a + e["e"])
    calm = F.aggregate(F.filter("e", lambda e: e["class"] == healthy), F.lit(0.0), lambda a, e: a + e["e"])
    defects = F.filter("e", lambda e: e["class"] != healthy)
    best = F.array_max(F.transform(defects, lambda e, i: F.struct(e["e"].alias("e"), (-i).alias("i"), e["class"].alias("class"))))["class"]
    return out.select(key, (1.0 - calm / total).alias("defect"), best.alias("best"))


def centroids(points: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, dim, mean, total): mean and sum of each component by class."""
    parts = points.select(label, F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "x"))
    return parts.groupBy(label, "dim").agg(F.avg("x").alias("mean"), F.sum("x").alias("total"))


def centroid_head(points: DataFrame, label: str, vector: str, target: float = 10.0) -> DataFrame:
    """(label, intercept, coef): target * c / |c| and -|c| * target / 2 of each class's mean c."""
    c = centroids(points, label, vector).groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "mean"))), lambda e: e["mean"]).alias("c"))
    n = F.sqrt(dot(F.col("c"), F.col("c")))
    return c.select(label, (-n * target / 2).alias("intercept"), F.transform("c", lambda x: x * target / F.greatest(n, F.lit(1e-12))).alias("coef"))


def atypicality(points: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """(key, score): 1 less the cosine-like product with the direction of the family's summed vectors."""
    total = centroids(points, label, vector).withColumn("norm", F.sqrt(F.sum(F.col("total") * F.col("total")).over(Window.partitionBy(label))))
    sums = total.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "total"))), lambda e: e["total"]).alias("c"), F.max("norm").alias("norm"))
    joined = points.join(sums, label)
    return joined.select(key, (1.0 - F.coalesce(F.try_divide(dot(F.col(vector), F.col("c")), F.col("norm")), F.lit(0.0))).alias("score"))


def retrain(
    rows: DataFrame, classes: list[int], start: np.ndarray, *, c: float = 10.0, crops: int = 1, anchor: float = 0.0, iterations: int = 50, memory: int = 8
) -> tuple[np.ndarray, list[float]]:
    """Weighted multinomial logistic regression, (coefficients and intercept by class, losses).

    rows (class, weight, x). The penalty pulls coefficients towards ``anchor`` times the
    starting ones, with strength 1 / (c * crops); intercepts are free. Classes without
    rows stay as they were; the intercept gradient is centred if there are any. The rows
    are kept in a table that every evaluation reads; it sums partial gradients on the
    executors, in two steps, so that at most ``SUMS`` of them come to the driver, where the
    L-BFGS steps run.
    """
    rows = cut(rows.select("class", "weight", "x"))
    k, d = len(classes), start.shape[1] - 1
    seen = {r["class"] for r in rows.select("class").distinct().collect()}
    free = np.array([x in seen for x in classes])
    index = {x: i for i, x in enumerate(classes)}

    def evaluate(w: np.ndarray) -> tuple[float, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, grad, weight = 0.0, np.zeros((k, d + 1)), 0.0
            for batch in batches:
                y = np.array([index[v] for v in batch.column("class").to_pylist()], int)
                s = batch.column("weight").to_numpy(zero_copy_only=False).astype(float)
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(y), d)
                z = x @ w[:, :d].T + w[:, d]
                z -= z.max(axis=1, keepdims=True)
                p = np.exp(z)
                p /= p.sum(axis=1, keepdims=True)
                loss -= float((s * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum())
                p[np.arange(len(y)), y] -= 1
                p *= s[:, None]
                grad[:, :d] += p.T @ x
                grad[:, d] += p.sum(axis=0)
                weight += float(s.sum())
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([weight]), pa.array([grad.tobytes()], pa.binary())], names=["loss", "weight", "grad"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, weight, grad = 0.0, 0.0, np.zeros(k * (d + 1))
            for batch in batches:
                loss, weight = loss + sum(batch.column("loss").to_pylist()), weight + sum(batch.column("weight").to_pylist())
                for x in batch.column("grad"):
                    grad = grad + np.frombuffer(x.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([weight]), pa.array([grad.tobytes()], pa.binary())], names=["loss", "weight", "grad"])

        schema = "loss double, weight double, grad binary"
        parts = rows.mapInArrow(run, schema).repartition(SUMS).mapInArrow(add, schema).collect()
        total = max(sum(r["weight"] for r in parts), 1e-12)
        loss = sum(r["loss"] for r in parts) / total
        grad = sum(np.frombuffer(r["grad"]).reshape(k, d + 1) for r in parts) / total
        pull = w[:, :d] - anchor * start[:, :d]
        strength = 1 / (c * max(crops, 1))
        loss += 0.5 * strength * float((pull[free] ** 2).sum())
        grad[:, :d] += strength * pull
        grad[~free] = 0
        if not free.all():
            grad[free, d] -= grad[free, d].mean()
        return loss, grad

    w = start.astype(float).copy()
    loss, grad = evaluate(w)
    losses, past = [loss], []
    for _ in range(iterations):
        q = grad.ravel().copy()
        alphas = []
        for s, y in reversed(past):
            a = (s @ q) / (y @ s)
            q -= a * y
            alphas.append(a)
        if past:
            s, y = past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(alphas)):
            q += s * (a - (y @ q) / (y @ s))
        step, slope = 1.0, float(grad.ravel() @ q)
        while True:
            new = w - step * q.reshape(w.shape)
            new_loss, new_grad = evaluate(new)
            if new_loss <= loss - 1e-4 * step * slope or step < 1e-6:
                break
            step /= 2
        s, y = (new - w).ravel(), (new_grad - grad).ravel()
        if s @ y > 1e-12:
            past = [*past, (s, y)][-memory:]
        done = abs(loss - new_loss) < 1e-9 * max(abs(loss), 1.0)
        w, loss, grad = new, new_loss, new_grad
        losses.append(loss)
        if done:
            break
    return w, losses


def false_positive_change(before: Column, after: Column) -> Column:
    """Verdict on a change of a false-positive rate, in half points of a percent."""
    d = (after - before) * 100.0
    return F.when(d > 0.5, "worse").when(d < -0.5, "better").otherwise("same")
