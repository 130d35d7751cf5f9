"""Neighbour joins by metric partitioning: vectors meet those of the cells that may hold a neighbour.

Distances are computed within Arrow batches; only what a join returns becomes rows.
Vectors that are null or have a null or non-finite component take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdure.operators import pivots
from verdure.operators.pivots import Cells, finite
from verdure.session import cut

#: Rows of a block at least, and at most; between them a large table has ``SIDES`` blocks, so that each row goes to about as many, whatever their number.
BLOCK, MOST_ROWS, SIDES = 2048, 65_536, 12
#: A bank of at most so many numbers is broadcast whole.
BROADCAST = 4_000_000


def _rows(n: int) -> int:
    """Rows of a block for ``n`` vectors."""
    return max(BLOCK, min(MOST_ROWS, -(-n // SIDES)))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(c), -1) if len(c) else np.zeros((0, 1))


def _square(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances from differences, so that equal vectors are at 0; a matrix product would leave rounding."""
    out = np.empty((len(q), len(b)))
    for i, x in enumerate(q):
        d = b - x
        out[i] = np.einsum("ij,ij->i", d, d)
    return out


def _smallest(d: np.ndarray, k: int, ties: str) -> np.ndarray:
    d = np.sort(d)
    if ties == "distinct":
        d = np.unique(np.round(d, 9))
    return d[:k]


def knn_mean(queries: DataFrame, bank: DataFrame, k: int, ties: str = "rows") -> DataFrame:
    """(q_id, score): mean distance to the k nearest rows of the bank, or the k nearest distinct distances.

    queries (q_id, v), bank (row_id, v); k is at most the bank's size. A bank of checked,
    small size is broadcast; a larger one is searched by cells. An empty bank gives no rows.
    """
    if ties not in ("rows", "distinct"):
        raise ValueError("ties is rows or distinct")
    bank = bank.select("row_id", F.col("v").cast("array<double>").alias("v")).where(finite("v"))
    n, dim = bank.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    q = queries.select("q_id", F.col("v").cast("array<double>").alias("v")).where(finite("v"))
    if not n:
        return q.limit(0).select("q_id", F.lit(0.0).alias("score"))
    if n * dim <= BROADCAST:
        held = _matrix(bank.select("v").toArrow().column("v"))
        shared = q.sparkSession.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 256):
                    part = batch.slice(lo, 256)
                    d = np.sqrt(_square(_matrix(part.column(1)), shared.value))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_smallest(x, k, ties).mean() for x in d])], names=["q_id", "score"])

        return q.mapInArrow(run, f"q_id {dict(q.dtypes)['q_id']}, score double")
    near = k_nearest(q.withColumnRenamed("q_id", "id"), bank.withColumnRenamed("row_id", "id"), k, ties)
    return near.select(F.col("id").alias("q_id"), (F.aggregate("near", F.lit(0.0), lambda s, x: s + x) / F.size("near")).alias("score"))


def k_nearest(queries: DataFrame, bank: DataFrame, k: int, ties: str = "rows", others: bool = False, compared: Accumulator | None = None) -> DataFrame:
    """(id, near): the k smallest distances of each query to rows of the bank, in order, exactly; queries (id, v), bank (id, v).

    A query looks at its nearest cells first, until they hold k rows; the k-th distance
    found there is the radius within which every cell that may hold something nearer is
    looked at. ``others``: rows of the query's own id don't count. ``ties`` "distinct"
    counts equal distances once. ``compared`` adds up how many pairs met.
    """
    q = cut(queries.select("id", F.col("v").cast("array<double>").alias("v")).where(finite("v")))
    bank = bank.select("id", F.col("v").cast("array<double>").alias("v")).where(finite("v"))
    x, n = pivots.sample(bank, "id")
    if not n:
        return q.limit(0).select("id", F.array().cast("array<double>").alias("near"))
    # On the sample, the place of the k-th neighbour among fewer rows gives about its distance.
    d = np.sort(pivots.distances(x[:1024], x), axis=1)
    block = _rows(n)
    chosen = Cells(pivots.choose(x, n, d[:, min(len(x) - 1, max(1, round(k * len(x) / n)))] if len(x) > 1 else np.zeros(1), block))
    placed = cut(pivots.place(bank, "id", chosen))
    cells = pivots.measured(placed, chosen)
    want = k + bool(others)

    def first(cells: Cells, d: np.ndarray, radius: np.ndarray, off: float) -> np.ndarray:
        order = np.argsort(np.where(cells.count > 0, d, np.inf), axis=1, kind="stable")
        sofar = np.cumsum(cells.count[order], axis=1) - cells.count[order]
        out = np.zeros(d.shape, bool)
        np.put_along_axis(out, order, (sofar < want) & (cells.count[order] > 0), axis=1)
        return out

    def rest(cells: Cells, d: np.ndarray, radius: np.ndarray, off: float) -> np.ndarray:
        return cells.visits(d, radius, off) & ~first(cells, d, radius, off)

    kind = dict(q.dtypes)["id"]

    def near(asked: pa.Table, held: pa.Table) -> pa.Table:
        ids, radius, x, y = asked.column("id"), asked.column("r").to_numpy(), _matrix(asked.column("v")), _matrix(held.column("v"))
        same = held.column("id")
        at, found, n = [], [], np.zeros(len(x), np.int64)
        order = np.argsort(held.column("r").to_numpy())
        y, r = y[order], held.column("r").to_numpy()[order]
        names = same.to_numpy(zero_copy_only=False)[order]
        own = ids.to_numpy(zero_copy_only=False)
        met = 0
        for lo in range(0, len(x), 64):
            part = slice(lo, lo + 64)
            # Only rows whose distance to the pivot lies within the radius of the queries' own can be near.
            z = y
            which = names
            if len(z) and np.isfinite(radius[part]).all():
                to = pivots.distances(x[part], cells.pivots[[held.column("cell")[0].as_py()]])[:, 0]
                reach = radius[part] + 2 * pivots.slack(x[part], y)
                a, b = np.searchsorted(r, (to - reach).min()), np.searchsorted(r, (to + reach).max(), side="right")
                z, which = y[a:b], names[a:b]
            met += len(x[part]) * len(z)
            may = np.not_equal.outer(own[part], which) if others else np.ones((len(x[part]), len(z)), bool)
            i, dist = _nearest(x[part], z, may, k) if ties == "rows" else _every(x[part], z, may, k)
            n[part] = np.bincount(i, minlength=len(x[part]))
            found.append(dist)
        if compared is not None:
            compared.add(met)
        offsets = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
        return pa.table({"id": ids.combine_chunks(), "near": pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found) if found else np.zeros(0)))})

    def merged(rows: DataFrame) -> DataFrame:
        every = F.flatten(F.collect_list("near"))
        every = F.array_distinct(F.transform(every, lambda x: F.round(x, 9))) if ties == "distinct" else every
        return rows.groupBy("id").agg(F.slice(F.sort_array(every), 1, k).alias("near"))

    def search(asking: DataFrame, which) -> DataFrame:
        visits = cut(pivots.visiting(asking, "id", "radius", cells, which))
        return pivots.meet(visits, placed, cells, block, near, f"id {kind}, near array<double>")

    found = cut(merged(search(q.withColumn("radius", F.lit(float("inf"))), first)))
    # Fewer than k so far: everything is looked at.
    radius = F.when(F.size("near") < k, F.lit(float("inf"))).otherwise(F.element_at("near", -1) + (1e-9 if ties == "distinct" else 0.0))
    again = q.join(found.select("id", radius.alias("radius")), "id")
    return merged(found.union(search(again, rest)))


def _every(q: np.ndarray, b: np.ndarray, may: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of q, distance): its k smallest distinct distances to rows that it may meet."""
    at, out = [], []
    for i, d in enumerate(np.sqrt(_square(q, b))):
        near = _smallest(d[may[i]], k, "distinct")
        out.append(near)
        at.append(np.full(len(near), i))
    return (np.concatenate(at), np.concatenate(out)) if at else (np.zeros(0, np.int64), np.zeros(0))


def eps_pairs(points: DataFrame, eps: float, compared: Accumulator | None = None) -> DataFrame:
    """(a, b, d) for all pairs within ``eps``, each point with itself too; points (point_id, v)."""
    return eps_fold(points, eps, lambda a, b, d: (a, b, d), "a long, b long, d double", compared)


def eps_fold(points: DataFrame, eps: float, fold: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple], schema: str, compared: Accumulator | None = None, asking: DataFrame | None = None) -> DataFrame:
    """What ``fold`` makes of the pairs (a, b, d) within ``eps`` that meet in a block, so that only that leaves the task.

    Every pair is there in both directions, in one block or in two, each point with itself too.

    Each point meets the points of its own cell and of those, of smaller number, that the
    triangle inequality leaves; within a cell, those whose distances to the pivot differ by
    no more than ``eps``. ``compared`` adds up how many pairs met. Where only the points
    ``asking`` (point_id, v) look for others, pairs go from these to ``points`` alone.
    """
    p = points.select(F.col("point_id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).where(finite("v") & F.col("id").isNotNull())
    x, n = pivots.sample(p, "id")
    if not n:
        return p.sparkSession.createDataFrame([], schema)
    block = _rows(n)
    chosen = Cells(pivots.choose(x, n, np.full(len(x), float(eps)), block))
    placed = cut(pivots.place(p, "id", chosen))
    cells = pivots.measured(placed, chosen)

    names = [c.split()[0] for c in schema.split(", ")]
    both = asking is None

    def which(cells: Cells, d: np.ndarray, radius: np.ndarray, off: float) -> np.ndarray:
        home = d.argmin(axis=1)[:, None]
        other = np.arange(d.shape[1])[None, :]
        return cells.visits(d, radius, off) & (other < home) if both else cells.visits(d, radius, off)

    def pairs(asked: pa.Table, held: pa.Table) -> pa.Table:
        at = cells.pivots[[held.column("cell")[0].as_py()]] if held.num_rows else None
        x, y = _matrix(asked.column("v")), _matrix(held.column("v"))
        left, right = asked.column("id").to_numpy(), held.column("id").to_numpy()
        found, met = [], 0
        if len(x) and len(y):
            to, r = pivots.distances(x, at)[:, 0], held.column("r").to_numpy()
            rows, order = np.argsort(to), np.argsort(r)
            y, r, right = y[order], r[order], right[order]
            off = pivots.slack(x, y)
            # A visitor's pairs hold in both directions; points at home, whose radius is -1, ask for themselves.
            home = asked.column("r").to_numpy() < 0
            for lo in range(0, len(rows), 128):
                part = rows[lo : lo + 128]
                a, b = np.searchsorted(r, to[part[0]] - eps - 2 * off), np.searchsorted(r, to[part[-1]] + eps + 2 * off, side="right")
                met += len(part) * (b - a)
                i, j = np.nonzero(pivots.distances(x[part], y[a:b]) <= eps + off)
                i, j = part[i], j + a
                d = ((x[i] - y[j]) ** 2).sum(1)
                near = d <= eps * eps
                i, j, d = i[near], j[near], np.sqrt(d[near])
                found.append((left[i], right[j], d))
                if both:
                    out = ~home[i]
                    found.append((right[j[out]], left[i[out]], d[out]))
        if compared is not None:
            compared.add(int(met))
        a, b, d = (np.concatenate([f[k] for f in found]) if found else np.zeros(0) for k in range(3))
        return pa.table(dict(zip(names, map(pa.array, fold(a.astype(np.int64), b.astype(np.int64), d)))))

    come = p if both else asking.select(F.col("point_id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).where(finite("v") & F.col("id").isNotNull())
    visits = cut(pivots.visiting(come.withColumn("radius", F.lit(float(eps))), "id", "radius", cells, which))
    if both:
        visits = visits.union(placed.select("id", "v", F.lit(-1.0).alias("radius"), "cell"))
    return pivots.meet(visits, placed, cells, block, pairs, schema)


def kth_distance(points: DataFrame, k: int) -> DataFrame:
    """(point_id, d): the distance to the k-th nearest other point; points (point_id, v) with fewer than k others give no row."""
    p = points.select(F.col("point_id").cast("long").alias("id"), "v").where("id is not null")
    return k_nearest(p, p, k, others=True).where(F.size("near") >= k).select(F.col("id").alias("point_id"), F.element_at("near", k).alias("d"))


def _nearest(q: np.ndarray, b: np.ndarray, may: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of q, distance) to its k nearest rows of b that it may meet, in order.

    A matrix product chooses: all that its rounding leaves among the k nearest; distances come from differences.
    """
    q2, b2 = (np.einsum("ij,ij->i", x, x) for x in (q, b))
    if len(b) > k and np.isfinite(q2).all() and np.isfinite(b2).all():
        about = np.where(may, q2[:, None] + b2 - 2 * (q @ b.T), np.inf)
        slack = 16 * q.shape[1] * np.finfo(float).eps * (q2 + b2.max())
        may = may & (about <= (np.partition(about, k - 1, axis=1)[:, k - 1] + slack)[:, None])
    x, y = np.nonzero(may)
    d = np.sqrt(((b[y] - q[x]) ** 2).sum(1))
    order = np.lexsort((d, x))
    x, d = x[order], d[order]
    keep = np.arange(len(x)) - np.searchsorted(x, x) < k
    return x[keep], d[keep]
