"""Approximate nearest neighbours by adaptive dimension scan.

Vectors are dealt to lists around centroids. A query probes the lists nearest to
it. Within a probed list, vectors are rotated at random and read in blocks of
columns: after each block a hypothesis test on the partial distance gives up
candidates that are very unlikely to be among the nearest, so that most are
dropped after a few columns. What survives is measured in double precision on
the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdure.llm.store import Store

#: Vectors that one task holds at once.
CHUNK = 4096
#: Numbers of a block of distances.
CELLS = 1 << 21


def rotation(dim: int, seed: int = 1) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def lists_of(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, in blocks of bounded size."""
    norms, step = (centroids * centroids).sum(1), max(1, CELLS // len(centroids))
    return np.concatenate([np.argmin(norms - 2 * (x[lo : lo + step] @ centroids.T), axis=1) for lo in range(0, len(x), step)] or [np.zeros(0, np.int64)])


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Centroids of a bounded sample."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = lists_of(x, c)
        n = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        full = n > 0
        sums = np.add.reduceat(x[order], np.concatenate(([0], np.cumsum(n)[:-1]))[full], axis=0)
        c[full] = sums / n[full, None]
    return c


def true_neighbours(judges: np.ndarray, own: np.ndarray, centroids: np.ndarray, k: int):
    """For each partition its k nearest rows to each judge: the judge's number, the distance, and the list of the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q2, step = (judges * judges).sum(1), max(1, CELLS // len(judges))
        best = np.full((len(judges), k), np.inf)
        held = np.zeros((len(judges), k, judges.shape[1]))
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                m, ids = _matrix(part.column("v")), part.column("vec_id").to_numpy()
                d = np.maximum(q2[:, None] + (m * m).sum(1) - 2 * (judges @ m.T), 0)
                d[own[:, None] == ids] = np.inf
                both = np.concatenate([best, d], axis=1)
                near = np.argpartition(both, k - 1, axis=1)[:, :k]
                old = np.take_along_axis(held, np.minimum(near, k - 1)[:, :, None], axis=1)
                held = np.where((near < k)[:, :, None], old, m[np.maximum(near - k, 0)])
                best = np.take_along_axis(both, near, axis=1)
        q, at = np.nonzero(np.isfinite(best))
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(best[q, at]), pa.array(lists_of(held[q, at], centroids), pa.int64())], names=["judge", "d", "list"])

    return run


def probes_for(judges: np.ndarray, centroids: np.ndarray, judge: np.ndarray, lists: np.ndarray, recall: float) -> int:
    """Lists to probe so that this share of the judges' true neighbours, found by brute force, lies in them."""
    order = np.argsort(np.argsort((centroids * centroids).sum(1) - 2 * (judges @ centroids.T), axis=1, kind="stable"), axis=1)
    ranks = order[judge, lists]
    return int(np.quantile(ranks, recall, method="higher")) + 1 if ranks.size else 1


def scan_lists(queries: np.ndarray, probed: list[np.ndarray], vectors: np.ndarray, ids: np.ndarray, lists: np.ndarray, own: np.ndarray, k: int, turn: np.ndarray, width: int = 16, z: float = 3.0) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query its k nearest (squared distances, ids) in its probed lists, ties to smaller ids; never its own id."""
    dim = vectors.shape[1]
    q, v = (queries @ turn).astype(np.float32), np.ascontiguousarray((vectors @ turn).astype(np.float32).T)
    out = []
    for i in range(len(q)):
        alive = np.flatnonzero((ids != own[i]) & np.isin(lists, probed[i]))
        # The first k candidates, whole, set the threshold.
        first = alive[:: max(1, len(alive) // (4 * k))]
        d = ((vectors[first] - queries[i]) ** 2).sum(axis=1)
        top = np.sort(d)[k - 1] if len(d) >= k else np.inf
        part = np.zeros(len(alive), np.float32)
        for lo in range(0, dim, width):
            hi = min(lo + width, dim)
            block = v[lo:hi, alive] - q[i, lo:hi, None]
            part = part + np.einsum("ij,ij->j", block, block)
            if hi < dim and np.isfinite(top):
                # Under the hypothesis that it is near enough, hi of dim columns hold hi / dim of the distance, give or take z deviations.
                bound = top * hi / dim * (1 + z * np.sqrt(2 / hi * (1 - hi / dim))) * 1.0001
                keep = part <= bound
                alive, part = alive[keep], part[keep]
        if np.isfinite(top):
            alive = alive[part <= top * 1.001 + 1e-9]
        d = ((vectors[alive] - queries[i]) ** 2).sum(axis=1)
        order = np.lexsort((ids[alive], d))[:k]
        out.append((d[order], ids[alive][order]))
    return out


def _valid(v: Column) -> Column:
    return v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = c.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(c), -1) if len(c) else np.zeros((0, 1))


def nearest(
    vectors: DataFrame, query: Column, *, k: int = 10, sample: int = 20_000, list_rows: int = 100, most_lists: int = 4096, recall: float = 0.96, judges: int = 128,
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for each row of ``vectors`` (vec_id, embedding) that ``query`` selects.

    The score is the Euclidean distance of the original vectors in double precision; ties
    go to the smaller vec_id; a query's own row is no candidate. Every valid row is
    indexed; centroids are learned from at most about ``sample`` rows. Each query probes as
    many lists as hold the share ``recall`` of the true neighbours, among all rows, of
    ``judges`` rows of that sample. Vectors that are null, empty, zero, of another length than most or that hold null or non-finite components take no part, nor do
    rows with a null vec_id. Rows that repeat a vec_id are candidates each, but never of
    a query with that id. An empty table gives no rows; further columns are not read.
    """
    spark = vectors.sparkSession
    store = Store(spark, "ann")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), query.alias("is_query"))
    rows = rows.where(F.col("vec_id").isNotNull() & _valid(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    dim, n = sizes[0]["d"], sizes[0]["count"]
    rows = rows.where(F.size("v") == dim)
    share = min(1.0, sample / n)
    h = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1_000_000))
    learned = rows.where(h < int(share * 1_000_000)).select("vec_id", "v").toArrow()
    x, ids = _matrix(learned.column("v")).reshape(-1, dim), learned.column("vec_id").to_numpy()
    # A vector that is repeated very often is one point to learn from.
    x, first = np.unique(x, axis=0, return_index=True)
    ids = ids[first]
    if not len(x):
        x, ids = np.ones((1, dim)), np.full(1, -1)
    lists = int(min(most_lists, len(x), max(1, n // list_rows)))
    centroids = kmeans(x, lists)
    some = np.random.default_rng(2).permutation(len(x))[:judges]
    judged = Window.partitionBy("judge").orderBy("d", "list")
    near = rows.select("vec_id", "v").mapInArrow(true_neighbours(x[some], ids[some], centroids, k), "judge long, d double, list long")
    near = near.withColumn("r", F.row_number().over(judged)).where(F.col("r") <= k).select("judge", "list").toArrow()
    probes = min(lists, probes_for(x[some], centroids, near.column("judge").to_numpy(), near.column("list").to_numpy(), recall))
    turn = rotation(dim)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, CELLS // lists)
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                m = _matrix(part.column("v"))
                d = (centroids * centroids).sum(1) - 2 * (m @ centroids.T)
                near = np.argpartition(d, min(probes, lists) - 1, axis=1)[:, :probes]
                asks = part.column("is_query").to_numpy(zero_copy_only=False)
                probed = pa.array([row if ask else None for row, ask in zip(near.astype(np.int32).tolist(), asks)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), pa.array(d.argmin(axis=1).astype(np.int32)), probed], names=["vec_id", "v", "list", "probed"])

    rows = rows.withColumn("is_query", F.coalesce("is_query", F.lit(False)))
    dealt = store.save(rows.mapInArrow(assign, "vec_id long, v array<double>, list int, probed array<int>"), "dealt")
    # Lists are dealt to tasks by their sizes, at most ``most_lists`` numbers: small ones share
    # a task, so that a query brings back its nearest of them all; a large one takes several.
    task, tasks_of, free, room = 0, {}, 0, 0
    for r in sorted(dealt.groupBy("list").count().collect()):
        if r["count"] > CHUNK:
            n_parts = -(-r["count"] // CHUNK)
            tasks_of[r["list"]], task = (task, n_parts), task + n_parts
            continue
        if room < r["count"]:
            free, room, task = task, CHUNK, task + 1
        tasks_of[r["list"]] = (free, 1)
        room -= r["count"]
    places = spark.createDataFrame([(a, t, n) for a, (t, n) in tasks_of.items()], "list int, first int, n int")
    held = dealt.join(F.broadcast(places), "list").select((F.col("first") + F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("n"))).cast("int").alias("task"), F.lit(False).alias("asks"), "vec_id", "v", F.array("list").alias("lists"))
    asked = dealt.where("probed is not null").select("vec_id", "v", F.explode("probed").alias("list")).join(F.broadcast(places), "list")
    asked = asked.select("vec_id", "v", "list", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("task"))
    asked = asked.groupBy("task", "vec_id", "v").agg(F.collect_list("list").alias("lists")).select("task", F.lit(True).alias("asks"), "vec_id", "v", "lists")

    def search(key: tuple, table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        ids, m = table.column("vec_id").to_numpy(), _matrix(table.column("v"))
        lists = table.column("lists").to_pylist()
        own, at = ids[asks], np.array([x[0] for x, a in zip(lists, asks) if not a], np.int32)
        found = scan_lists(m[asks], [np.array(x) for x, a in zip(lists, asks) if a], m[~asks], ids[~asks], at, own, k, turn) if (~asks).any() and len(own) else []
        n_found = [len(d) for d, _ in found]
        none = np.zeros(0)
        return pa.table({
            "query_id": pa.array(np.repeat(own[: len(found)], n_found) if found else np.zeros(0, np.int64), pa.int64()),
            "vec_id": pa.array(np.concatenate([i for _, i in found] or [none]).astype(np.int64)), "score": pa.array(np.sqrt(np.concatenate([d for d, _ in found] or [none]))),
        })

    near = held.union(asked).groupBy("task").applyInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
