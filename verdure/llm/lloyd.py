"""Centroid clustering by Lloyd's rounds that touch only what changed.

Vectors are whole numbers, so that distances, sums and means are exact and do not depend
on how the rows lie. A table keeps each vector with its owner and their distance; the
driver keeps the clusters' sums and sizes, whose number and length are parameters. In a
round a vector is compared with the centroids that changed since the last one. Only if
its own centroid moved away from it are the unchanged ones compared as well: as long as
it did not, none of them can have come nearer than the owner. Vectors that change
their owner are added up by the task that sees them, as signed transfers between
clusters: a task gives two rows for each cluster at most, in the same write as its
vectors. A round that moves no centroid ends the work, as further ones would repeat it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdure.llm.store import Store

#: Components beyond this have no squared distance in 64 bits: 64 * (2 * LIMIT)**2 = 2**62.
LIMIT = 1 << 27
#: Vectors that are compared at once.
BLOCK = 1024

_STATE = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("v", T.BinaryType()), T.StructField("owner", T.IntegerType()), T.StructField("distance", T.LongType()),
    T.StructField("sums", T.ArrayType(T.LongType())), T.StructField("kind", T.IntegerType()),
])


def _rows(ids: pa.Array, v: np.ndarray, owner: np.ndarray, distance: np.ndarray) -> pa.RecordBatch:
    """Vectors with owner and distance, as rows of kind 0."""
    data = np.ascontiguousarray(v.astype("<i4"))
    width = data.shape[1] * 4
    packed = pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer((np.arange(len(data) + 1) * width).astype(np.int32)), pa.py_buffer(data.view(np.uint8).reshape(-1))])
    return pa.RecordBatch.from_arrays([ids, packed, pa.array(owner.astype(np.int32)), pa.array(distance), pa.nulls(len(data), pa.list_(pa.int64())), pa.array(np.zeros(len(data), np.int32))], names=_STATE.names)


def _whole(dim: int, scale: int):
    """Vectors of ``dim`` finite components as floor(scale * x); all others are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                ids, col = batch.column(0).slice(lo, BLOCK), batch.column(1).slice(lo, BLOCK)
                fits = pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(col), dim), False)
                ids, col = ids.filter(fits), col.filter(fits)
                x = col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) * float(scale)
                good = (np.abs(x) <= LIMIT).all(axis=1)  # false for null and non-finite components
                n = int(good.sum())
                if n:
                    yield _rows(ids.filter(pa.array(good)), np.floor(x[good]), np.full(n, -1), np.zeros(n, np.int64))

    return run


def _squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(vectors, centroids) squared distances, exactly."""
    out = np.empty((len(v), len(c)), np.int64)
    for j, x in enumerate(c):
        d = v - x
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


def assign(v: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New owners and distances, from those before some of the centroids changed; an owner of -1 is none."""
    far = np.iinfo(np.int64).max
    d = np.full((len(v), len(centroids)), far)
    d[:, changed] = _squares(v, centroids[changed])
    at = np.arange(len(v))
    owned = owner >= 0
    kept = owned & ~changed[owner]
    d[at[kept], owner[kept]] = distance[kept]
    # The owner moved, and not towards the vector: what did not change may be nearer now.
    open_ = ~owned | (changed[owner] & (d[at, owner] > distance))
    if open_.any() and not changed.all():
        d[np.ix_(open_, ~changed)] = _squares(v[open_], centroids[~changed])
    best = d.argmin(axis=1)  # the smallest number among ties
    return best, d[at, best]


def _round(centroids: np.ndarray, changed: np.ndarray):
    """One pass: vectors with new owners, then this task's transfers, as rows of kind 1 (cluster, count, sums)."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                v = np.frombuffer(b"".join(part.column(1).to_pylist()), "<i4").reshape(-1, dim).astype(np.int64)
                owner = part.column(2).to_numpy()
                best, distance = assign(v, owner, part.column(3).to_numpy(), centroids, changed)
                went = np.flatnonzero(best != owner)
                for side, sign in ((best[went], 1), (owner[went], -1)):
                    order = np.argsort(side, kind="stable")
                    which, first = np.unique(side[order], return_index=True)
                    if len(which):
                        added, n = np.add.reduceat(v[went[order]], first, axis=0), np.diff(np.append(first, len(order)))
                        real = which >= 0
                        sums[which[real]] += sign * added[real]
                        counts[which[real]] += sign * n[real]
                yield _rows(part.column(0), v, best, distance)
        some = np.flatnonzero((counts != 0) | (sums != 0).any(axis=1))
        if len(some):
            yield pa.RecordBatch.from_arrays([
                pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.binary()), pa.array(some.astype(np.int32)), pa.array(counts[some]),
                pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * dim, pa.int32()), pa.array(sums[some].reshape(-1))), pa.array(np.ones(len(some), np.int32)),
            ], names=_STATE.names)

    return run


def _write(df: DataFrame, store: Store, name: str) -> DataFrame:
    """Vectors and transfers go to folders of their own in one job."""
    df.write.partitionBy("kind").parquet(store.path(name))
    store.saved.add(name)
    return df.sparkSession.read.schema(_STATE).parquet(store.path(name))


def _vectors(state: DataFrame) -> DataFrame:
    return state.where("kind = 0").select("vec_id", "v", "owner", "distance")


def clusters(vectors: DataFrame, *, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, salt: str = "3:") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each vector of ``vectors`` (vec_id, embedding).

    Vectors of exactly ``dim`` components, none null or non-finite, take part, as whole
    numbers floor(scale * x). Centroids begin as the k vectors of the smallest lowercase
    hexadecimal sha256 of ``salt`` and the decimal vec_id; ties of repeated ids go by the vectors' stored bytes.
    Each of ``rounds`` rounds assigns every vector to its nearest centroid by squared
    distance, ties to the smaller number, and sets each non-empty centroid to the
    componentwise floor of the mean; then vectors are assigned once more.

    Fewer than k vectors give fewer centroids. Repeated rows each count and each give a
    row; a null vec_id can't begin a cluster, and if no row has one, cluster, distance
    and what follows from them are null. Vectors with a component beyond 2**27 take no
    part, as their squared distances don't fit into 64 bits; an inertia that doesn't fit
    is null. Other columns are not read; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    store = Store(spark, "lloyd")
    raw = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    state = _write(raw.mapInArrow(_whole(dim, scale), _STATE), store, "state-0")
    named = _vectors(state).where("vec_id is not null").orderBy(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256), F.col("v")).limit(k)
    centroids = np.array([np.frombuffer(r["v"], "<i4") for r in named.select("v").collect()], np.int64).reshape(-1, dim)
    if not len(centroids):
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))]
        return _vectors(state).select("vec_id", *nothing)
    sums, sizes, changed = np.zeros_like(centroids), np.zeros(len(centroids), np.int64), np.ones(len(centroids), bool)
    for r in range(1, rounds + 2):
        state = _write(_vectors(state).mapInArrow(_round(centroids, changed), _STATE), store, f"state-{r}")
        store.drop(f"state-{r - 1}")
        if r > rounds:
            break
        moved = state.where("kind = 1").select("owner", F.col("distance").alias("n"), F.posexplode("sums").alias("i", "x"))
        for m in moved.groupBy("owner", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect():
            sums[m["owner"], m["i"]] += m["x"]
            sizes[m["owner"]] += m["n"] if m["i"] == 0 else 0
        last = centroids
        centroids = np.where(sizes[:, None] > 0, sums // np.maximum(sizes, 1)[:, None], last)
        changed = (centroids != last).any(axis=1)
        if not changed.any():
            break
    found = _vectors(state)
    big = F.sum(F.col("distance").cast("decimal(38,0)"))
    inertia = {r["owner"]: int(r["inertia"]) for r in found.groupBy("owner").agg(big.alias("inertia")).collect()}
    fits = lambda x: x if x < 1 << 63 else None
    whole = fits(sum(inertia.values()))
    about = [(c, fits(inertia.get(c, 0)), whole, hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest()) for c, x in enumerate(centroids)]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.withColumnRenamed("owner", "cluster").join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
