"""Robust statistics by group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdure.operators.ranking import running_sum

SCALE = 1.4826


def robust_scale(df: DataFrame, keys: list[str], value: str, floor: float = 0.0) -> DataFrame:
    """keys, med, mad, scale: the lower median deviation over values up to the median, the median itself included.

    Null values take no part; a group without values has nulls. Equal values are counted
    before they are ordered, so that no aggregate holds a group's values.
    """
    med = df.select(*keys).distinct().join(counted_median(df, keys, value, "med"), keys, "left")
    below = df.join(med, keys).where(F.col(value) <= F.col("med")).select(*keys, (F.col("med") - F.col(value)).alias("_d"))
    mad = counted_median(below, keys, "_d", "mad")
    return med.join(mad, keys, "left").withColumn("scale", F.greatest(F.col("mad") * SCALE, F.lit(float(floor))) + 1e-6)


def robust_z(df: DataFrame, keys: list[str], value: str, floor: float = 0.0, valid: Column | None = None) -> DataFrame:
    """``df`` with z = (value - med) / scale; 0 where the value is null or not valid."""
    ok = F.col(value).isNotNull() if valid is None else valid & F.col(value).isNotNull()
    scales = robust_scale(df.where(ok), keys, value, floor)
    z = F.when(ok, F.coalesce((F.col(value) - F.col("med")) / F.col("scale"), F.lit(0.0))).otherwise(0.0)
    return df.join(scales, keys, "left").withColumn("z", z).drop("med", "mad", "scale")


def _counted(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, _c, _hi, _n): how often each value occurs, how many rows it and smaller ones have, and how many the group has."""
    g = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    g = running_sum(g, keys, [F.col(value)], F.col("_c"), "_hi")
    n = g.groupBy(*keys).agg(F.max("_hi").alias("_n"))
    return g.join(n, keys) if keys else g.join(n)


def _at_rank(df: DataFrame, keys: list[str], value: str, rank, name: str) -> DataFrame:
    """The value at a rank, from 0, of each group's sorted values; equal values are counted before they are ordered."""
    g = _counted(df, keys, value).withColumn("_k", rank(F.col("_n")))
    return g.where((F.col("_k") < F.col("_hi")) & (F.col("_k") >= F.col("_hi") - F.col("_c"))).select(*keys, F.col(value).alias(name))


def counted_median(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The mean of each group's two middle values, by counts of equal values."""
    g = _counted(df, keys, value)
    at = lambda k: F.max(F.when((k < F.col("_hi")) & (k >= F.col("_hi") - F.col("_c")), F.col(value).cast("double")))
    return g.groupBy(*keys).agg(((at(F.floor((F.col("_n") - 1) / 2)) + at(F.floor(F.col("_n") / 2))) / 2).alias(name))


def nearest_rank(df: DataFrame, keys: list[str], value: str, percent: float) -> DataFrame:
    """The value at index round(p / 100 * (n - 1)) of each group's sorted values."""
    return _at_rank(df, keys, value, lambda n: F.round(F.lit(percent / 100.0) * (n - 1)).cast("long"), "pct")


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value at index n div 2 of each group's sorted values."""
    return _at_rank(df, keys, value, lambda n: F.floor(n / 2), "upper_median")


def area_atypicality(area: Column, median: Column) -> Column:
    m = F.greatest(median, F.lit(1.0))
    return F.greatest(F.lit(0.0), F.greatest(area / m, m / F.greatest(area, F.lit(1.0))) - 1.0)


def standardize(df: DataFrame, key: str, vector: str, floor: float = 1e-6) -> DataFrame:
    """key, dim, value: each component less its mean, over its population deviation."""
    parts = df.select(key, F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "x"))
    stats = parts.groupBy("dim").agg(F.avg("x").alias("mean"), F.greatest(F.stddev_pop("x"), F.lit(floor)).alias("sd"))
    return parts.join(stats, "dim").select(key, "dim", ((F.col("x") - F.col("mean")) / F.col("sd")).alias("value"))


def variance_weight(df: DataFrame, vector: str, dims: int = 8, floor: float = 1e-3) -> DataFrame:
    parts = df.select(F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "x"))
    total = parts.groupBy("dim").agg(F.var_pop("x").alias("v")).agg(F.sum("v").alias("v"))
    return total.select(F.greatest(F.sqrt(F.col("v") / dims), F.lit(floor)).alias("weight"))


def elongation(df: DataFrame, keys: list[str], x: str = "x", y: str = "y", cap: float = 20.0) -> DataFrame:
    """Root of the ratio of the coordinate covariance's eigenvalues, and the extent of the bounding box; 1 for under two pixels."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"), F.covar_pop(x, y).alias("xy"), ((F.max(x) - F.min(x) + 1) * (F.max(y) - F.min(y) + 1)).alias("box"))
    half, root = (F.col("xx") + F.col("yy")) / 2, F.sqrt(F.pow((F.col("xx") - F.col("yy")) / 2, F.lit(2.0)) + F.pow("xy", F.lit(2.0)))
    ratio = F.sqrt((half + root) / F.greatest(half - root, F.lit(1e-6)))
    return g.select(*keys, F.when(F.col("n") < 2, 1.0).otherwise(F.least(ratio, F.lit(cap))).alias("elongation"), F.when(F.col("n") < 2, 1.0).otherwise(F.col("n") / F.col("box")).alias("extent"))


def majority_cells(df: DataFrame, keys: list[str], flag: Column) -> DataFrame:
    """A cell is true if at least half of its rows are, and whole if all are."""
    return df.groupBy(*keys).agg((F.count_if(flag) * 2 >= F.count("*")).alias("majority"), F.bool_and(flag).alias("whole"), F.count("*").alias("n"))


def ring_interpolation(df: DataFrame, keys: list[str], i: str, value: str, valid: str, n: int) -> DataFrame:
    """Fills a ring of ``n`` rays from the nearest valid ones on both sides, linearly; 0 if there are none."""
    seen = F.when(F.col(valid), F.struct(F.col("_p").alias("at"), F.col(value).alias("v")))
    three = df.select("*", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("_t")).withColumn("_p", F.col(i) + F.col("_t") * n)
    w = Window.partitionBy(*keys).orderBy("_p")
    filled = three.withColumn("_l", F.last(seen, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_r", F.first(seen, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    gap = F.col("_r.at") - F.col("_l.at")
    between = F.col("_l.v") + (F.col("_r.v") - F.col("_l.v")) * F.coalesce(F.try_divide(F.col("_p") - F.col("_l.at"), gap), F.lit(0.0))
    r = F.when(F.col(valid), F.col(value)).otherwise(F.coalesce(between, F.lit(0.0)))
    return filled.where("_t = 0").select(*keys, i, r.alias("r"))


def _moments(dim: int):
    """Each partition's count, mean and sums of products of deviations, merged batch by batch: dim * (dim + 1) / 2 rows for any number of vectors."""
    i, j = np.triu_indices(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, products = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            own = x.mean(axis=0)
            d, apart = x - own, own - mean
            products += d.T @ d + np.outer(apart, apart) * (n * len(x) / (n + len(x)))
            mean, n = mean + apart * (len(x) / (n + len(x))), n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.full(len(i), n)), pa.array(mean[i]), pa.array(mean[j]), pa.array(products[i, j])], names=["i", "j", "n", "mi", "mj", "s"])

    return run


def covariance(df: DataFrame, vector: str) -> DataFrame:
    """(i, j, cov): population covariance of each pair of components, i <= j.

    Vectors are summed up by partition; only those sums are shuffled. Null vectors and those
    with a null component take no part; all others must be as long as the longest. No
    vectors give no rows.
    """
    v = df.select(F.col(vector).cast("array<double>").alias("v")).where("v is not null and size(v) > 0 and not exists(v, x -> x is null)")
    dim = v.agg(F.max(F.size("v"))).first()[0]
    if not dim:
        return df.limit(0).select(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0.0).alias("cov"))
    parts = v.mapInArrow(_moments(dim), "i int, j int, n long, mi double, mj double, s double")
    total = parts.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.collect_list(F.struct("n", "mi", "mj")).alias("parts"))
    # Between partitions: deviations of their means from the mean of all, a partial sum for each.
    sums = lambda f: F.aggregate("parts", F.lit(0.0), lambda a, p: a + f(p))
    total = total.withColumn("_i", sums(lambda p: p["n"] * p["mi"]) / F.col("n")).withColumn("_j", sums(lambda p: p["n"] * p["mj"]) / F.col("n"))
    between = sums(lambda p: p["n"] * (p["mi"] - F.col("_i")) * (p["mj"] - F.col("_j")))
    return total.select("i", "j", ((F.col("s") + between) / F.col("n")).alias("cov"))


def principal(df: DataFrame, vector: str, k: int) -> tuple[list[float], list[list[float]], list[float]]:
    """Variances and directions of the k principal components, and the mean; from grouped sums of dim * dim rows.

    A direction's sign is set by its largest component.
    """
    rows = covariance(df, vector).collect()
    means = df.select(F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m")).orderBy("i").collect()
    dim = len(means)
    c = np.zeros((dim, dim))
    for r in rows:
        c[r["i"], r["j"]] = c[r["j"], r["i"]] = r["cov"]
    values, directions = np.linalg.eigh(c)
    top = np.argsort(-values, kind="stable")[:k]
    chosen = directions[:, top].T
    chosen *= np.sign(chosen[np.arange(len(chosen)), np.abs(chosen).argmax(axis=1)])[:, None]
    return np.maximum(values[top], 0).tolist(), chosen.tolist(), [r["m"] for r in means]


def project(df: DataFrame, vector: str, directions: list[list[float]], mean: list[float], name: str = "projected") -> DataFrame:
    """``df`` with the centred vector's components along each direction."""
    centred = F.zip_with(F.col(vector).cast("array<double>"), F.lit([float(x) for x in mean]), lambda x, m: x - m)
    along = lambda d: F.aggregate(F.zip_with(F.col("_c"), d, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return df.withColumn("_c", centred).withColumn(name, F.transform(F.lit(directions), along)).drop("_c")
