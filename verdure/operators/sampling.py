"""Sampling, splits and weights, all repeatable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdure.operators.ranking import numbered


def water_fill(counts: dict[object, int], target: int) -> dict[object, int]:
    """Quota of each class: equal shares, what a small class leaves is dealt to those with room."""
    quota = {c: 0 for c in counts}
    left = min(target, sum(counts.values()))
    while left > 0:
        room = sorted(c for c in counts if quota[c] < counts[c])
        share = left // len(room)
        if not share:
            for c in room[:left]:
                quota[c] += 1
            return quota
        for c in room:
            more = min(share, counts[c] - quota[c])
            quota[c] += more
            left -= more
    return quota


def stratified_stride(df: DataFrame, label: str, order: list[str], quota: dict[object, int]) -> DataFrame:
    """Evenly strided rows of each class, up to its quota; classes without one give none.

    The counts of the classes that have a quota go to every task, so that no task gets a class.
    """
    if not quota:
        return df.limit(0)
    wanted = df.where(F.col(label).isin(list(quota)))
    n = wanted.groupBy(label).agg(F.count("*").alias("_n"))
    want = F.create_map(*[x for c, q in quota.items() for x in (F.lit(c), F.lit(q))])[F.col(label)]
    ranked = numbered(wanted, [label], [F.col(c) for c in order]).join(F.broadcast(n), label).select(*df.columns, "_i", "_n").withColumn("_want", want)
    stride = F.greatest(F.lit(1), F.floor(F.col("_n") / F.greatest(F.col("_want"), F.lit(1))))
    return ranked.where((F.col("_i") % stride == 0) & (F.floor(F.col("_i") / stride) < F.col("_want"))).drop("_i", "_n", "_want")


def reservoir(df: DataFrame, key: Column, cap: int) -> DataFrame:
    """The ``cap`` rows of the smallest hash keys: a uniform sample, the same each time."""
    return df.withColumn("_k", key).orderBy("_k").limit(cap).drop("_k")


def capped(df: DataFrame, item: str, order: list[str], per_item: int, cap: int) -> DataFrame:
    """At most ``per_item`` rows of each item, then the first ``cap`` in the order."""
    some = df.withColumn("_r", F.row_number().over(Window.partitionBy(item).orderBy(*order))).where(F.col("_r") <= per_item).drop("_r")
    return some.orderBy(*order).limit(cap)


def evenly_spaced(df: DataFrame, order: list[str], count: int) -> DataFrame:
    """Rows at places i * n div count."""
    n = df.count()
    at = sorted({i * n // count for i in range(count)}) if n else []
    return numbered(df, [], [F.col(c) for c in order]).where(F.col("_i").isin(at)).drop("_i")


def class_weights(df: DataFrame, label: str, crop: str | None = None, hard: Column | None = None, floor: int = 15) -> DataFrame:
    """weight = n / (classes * max(class count, floor)), four times that for hard negatives, divided by the rows of a crop."""
    per = df.groupBy(label).agg(F.count("*").alias("_c"))
    n, k = per.agg(F.sum("_c"), F.count("*")).first()
    w = F.lit(float(n or 0)) / (F.lit(k or 1) * F.greatest(F.col("_c"), F.lit(floor)))
    if hard is not None:
        w = F.when(hard, w * 4).otherwise(w)
    out = df.join(per, label)
    if crop is not None:
        out = out.join(df.groupBy(crop).agg(F.count("*").alias("_r")), crop)
        w = w / F.col("_r")
    return out.select(*df.columns, w.alias("weight"))


def hash_split(df: DataFrame, key: Column, share: float = 0.9) -> DataFrame:
    """part "train" for the first ceil(share * n) rows in hash order, else "val"."""
    n = df.count()
    placed = numbered(df.withColumn("_key", key), [], [F.col("_key")])
    return placed.select(*df.columns, F.when(F.col("_i") < F.ceil(F.lit(share) * n), "train").otherwise("val").alias("part"))


def drop_small_classes(df: DataFrame, label: str, least: int = 3) -> DataFrame:
    return df.join(df.groupBy(label).count().where(F.col("count") >= least).select(label), label, "left_semi")


def by_quota(df: DataFrame, label: str, order: list[str], target: int) -> DataFrame:
    """Evenly strided rows of each class by water-filled quotas of ``target`` rows; the classes' counts come to the driver."""
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    return stratified_stride(df, label, order, water_fill(counts, target)) if counts else df


def enough(df: DataFrame, label: str, classes: int = 2, rows: int = 15) -> bool:
    """Whether there are enough classes and rows to learn from."""
    n = df.agg(F.count_distinct(label).alias("classes"), F.count(label).alias("rows")).first()
    return n["classes"] >= classes and n["rows"] >= rows
