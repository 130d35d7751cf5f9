"""Joins of run-length masks, polygons and pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdure.operators.graph import components
from verdure.session import cut


def touching(runs: DataFrame, keys: list[str], region: str) -> DataFrame:
    """(a, b), a < b: regions of a group with pixels within Chebyshev distance 1. runs (keys, region, y, x0, x1).

    Each run is laid on its own row and the next two, so that rows meet by equality.
    """
    above = runs.select(*keys, F.col(region).alias("a"), F.explode(F.array(F.col("y") - 1, F.col("y"), F.col("y") + 1)).alias("y"), F.col("x0").alias("a0"), F.col("x1").alias("a1"))
    below = runs.select(*keys, F.col(region).alias("b"), "y", F.col("x0").alias("b0"), F.col("x1").alias("b1"))
    return above.join(below, [*keys, "y"]).where("a < b and a0 <= b1 + 1 and b0 <= a1 + 1").select("a", "b").distinct()


def touch_components(runs: DataFrame, keys: list[str], region: str) -> DataFrame:
    """(node, component) of touching regions; no pair of them is made.

    Within two neighbouring rows of a group, runs touch if they follow each other without a
    gap, whichever row they lie in. So each run is laid on the two pairs of rows that hold
    it, and there stands for the lowest region of its unbroken stretch; what is joined is
    stretches, through the regions that lie in several. One group's row, of at most its width
    in different beginnings, is a task's unit.
    """
    laid = runs.select(*keys, F.col(region).alias("node"), F.explode(F.array(F.col("y") - 1, F.col("y"))).alias("_p"), F.col("x0").alias("_x"), F.col("x1").alias("_e"))
    starts = laid.groupBy(*keys, "_p", "_x").agg(F.max("_e").alias("_e"), F.min("node").alias("_low"))
    w = Window.partitionBy(*keys, "_p").orderBy("_x")
    new = F.coalesce(F.col("_x") > F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True))
    numbers = starts.withColumn("_new", new).withColumn("_s", F.count_if("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    stretch = cut(numbers.withColumn("_low", F.min("_low").over(Window.partitionBy(*keys, "_p", "_s"))).select(*keys, "_p", "_x", "_low"))
    # A row without keys or place touches nothing; equal stretches of a region are one.
    at = cut(laid.join(stretch, [*keys, "_p", "_x"], "left").select("node", F.coalesce("_low", "node").alias("_low")).distinct())
    own = at.groupBy("node").agg(F.min("_low").alias("_own"))
    links = at.join(own, "node").select(F.col("_own").alias("a"), F.col("_low").alias("b")).where("a <> b").distinct()
    found = components(at.select(F.col("_low").alias("node")).distinct(), links)
    return own.join(found.withColumnRenamed("node", "_own"), "_own").select("node", "component")


def runs_of(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Run-length rows (keys, y, x0, x1) of pixels (keys, x, y)."""
    w = Window.partitionBy(*keys, "y").orderBy("x")
    p = pixels.select(*keys, "y", "x").distinct().withColumn("_g", F.col("x") - F.row_number().over(w))
    return p.groupBy(*keys, "y", "_g").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("_g")


def novel(open_set: DataFrame, closed_set: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels of the open-set mask that the closed-set mask lacks."""
    return open_set.join(closed_set.select(*keys), keys, "left_anti")


def tiles(leaves: DataFrame, size: int) -> DataFrame:
    """(leaf, tile, ox, oy) of non-overlapping tiles over leaves (leaf, w, h); edge tiles overhang."""
    grid = leaves.select("leaf", F.explode(F.sequence(F.lit(0), F.ceil(F.col("h") / size).cast("int") - 1)).alias("ty"), F.ceil(F.col("w") / size).cast("int").alias("nx"))
    return grid.select("leaf", "ty", "nx", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("tx")).select("leaf", (F.col("ty") * F.col("nx") + F.col("tx")).alias("tile"), (F.col("tx") * size).alias("ox"), (F.col("ty") * size).alias("oy"))


def mask_iou(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Intersection over union of two pixel masks, by the first key."""
    both = a.select(*keys, F.lit(True).alias("_a")).join(b.select(*keys, F.lit(True).alias("_b")), keys, "full")
    return both.groupBy(keys[0]).agg((F.count_if(F.col("_a") & F.col("_b")) / F.count("*")).alias("iou"))
