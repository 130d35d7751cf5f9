"""Calibration of detectors, mining of hard negatives, and small joins of the curation cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdure.functions.vectors import doubles
from verdure.operators.ranking import numbered
from verdure.operators.sampling import capped, reservoir
from verdure.operators.stats import SCALE, counted_median


def hybrid_descriptor(regions: DataFrame, key: str, descriptor: str, embedding: str, weight: float, floor: float = 1e-6) -> DataFrame:
    """(key, v): the standardized descriptor times a weight, followed by the embedding, if there is one."""
    parts = regions.select(key, F.posexplode(doubles(F.col(descriptor))).alias("i", "x"))
    stats = parts.groupBy("i").agg(F.avg("x").alias("m"), F.greatest(F.stddev_pop("x"), F.lit(floor)).alias("s"))
    rows = stats.orderBy("i").collect()  # one row for each of the descriptor's few components
    means, sds = F.lit([r["m"] for r in rows]), F.lit([r["s"] for r in rows])
    z = F.transform(F.arrays_zip(doubles(F.col(descriptor)).alias("x"), means.alias("m"), sds.alias("s")), lambda e: (e["x"] - e["m"]) / e["s"] * weight)
    return regions.select(key, F.concat(z, F.coalesce(doubles(F.col(embedding)), F.array().cast("array<double>"))).alias("v"))


def fit_bank(tokens: DataFrame, key: Column, valid: Column, cap: int) -> DataFrame:
    """A uniform sample of the valid tokens' features, the same each time."""
    return reservoir(tokens.where(valid), key, cap)


def calibrate(signals: DataFrame, channel: str, tile: str, value: str, fp_rate: float, floor_percent: float = 25.0) -> DataFrame:
    """(channel, floor, threshold): the floor is a percentile of the tiles' positive scales, the threshold the
    1 - fp_rate rank of all z under that floor. Two passes over the signals of healthy tiles.
    """
    med = counted_median(signals, [channel, tile], value, "med")
    below = signals.join(med, [channel, tile]).where(F.col(value) <= F.col("med")).select(channel, tile, (F.col("med") - F.col(value)).alias("_d"))
    mad = med.join(counted_median(below, [channel, tile], "_d", "_m"), [channel, tile]).select(channel, tile, "med", (F.col("_m") * SCALE).alias("scale"))
    def at_rank(rows: DataFrame, by: str, share: float) -> DataFrame:
        """The row at round(share * (n - 1)) of each channel's order; a large channel is numbered by ranges."""
        n = rows.groupBy(channel).agg(F.count("*").alias("n"))
        return numbered(rows, [channel], [F.col(by), F.col(tile)]).join(n, channel).where(F.col("_i") == F.round(F.lit(share) * (F.col("n") - 1)))

    floors = at_rank(mad.where("scale > 0"), "scale", floor_percent / 100).select(channel, F.col("scale").alias("floor"))
    z = signals.join(mad, [channel, tile]).join(floors, channel).select(channel, tile, "floor", ((F.col(value) - F.col("med")) / (F.greatest("scale", "floor") + 1e-6)).alias("z"))
    return at_rank(z, "z", 1 - fp_rate).select(channel, "floor", F.col("z").alias("threshold"))


def hard_negatives(patches: DataFrame, prob: str, tau: float, item: str, order: list[str], per_item: int = 10, cap: int = 2000) -> DataFrame:
    """Healthy patches that fire, a bounded number of each tile and in all, as reject rows."""
    return capped(patches.where(F.col(prob) >= tau), item, order, per_item, cap).withColumn("family", F.lit("rejected")).withColumn("source", F.lit("mined"))


def mined_rows(negatives: DataFrame, image: Column, x: Column, y: Column, side: int) -> DataFrame:
    """Label rows of mined patches: names of the crop and its mask, by image and place, and the square that is cut."""
    stem = F.regexp_replace(F.regexp_extract(image, "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    name = F.format_string("%s_hardneg_%d_%d", stem, x, y)
    return negatives.select("*", F.concat(name, F.lit(".png")).alias("crop"), F.concat(name, F.lit("_mask.png")).alias("mask"), x.alias("x0"), y.alias("y0"), (x + side).alias("x1"), (y + side).alias("y1"))


def unmarked(patches: DataFrame, regions: DataFrame, reviewed: DataFrame, leaf: str, cell: list[str]) -> DataFrame:
    """Patches of fully reviewed leaves that no region covers."""
    return patches.join(reviewed, leaf, "left_semi").join(regions.select(leaf, *cell).distinct(), [leaf, *cell], "left_anti").withColumn("source", F.lit("unmarked"))


def is_hard_negative(crop: Column) -> Column:
    return crop.contains("_hardneg_")


def merge_class(head: DataFrame, old: str, into: str) -> DataFrame:
    """The head without a class whose name is merged into another; nothing changes unless both exist."""
    names = head.agg(F.bool_or(F.col("name") == old).alias("a"), F.bool_or(F.col("name") == into).alias("b")).first()
    return head.where(F.col("name") != old) if names and names["a"] and names["b"] else head


def fallback_status(items: DataFrame, log: DataFrame, session: DataFrame, path: str, name: str) -> DataFrame:
    """Status from the log by full path, or, if the log is empty, from the session by file name."""
    source, key = (session, name) if log.isEmpty() else (log, path)
    return items.join(source.select(key, "status"), key, "left")


def paint(stroke: DataFrame, covered: DataFrame, cell: list[str]) -> DataFrame:
    """A stroke's pixels less those of other clusters' visible regions."""
    return stroke.join(covered.select(*cell), cell, "left_anti")


def erase(pixels: DataFrame, stroke: DataFrame, cell: list[str], region: str) -> DataFrame:
    """(region, erased, left) of the regions that a stroke meets."""
    hit = pixels.join(stroke.select(*cell).distinct().withColumn("_hit", F.lit(True)), cell, "left")
    out = hit.groupBy(region).agg(F.count_if(F.col("_hit")).alias("erased"), F.count_if(F.col("_hit").isNull()).alias("left"))
    return out.where("erased > 0")


def significant_families(pixels: DataFrame, blob: str, family: str, share: float = 0.15) -> DataFrame:
    """(blob, family, share) of families with a share of a blob; the majority alone, the lowest of equals, if under two have it."""
    n = pixels.groupBy(blob, family).count()
    w = Window.partitionBy(blob)
    s = n.withColumn("share", F.col("count") / F.sum("count").over(w)).withColumn("big", F.count_if(F.col("share") >= share).over(w))
    s = s.withColumn("r", F.row_number().over(w.orderBy(F.desc("count"), family)))
    return s.where(F.when(F.col("big") >= 2, F.col("share") >= share).otherwise(F.col("r") == 1)).select(blob, family, "share")


def masked_pool(tokens: DataFrame, region: str, vector: str, on: Column) -> DataFrame:
    """(region, dim, value): mean of the tokens on the mask, of all if none is."""
    parts = tokens.select(region, on.alias("_on"), F.posexplode(doubles(F.col(vector))).alias("dim", "x"))
    return parts.groupBy(region, "dim").agg(F.coalesce(F.avg(F.when(F.col("_on"), F.col("x"))), F.avg("x")).alias("value"))
