"""Evaluation: confusion metrics, area reports, threshold sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-7


def confusion(df: DataFrame, keys: list[str], predicted: Column, truth: Column, only: Column | None = None) -> DataFrame:
    """IoU, Dice, precision, recall and accuracy by group; all 0 for a group without rows in ``only``."""
    ok = F.lit(True) if only is None else only
    tp, fp, fn, tn = (F.count_if(ok & c) for c in (predicted & truth, predicted & ~truth, ~predicted & truth, ~predicted & ~truth))
    g = df.groupBy(*keys).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"))
    div = lambda a, b: a / F.greatest(b.cast("double"), F.lit(EPS))
    t, p, n, z = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return g.select(*keys, div(t, t + p + n).alias("iou"), div(2 * t, 2 * t + p + n).alias("dice"), div(t, t + p).alias("precision"), div(t, t + n).alias("recall"), div(t + z, t + p + n + z).alias("pixel_acc"))


def macro_average(metrics: DataFrame, names: tuple[str, ...] = ("iou", "dice", "precision", "recall", "pixel_acc")) -> DataFrame:
    return metrics.agg(*[F.avg(c).alias(c) for c in names])


def sample_table(pixels: DataFrame, keys: list[str], prob: str, truth: Column, visible: Column, about: list[Column], cut: float = 0.5) -> DataFrame:
    """Each sample's metrics where nothing was visible (zone_...), and of the whole silhouette (whole_...); ``about`` are aggregates to add.

    A sample without hidden pixels has zone metrics of 0. One pass over the pixels, summed
    up by partition first.
    """
    p = F.col(prob) > cut
    count = lambda c: F.count_if(c)
    kinds = {"tp": p & truth, "fp": p & ~truth, "fn": ~p & truth, "tn": ~p & ~truth}
    g = pixels.groupBy(*keys).agg(*[count(c).alias(f"w_{k}") for k, c in kinds.items()], *[count(c & ~visible).alias(f"z_{k}") for k, c in kinds.items()], *about)
    div = lambda a, b: a / F.greatest(b.cast("double"), F.lit(EPS))

    def metrics(x: str) -> dict[str, Column]:
        t, f, n, z = (F.col(f"{x}_{k}") for k in ("tp", "fp", "fn", "tn"))
        return {"iou": div(t, t + f + n), "dice": div(2 * t, 2 * t + f + n), "precision": div(t, t + f), "recall": div(t, t + n), "pixel_acc": div(t + z, t + f + n + z)}

    rest = [c for c in g.columns if c not in keys and c[:2] not in ("w_", "z_")]
    return g.select(*keys, *rest, *[m.alias(f"zone_{k}") for k, m in metrics("z").items()], *[m.alias(f"whole_{k}") for k, m in metrics("w").items() if k in ("iou", "dice")])


def area_report(samples: DataFrame, predicted: str, truth: str, keys: list[str] | None = None) -> DataFrame:
    """Mean absolute error, bias and relative error of areas; samples without true area are skipped."""
    d = F.col(predicted) - F.col(truth)
    return samples.where(F.col(truth) > 0).groupBy(*(keys or [])).agg(F.count("*").alias("n"), F.avg(F.abs(d)).alias("mae"), F.avg(d).alias("bias"), F.avg(F.abs(d) / F.col(truth)).alias("mape"), F.sqrt(F.avg(d * d)).alias("rmse"))


def tau_sweep(rows: DataFrame, sample: str, prob: str, truth: Column, low: float = 0.20, step: float = 0.02, steps: int = 31) -> DataFrame:
    """(tau, bias): mean over samples of the share of rows above each threshold less the true share."""
    taus = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(low + step * k).alias("tau")) for k in range(steps)])).alias("t")
    # One row for each sample and threshold: the counts are taken before the grid is laid out.
    counts = rows.groupBy(sample).agg(F.count("*").alias("n"), F.count_if(truth).alias("true"), *[F.count_if(F.col(prob) > low + step * k).alias(f"c{k}") for k in range(steps)])
    per = counts.select(sample, "n", "true", taus, F.array(*[F.col(f"c{k}") for k in range(steps)]).alias("c"))
    bias = (F.element_at("c", F.col("t.k") + 1) - F.col("true")) * 100.0 / F.col("n")
    return per.groupBy(F.col("t.tau").alias("tau")).agg(F.avg(bias).alias("bias"))


def best_tau(sweep: DataFrame) -> DataFrame:
    """The threshold of the smallest absolute bias; the first of equals."""
    return sweep.agg(F.min_by("tau", F.struct(F.abs("bias"), "tau")).alias("tau"))


def severity(df: DataFrame, damage: str, value: str) -> DataFrame:
    """(bucket, n, mean) for damage under 20, 20 to 40 and 40 or more; empty buckets stay."""
    spark = df.sparkSession
    names = spark.createDataFrame([("<20",), ("20-40",), (">=40",)], "bucket string")
    b = F.when(F.col(damage) < 20, "<20").when(F.col(damage) < 40, "20-40").otherwise(">=40")
    g = df.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return names.join(g, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), "mean")


def false_positive_rate(df: DataFrame, fired: Column, valid: Column) -> DataFrame:
    """(fired, valid, rate); raises an error if nothing is valid."""
    n = F.count_if(valid)
    return df.agg(F.count_if(fired & valid).alias("fired"), n.alias("valid"), F.when(n == 0, F.raise_error(F.lit("no valid rows")).cast("double")).otherwise(F.count_if(fired & valid) / F.greatest(n, F.lit(1))).alias("rate"))


def silhouette_counts(mask, values: dict, steps: int = 31, low: float = 0.20, step: float = 0.02) -> dict:
    """Pixel counts of one sample's refined silhouette at each threshold.

    ``values``: prob, visible and truth (0 or 1) on the canvas; for ``verdure.kernels.apply.map_masks``.
    """
    import numpy as np

    from verdure.kernels import raster

    truth, visible = values["truth"] > 0, values["visible"] > 0
    rows = []
    for k in range(steps):
        tau = low + step * k
        p = raster.refine_silhouette(values["prob"], visible, tau)
        rows.append((k, tau, truth.sum(), (truth & ~visible).sum(), p.sum(), (p & ~visible).sum(), (p & truth).sum(), (p | truth).sum(), visible.sum()))
    names = ("k", "tau", "whole", "lost", "found", "added", "both", "either", "seen")
    return {n: np.array([r[i] for r in rows]) for i, n in enumerate(names)}


SILHOUETTE = "k int, tau double, whole long, lost long, found long, added long, both long, either long, seen long"


def silhouette_report(counts: DataFrame, head_area: Column | None = None) -> DataFrame:
    """By threshold: lost-tissue error and bias, whole-area error, IoU, Dice, and the error of the area head, if there is one.

    counts as from ``silhouette_counts``; samples without true area are skipped. ``head_area``
    is the area regressor's estimate in pixels.
    """
    c = {n: F.col(n).cast("double") for n in ("whole", "lost", "found", "added", "both", "either", "seen")}
    share = c["lost"] / c["whole"]
    d = F.coalesce(F.try_divide(c["added"], c["found"]), F.lit(0.0)) - share
    whole = F.greatest(head_area if head_area is not None else F.lit(1.0), F.lit(1.0))
    head = F.abs(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (whole - c["seen"]) / whole)) - share)
    out = [F.count("*").alias("n"), F.avg(F.abs(d)).alias("lost_mae"), F.avg(d).alias("lost_bias"), F.avg(F.abs(c["found"] - c["whole"]) / c["whole"]).alias("whole_mape"),
           F.avg(c["both"] / F.greatest(c["either"], F.lit(1.0))).alias("iou"), F.avg(2 * c["both"] / F.greatest(c["whole"] + c["found"], F.lit(1.0))).alias("dice")]
    return counts.where("whole > 0").groupBy("k", "tau").agg(*out, *([F.avg(head).alias("head_mae")] if head_area is not None else []))


def best_report(reports: DataFrame) -> DataFrame:
    """The report of the smallest absolute bias; the lowest threshold of equals."""
    names = reports.columns
    return reports.agg(F.min_by(F.struct(*names), F.struct(F.round(F.abs("lost_bias"), 12), "k")).alias("r")).select("r.*")


def overall_and_by_type(rows: DataFrame, kind: str, value: str) -> DataFrame:
    """(type, n, mean) of all rows, named "all", and of each type."""
    agg = (F.count("*").alias("n"), F.avg(value).alias("mean"))
    return rows.agg(*agg).select(F.lit("all").alias("type"), "n", "mean").union(rows.groupBy(F.col(kind).alias("type")).agg(*agg).select("type", "n", "mean"))
