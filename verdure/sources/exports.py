"""Exports of a run: full result tables, training data, datasets, overlays, sessions and file copies.

Tables are planned by Catalyst; files are written by the executors, each partition its
own, through the file system that the target's address names.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdure.functions import scalars
from verdure.functions.scalars import lost_percent
from verdure.operators.regions import leaf_ordinal

#: The morphology columns of a leaf with their decimals, whole numbers without any.
MORPHOLOGY = {
    "ec_length": 2, "ec_width": 2, "ec_area": None, "ec_shape_index": 4, "ec_circularity": 4, "ec_entropy": 5, "ec_outline": None,
    "mc_length": 2, "mc_width": 2, "mc_area": None, "mc_shape_index": 4, "mc_circularity": 4, "mc_entropy": 5, "mc_outline": None,
}
#: Columns of a reconstruction table: Filename, Path, pixels of the leaf, predicted, damaged, percent.
RECONSTRUCTION = ("Filename", "Path", "Input_Leaf_px", "Predicted_Total_px", "Damage_px", "Pct_Damage")
#: First word of a training dump, its header's other words being rows, components and classes.
MAGIC = 0x4C524431


# --- result tables ---


def _identity(leaves: DataFrame) -> DataFrame:
    """Leaves with the name of their photograph, their place in it from 1, and the file of their cut-out."""
    numbered = leaf_ordinal(leaves, "leaf_src", "leaf")
    image = scalars.stem(F.col("leaf_src"))
    return numbered.withColumn("image", image).withColumn("leaf_in_image", F.col("ordinal") + 1).withColumn("leaf_file", scalars.leaf_name(image, F.col("ordinal"))).drop("ordinal")


def long_table(regions: DataFrame, leaves: DataFrame, names: DataFrame) -> DataFrame:
    """One row of 31 columns for each region; what is unknown is null.

    regions (leaf, region, cluster_id, area_px, bbox_x, bbox_y, bbox_w, bbox_h), leaves
    (leaf, leaf_src, leaf_px, recon_area, recon_whole and the morphology columns), names
    (cluster_id, name). A region without its leaf counts one pixel of leaf.
    """
    out = regions.join(_identity(leaves), "leaf", "left").join(names.select("cluster_id", F.col("name").alias("_name")), "cluster_id", "left")
    known = F.when(F.col("recon_whole") > 0, F.col("recon_whole"))
    family = F.coalesce("_name", F.concat(F.lit("Cluster "), "cluster_id"))
    return out.select(
        "leaf", "image", "leaf_in_image", "leaf_file", "leaf_src", "region", "cluster_id", family.alias("family"), "area_px",
        (F.col("area_px") * 100.0 / F.greatest(F.coalesce("leaf_px", F.lit(1)), F.lit(1))).alias("pct_leaf"), F.try_divide(F.col("area_px") * 100.0, known).alias("recon_pct"), lost_percent(F.col("recon_area"), known).alias("lost_tissue_pct"),
        "bbox_x", "bbox_y", "bbox_w", "bbox_h", F.format_string("%d_%d.png", "leaf", "region").alias("crop_file"), *MORPHOLOGY,
    )


def wide_table(regions: DataFrame, leaves: DataFrame, rejected: DataFrame, families: list[tuple[int, str]]) -> DataFrame:
    """One row for each leaf that isn't rejected: 24 columns, then count, area, mean and share of each family, in order of label.

    Totals leave noise, labels below 0, out. The mean of no regions is null. ``families``: (label, column name).
    """
    of = lambda k: F.col("cluster_id") == F.lit(k)
    tallies = [x for k, _ in families for x in (F.count_if(of(k)).alias(f"_{k}_n"), F.sum(F.when(of(k), F.col("area_px"))).alias(f"_{k}_a"))]
    calm = F.col("cluster_id").isin([k for k, _ in families])
    counted = regions.groupBy("leaf").agg(F.count_if(calm).alias("_n"), F.sum(F.when(calm, F.col("area_px"))).alias("_a"), *tallies)
    out = _identity(leaves).join(rejected.select("leaf"), "leaf", "left_anti").join(counted, "leaf", "left")
    px, zero = F.greatest(F.col("leaf_px"), F.lit(1)), lambda c: F.coalesce(F.col(c), F.lit(0))
    columns = ["leaf", "image", "leaf_in_image", "leaf_file", "leaf_src", px.alias("leaf_area_px"), zero("_n").alias("n_anomalies"), zero("_a").alias("anomaly_area_px"), (zero("_a") * 100.0 / px).alias("anomaly_pct_leaf"), lost_percent(F.col("recon_area"), F.when(F.col("recon_whole") > 0, F.col("recon_whole"))).alias("lost_tissue_pct"), *MORPHOLOGY]
    for k, name in sorted(families):
        n, area = zero(f"_{k}_n"), zero(f"_{k}_a")
        columns += [n.alias(f"{name}_count"), area.alias(f"{name}_area_px"), F.try_divide(area.cast("double"), F.when(n > 0, n)).alias(f"{name}_avg_area_px"), (area * 100.0 / px).alias(f"{name}_pct_leaf")]
    return out.select(*columns)


def morphology_table(leaves: DataFrame, order: str = "leaf") -> DataFrame:
    """The 15 columns of the morphology summary, in order of the leaves."""
    # The summary's order differs from that of the result tables.
    names = ("length", "width", "shape_index", "circularity", "entropy", "area", "outline")
    shown = {"length": "Length", "width": "Width", "shape_index": "ShapeIndex", "circularity": "Circularity", "area": "Area", "outline": "Outline"}
    columns = [F.col(f"{side}_{n}").alias(f"{side.upper()}_{shown.get(n, 'ApEn' if side == 'ec' else 'SpEn')}") for side in ("ec", "mc") for n in names]
    return leaves.orderBy(order).select(scalars.file_name(F.col("leaf_src")).alias("Filename"), *columns)


def reconstruction_table(results: DataFrame, path: str, leaf: str, predicted: str) -> DataFrame:
    """The six columns of a reconstruction: damage is what is predicted and not there."""
    damage = scalars.saturating_minus(F.col(predicted), F.col(leaf))
    values = (scalars.file_name(F.col(path)), F.col(path), F.col(leaf), F.col(predicted), damage, scalars.damage_percent(damage, F.col(predicted)))
    return results.select(*[v.alias(n) for v, n in zip(values, RECONSTRUCTION)])


def export_run(tables: dict[str, Callable[[], None]], images: DataFrame | None, write: Callable[[str, bytes], None] | None = None, slices: int = 16) -> list[str]:
    """Writes all tables first, then the images (name, content) in slices; the names of what is done, in order."""
    done = []
    for name, job in tables.items():
        job()
        done.append(name)
    if images is not None and write is not None:
        for k in range(slices):
            part = images.where(F.pmod(F.xxhash64("name"), F.lit(slices)) == k)
            part.foreachPartition(lambda rows: [write(r["name"], bytes(r["content"])) for r in rows] and None)
            done.append(f"images-{k}")
    return done


# --- files, written by executors ---


def file_system(address: str):
    """The file system of an address and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(address) if "://" in address or address.startswith("file:") else (fs.LocalFileSystem(), address)


def folder_writer(root: str) -> Callable[[str, bytes], None]:
    """Writes a file below a folder, with the folders on the way to it."""
    root = root if "://" in root else root.replace("file:/", "file:///", 1)

    def write(name: str, content: bytes) -> None:
        system, base = file_system(root)
        target = posixpath.join(base, name)
        system.create_dir(posixpath.dirname(target), recursive=True)
        with system.open_output_stream(target) as out:
            out.write(content)

    return write


def put_files(files: DataFrame, root: str) -> DataFrame:
    """Writes (name, content) below a folder; (name, error) of each, null where it was written."""
    write = folder_writer(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    write(name, content.as_py())
                    errors.append(None)
                except Exception as e:  # one file that can't be written is reported and passed over
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(errors, pa.string())], names=["name", "error"])

    return files.select(F.col("name").cast("string"), F.col("content").cast("binary")).mapInArrow(run, "name string, error string")


def destination(path: Column, source: str, category: Column) -> Column:
    """Where a sorted file goes: its category's folder, then its place below the source."""
    rest = F.when(F.startswith(path, F.lit(source.rstrip("/") + "/")), F.substr(path, F.lit(len(source.rstrip("/")) + 2))).otherwise(scalars.file_name(path))
    return F.concat(category, F.lit("/"), rest)


def copy_files(items: DataFrame, out: str, move: bool = False) -> DataFrame:
    """Copies (path, target) below a folder, or moves them; (path, target, error) of each."""
    out = out if "://" in out else out.replace("file:/", "file:///", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors = []
            for path, target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    system, base = file_system(out)
                    _, source = file_system(path if "://" in path else path.replace("file:/", "file:///", 1))
                    to = posixpath.join(base, target)
                    system.create_dir(posixpath.dirname(to), recursive=True)
                    (system.move if move else system.copy_file)(source, to)
                    errors.append(None)
                except Exception as e:  # one file that can't be copied is reported and passed over
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(errors, pa.string())], names=["path", "target", "error"])

    return items.select("path", "target").mapInArrow(run, "path string, target string, error string")


def archive(spark: SparkSession, path: str) -> str | None:
    """Renames a log to its backup, which replaces an older one; None if there is no log."""
    stem, dot, ending = path.rpartition(".")
    backup = f"{stem}_backup.{ending}" if dot and "/" not in ending else f"{path}_backup"
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, backup))
    system = old.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(old):
        return None
    system.delete(new, True)
    system.rename(old, new)
    return backup


#: The columns of a validation table, with their decimals; text without any.
VALIDATION = {
    "damage_type": None, "damage_pct_actual": 3, "zone_iou": 4, "zone_dice": 4, "zone_precision": 4, "zone_recall": 4, "zone_pixel_acc": 4, "whole_iou_t05": 4, "whole_dice_t05": 4, "head_area_pred": 4,
}


def validation_table(samples: DataFrame) -> DataFrame:
    """A row for each sample of ``evaluation.sample_table`` with its damage_type, damage_pct_actual and head_area_pred, in the columns of the validation CSV."""
    from verdure.sources.sinks import fixed

    named = samples.withColumnRenamed("whole_iou", "whole_iou_t05").withColumnRenamed("whole_dice", "whole_dice_t05")
    return fixed(named.select(*VALIDATION), {c: n for c, n in VALIDATION.items() if n is not None})


# --- models and training data ---


def meta_json(thresholds: dict[str, float], floors: dict[str, float], dino_threshold: float, dim: int) -> str:
    """A detector's thresholds and floors by channel, and the largest threshold."""
    return json.dumps({"threshold": max(thresholds.values()), "ch_thresholds": thresholds, "dino_threshold": dino_threshold, "scale_floors": floors, "dim": dim, "project_dim": None}, indent=2)


def put_text(spark: SparkSession, path: str, text: str, backup: bool = False) -> None:
    """Writes a small file from the driver; with ``backup`` what was there is kept beside it as .bak."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if backup and system.exists(target):
        kept = spark._jvm.org.apache.hadoop.fs.Path(path + ".bak")
        system.delete(kept, True)
        system.rename(target, kept)
    out = system.create(target, True)
    out.write(bytearray(text.encode()))
    out.close()


def dump_bytes(classes: list[int], rows: list[tuple[int, float, np.ndarray]]) -> bytes:
    """A training dump: its header, the classes, then class, weight and components of each row, little-endian."""
    dim = len(rows[0][2]) if rows else 0
    kind = np.dtype([("c", "<i4"), ("w", "<f4"), ("v", "<f4", (dim,))])
    body = np.zeros(len(rows), kind)
    for i, (c, w, v) in enumerate(rows):
        body[i] = c, w, v
    return struct.pack("<IIII", MAGIC, len(rows), dim, len(classes)) + np.array(classes, "<i4").tobytes() + body.tobytes()


def base_set(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, class, weight, v, error) of a training dump, by ranges; a file that is none gives one row with its error."""
    from verdure.sources import binary

    return binary.base_set(spark, path)


def diagnostics(run: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """One row of JSON: the columns of ``run``, itself of one row, and both heads' classes (class, name, intercept, coef) with the norms of their coefficients.

    A class without a name is called by its number, class 0 healthy. The classes' number bounds the row.
    """

    def snapshot(head: DataFrame, name: str) -> DataFrame:
        norm = F.sqrt(F.aggregate("coef", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
        label = F.coalesce(F.col("name"), F.when(F.col("class") == 0, "Healthy"), F.col("class").cast("string"))
        return head.agg(F.sort_array(F.collect_list(F.struct("class", label.alias("name"), norm.alias("coef_norm"), "intercept"))).alias(name))

    return run.join(snapshot(before, "before")).join(snapshot(after, "after")).select(F.to_json(F.struct("*")).alias("value"))


# --- sessions ---


def session_path(folder: str, source: str) -> str:
    """Where a source folder's session lies: by a hash of its path."""
    return f"{folder.rstrip('/')}/{hashlib.blake2b(source.rstrip('/').encode(), digest_size=8).hexdigest()}.json"


def save_session(spark: SparkSession, folder: str, source: str, categorised: dict[str, str], last_index: int = 0) -> None:
    put_text(spark, session_path(folder, source), json.dumps({"source_folder": source, "last_index": last_index, "categorised": categorised}, indent=2))


def save_sessions(marks: DataFrame, folder: str) -> DataFrame:
    """Writes the session of each source folder, by the tasks that have its rows; (name, error) of each file.

    marks (source_folder, last_index, name, status): the marks of a folder, which are few, make one file.
    """
    entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "status"))))
    rows = marks.groupBy("source_folder").agg(F.max("last_index").alias("last_index"), entries.alias("categorised"))
    rows = rows.select("source_folder", F.encode(F.to_json(F.struct("source_folder", "last_index", "categorised")), "UTF-8").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [session_path("", source)[1:] for source in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), batch.column(1)], names=["name", "content"])

    return put_files(rows.mapInArrow(run, "name string, content binary"), folder)


def write_export_map(rows: DataFrame, path: str, rows_of_part: int = 50_000) -> None:
    """An export map of (src, index, split) as JSON objects, one to a part; a part holds some thousand paths by their hash."""
    parts = 1 + rows.count() // rows_of_part
    entry = F.struct("src", F.struct("index", "split").alias("v"))
    held = rows.groupBy(F.pmod(F.xxhash64("src"), F.lit(parts)).alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    held.repartition(parts, "part").select("value").write.mode("overwrite").option("lineSep", "\n").text(path)


SESSION = "source_folder string, last_index int, categorised map<string,string>"


def sessions(spark: SparkSession, folder: str, source: str | None = None) -> DataFrame:
    """(source_folder, last_index, name, status) of one source's session, or of all; without sessions no rows."""
    path = session_path(folder, source) if source is not None else f"{folder.rstrip('/')}/*.json"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    rows = spark.read.schema(SESSION).option("multiLine", "true").json(path) if found else spark.createDataFrame([], SESSION)
    return rows.select("source_folder", "last_index", F.explode_outer("categorised").alias("name", "status"))


# --- images and datasets ---


def stamp(rgba: np.ndarray, x: int, y: int, side: int) -> np.ndarray:
    """A square cut from an image; what lies outside it is transparent."""
    out = np.zeros((side, side, 4), np.uint8)
    h, w = rgba.shape[:2]
    x0, y0, x1, y1 = max(x, 0), max(y, 0), min(x + side, w), min(y + side, h)
    if x0 < x1 and y0 < y1:
        out[y0 - y : y1 - y, x0 - x : x1 - x] = rgba[y0:y1, x0:x1]
    return out


def stamp_name(path: Column, x: Column, y: Column) -> Column:
    return F.format_string("%s_x%d_y%d.png", scalars.stem(path), x, y)


def paint(rgba: np.ndarray, mask: np.ndarray, colour: tuple[int, int, int], share: float = 0.6) -> np.ndarray:
    """The image with a region blended towards a colour and made opaque."""
    out = rgba.copy()
    out[mask, :3] = np.round(rgba[mask, :3] * (1 - share) + np.array(colour) * share).astype(np.uint8)
    out[mask, 3] = 255
    return out


def label_line(cls: Column, ring: Column, w: Column, h: Column) -> Column:
    """A polygon's line of a label file: its class, then x and y as shares of the image."""
    part = F.transform(ring, lambda p: F.concat_ws(" ", scalars.fixed(p["x"] / w, 6), scalars.fixed(p["y"] / h, 6)))
    return F.concat_ws(" ", cls.cast("string"), F.concat_ws(" ", part))


def dataset_plan(scenes: DataFrame, recorded: DataFrame) -> DataFrame:
    """Reviewed scenes with their index, split and file names: recorded ones keep theirs, new ones follow the largest, by path.

    scenes (src, reviewed, ...), recorded (src, index, split).
    """
    from verdure.sources.sinks import dataset_index

    placed = dataset_index(scenes.where("reviewed"), recorded.select("src", "index")).join(recorded.select("src", F.col("split").alias("_split")), "src", "left")
    split = F.coalesce("_split", scalars.split(scalars.file_name(F.col("src"))))
    stem = F.format_string("real_%06d", F.col("index").cast("long"))
    return placed.withColumn("split", split).withColumn("image", F.concat(F.lit("images/"), "split", F.lit("/"), stem, F.lit(".png"))).withColumn("label", F.concat(F.lit("labels/"), "split", F.lit("/"), stem, F.lit(".txt"))).drop("_split")


def export_dataset(scenes: DataFrame, recorded: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Writes images, label files and, if there is none, the description; (the plan, (exported, skipped, failed)).

    scenes (src, reviewed, w, h, content, instances array<struct<class, ring>>). A scene with
    a file that can't be written has failed.
    """
    from verdure.session import cut

    spark = scenes.sparkSession
    plan = cut(dataset_plan(scenes, recorded))
    lines = F.concat_ws("\n", F.transform("instances", lambda i: label_line(i["class"], i["ring"], F.col("w"), F.col("h"))))
    files = plan.select(F.col("image").alias("name"), "content").union(plan.select(F.col("label").alias("name"), F.encode(lines, "UTF-8").alias("content")))
    written = cut(put_files(files, root))
    description = f"{root.rstrip('/')}/data.yaml"
    target = spark._jvm.org.apache.hadoop.fs.Path(description)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        put_text(spark, description, f"path: {root}\ntrain: images/train\nval: images/val\n\nnc: 1\nnames: ['leaf']\n")
    bad = written.where("error is not null").select(F.regexp_extract("name", r"(real_\d+)", 1).alias("stem")).distinct()
    failed = plan.withColumn("stem", F.regexp_extract("image", r"(real_\d+)", 1)).join(bad, "stem", "left_semi").agg(F.count("*").alias("failed"))
    counts = scenes.agg(F.count_if(F.col("reviewed")).alias("reviewed"), F.count_if(~F.col("reviewed")).alias("skipped"))
    return plan, counts.join(failed).select((F.col("reviewed") - F.col("failed")).alias("exported"), "skipped", "failed")
