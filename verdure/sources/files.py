"""Readers of logs, models, labels and binary tables."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, LongType, StructField, StructType

from verdure.kernels.apply import map_leaves
from verdure.operators.state import last_write_wins

LABELS = "crop string, mask string, family string, source string, leaf_src string, ts long"
REVIEW = "src string, n int, state string, w int, h int"
META = "threshold double, ch_thresholds map<string,double>, dino_threshold double, scale_floors map<string,double>, dim int, project_dim int"
HEAD = "infer_resolution int, patch_size int, dim int, classes array<int>, intercept array<double>, coef array<array<double>>, tau_default double, families map<string,string>, onnx_parity double, per_family_tau map<string,double>"
BANK = StructType([StructField("row_id", LongType()), StructField("v", ArrayType(FloatType()))])


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Curation rows of a JSON-lines file; malformed lines are dropped, missing optional fields are empty."""
    rows = spark.read.schema(LABELS).option("mode", "DROPMALFORMED").json(path).where("crop is not null")
    return rows.select("crop", *[F.coalesce(c, F.lit("")).alias(c) for c in ("mask", "family", "source", "leaf_src")], F.coalesce("ts", F.lit(0)).alias("ts"))


#: Order of a log's lines: files, then splits, then lines within a split.
PLACE = ["_file", "_split", "_line"]


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a log, which may have grown file by file, with their place in it; no file is held whole.

    Files are numbered by the time of their append's first file, then by name: numbers, as
    all that a line carries is sorted and held. The part files of one write are one append,
    in order of their numbers, whichever was done first.
    """
    at = lambda c: F.col(f"_metadata.{c}")
    write = F.regexp_extract("_path", r"/part-\d+-([^/]+)-c\d+[^/]*$", 1)
    append = F.when(write != "", F.concat(F.regexp_extract("_path", "^(.*)/", 1), F.lit("/"), write)).otherwise(F.col("_path"))
    files = spark.read.format("binaryFile").load(path).select(at("file_path").alias("_path"), at("file_modification_time").alias("_time"))
    timed = files.withColumn("_time", F.min("_time").over(Window.partitionBy(append)))
    numbers = timed.select("_path", F.row_number().over(Window.orderBy("_time", "_path")).alias("_file"))
    lines = spark.read.text(path).select(F.col("value").alias("text"), at("file_path").alias("_path"), at("file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_line"))
    return lines.join(F.broadcast(numbers), "_path").select("text", *PLACE)


def review_state(spark: SparkSession, path: str) -> DataFrame:
    """The last state of each (src, n); rows that lack src, n or state are dropped; "none" cancels a mark."""
    row = F.from_json("text", REVIEW).alias("r")
    rows = _numbered(spark, path).select(*PLACE, row).select(*PLACE, "r.*").where("src is not null and n is not null and state is not null")
    rows = rows.withColumn("w", F.coalesce("w", F.lit(0))).withColumn("h", F.coalesce("h", F.lit(0)))
    return last_write_wins(rows, ["src", "n"], PLACE).where("state <> 'none'").drop(*PLACE)


def sort_state(spark: SparkSession, path: str) -> DataFrame:
    """The last status of each path; a line is parted at its last comma, each file's header is skipped."""
    part = lambda k: F.trim(F.regexp_extract("text", "^(.*),([^,]*)$", k))
    lines = _numbered(spark, path)
    header = lines.groupBy("_file").agg(F.min(F.struct("_split", "_line")).alias("_h")).select("_file", "_h._split", "_h._line")
    rows = lines.join(header, ["_file", "_split", "_line"], "left_anti").where("text like '%,%'")
    rows = rows.select(*PLACE, part(1).alias("source_path"), part(2).alias("status")).where("source_path <> ''")
    return last_write_wins(rows, ["source_path"], PLACE).drop(*PLACE)


def detector_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(META).option("multiLine", "true").json(path)


def channel_threshold(meta: DataFrame, channel: str) -> DataFrame:
    """(threshold, floor) of a channel; infinite and 0 where it has none."""
    return meta.select(F.coalesce(F.try_element_at("ch_thresholds", F.lit(channel)), F.lit(float("inf"))).alias("threshold"), F.coalesce(F.try_element_at("scale_floors", F.lit(channel)), F.lit(0.0)).alias("floor"))


def classifier_head(spark: SparkSession, path: str) -> DataFrame:
    """(class, name, intercept, coef, tau); the lengths of classes, intercepts and coefficients must agree."""
    h = spark.read.schema(HEAD).option("multiLine", "true").json(path)
    n = F.size("classes")
    good = (F.size("intercept") == n) & (F.size("coef") == n) & F.forall("coef", lambda c: F.size(c) == F.col("dim"))
    checked = h.withColumn("classes", F.when(good, F.col("classes")).otherwise(F.raise_error(F.lit("the head's shapes disagree")).cast("array<int>")))
    rows = checked.select(F.posexplode("classes").alias("i", "class"), "intercept", "coef", "tau_default", "families", "per_family_tau")
    key = F.col("class").cast("string")
    return rows.select("class", F.try_element_at("families", key).alias("name"), F.get("intercept", F.col("i")).alias("intercept"), F.get("coef", F.col("i")).alias("coef"), F.coalesce(F.try_element_at("per_family_tau", key), "tau_default").alias("tau"))


def bank(spark: SparkSession, path: str) -> DataFrame:
    """(row_id, v, error) of a binary bank: little-endian counts of rows and components, then the components."""
    from verdure.sources import binary

    return binary.bank(spark, path)


_HEAD_ROWS = "array<struct<class:int,name:string,coef_norm:double,intercept:double>>"


def diagnostics(spark: SparkSession, path: str) -> DataFrame:
    """(phase, class, name, coef_norm, intercept, n_rows, dim) of a run's diagnostics, before and after."""
    j = spark.read.text(path, wholetext=True).select(F.from_json("value", f"n_rows long, dim int, before {_HEAD_ROWS}, after {_HEAD_ROWS}").alias("j")).select("j.*")
    phase = lambda name: j.select(F.lit(name).alias("phase"), F.explode(name).alias("h"), "n_rows", "dim").select("phase", "h.*", "n_rows", "dim")
    return phase("before").union(phase("after"))


def bank_bytes(v: np.ndarray) -> bytes:
    return struct.pack("<II", *v.shape) + v.astype("<f4").tobytes()


def polygons(spark: SparkSession, path: str, sizes: DataFrame | None = None) -> DataFrame:
    """(path, line, class, ring) of polygon label files: a class, then x and y in turn.

    Words that aren't numbers are passed over; lines without a whole class, of under 3
    points or of an odd count are dropped. With ``sizes`` (stem, w, h) of the images, the
    coordinates, shares of the image, become pixels.
    """
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    numbers = lines.select("path", "line", F.filter(F.split(F.trim("text"), r"\s+"), lambda x: x != "").alias("words"))
    rest = F.filter(F.transform(F.slice("words", F.lit(2), F.greatest(F.size("words") - 1, F.lit(0))), lambda x: x.try_cast("double")), lambda x: x.isNotNull() & ~F.isnan(x))
    first = F.get("words", F.lit(0))
    rows = numbers.select("path", "line", F.when(first.rlike("^[0-9]+$"), first.try_cast("int")).alias("class"), rest.alias("v")).where("class is not null and size(v) >= 6 and size(v) % 2 = 0")
    w, h = F.lit(1), F.lit(1)
    if sizes is not None:
        stem = F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
        rows = rows.withColumn("stem", stem).join(sizes.select("stem", "w", "h"), "stem")
        w, h = F.col("w"), F.col("h")
    point = lambda i: F.struct((F.get("v", (i * 2).cast("int")) * w).alias("x"), (F.get("v", (i * 2 + 1).cast("int")) * h).alias("y"))
    return rows.select("path", "line", "class", F.transform(F.sequence(F.lit(0), F.floor(F.size("v") / 2).cast("int") - 1), point).alias("ring"))


def export_map(spark: SparkSession, path: str) -> DataFrame:
    """(src, index, split) of an export map: path to (index, split); one JSON text, or parts of one object to a line."""
    m = spark.read.text(path, wholetext=path.endswith(".json")).select(F.from_json("value", "map<string,struct<index:int,split:string>>").alias("m"))
    return m.select(F.explode("m").alias("src", "v")).select("src", "v.index", "v.split")


def sidecar(spark: SparkSession, path: str) -> DataFrame:
    """(epoch, iou) of a text of key=value lines."""
    kv = spark.read.text(path, wholetext=True).select(F.str_to_map("value", F.lit("\n"), F.lit("=")).alias("m"))
    return kv.select(F.trim(F.try_element_at("m", F.lit("epoch"))).try_cast("int").alias("epoch"), F.trim(F.try_element_at("m", F.lit("iou"))).try_cast("double").alias("iou"))


def head_versions(files: DataFrame, now: int) -> DataFrame:
    """(path, name, ts, age) of calibrated heads {name}_{ts}.json, youngest first."""
    part = lambda k: F.regexp_extract("path", r"([^/]*)_(\d+)\.json$", k)
    rows = files.select("path", part(1).alias("name"), part(2).alias("ts")).where("ts <> ''")
    return rows.withColumn("ts", F.col("ts").cast("long")).withColumn("age", F.lit(now) - F.col("ts")).orderBy("age", "name")


def features(cache: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cached features of the wanted (path, resolution, dim), and the rows that must be computed."""
    keys = ["path", "resolution", "dim"]
    return wanted.join(cache, keys), wanted.join(cache.select(*keys), keys, "left_anti")
