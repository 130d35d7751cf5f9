"""Sources, sinks, logs and streams as queries: each writes its files to the session's shared folder and reads them back.

What is written comes from whole tables, so that SQL over the tables gives the same rows.
"""

from __future__ import annotations

import json
import threading

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from verdure.functions import scalars
from verdure.kernels.apply import map_leaves
from verdure.operators import state
from verdure.plans import pixels
from verdure.plans.catalog import EXPLODED, query, r6, table
from verdure.session import cut, shared_path
from verdure.sources import binary, buckets, exports, files, images, sinks

# --- images ---


def _image(k: int) -> np.ndarray:
    """A small picture of a number; every third is a cut-out."""
    y, x = np.mgrid[:6, :8]
    alpha = np.where((x + k) % 8 < 3, 0, 255) if k % 3 == 0 else np.full(x.shape, 255)
    return np.stack([(x * 7 + k) % 256, (y * 11 + k) % 256, np.full(x.shape, k % 256), alpha], axis=-1).astype(np.uint8)


def _folder(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """A folder of pictures, one for each supplier, of mixed endings; some lie in its output folder, some are broken."""
    ending = F.element_at(F.array(*map(F.lit, ("PNG", "png", "Jpeg", "txt"))), (F.col("k") % 4 + 1).cast("int"))
    folder = F.when(F.col("k") % 5 == 0, "out/").when(F.col("k") % 5 == 1, "about/out/").otherwise("a/")
    named = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k")).select("k", F.concat(folder, F.lit("i"), F.format_string("%06d", "k"), F.lit("."), ending).alias("name"))
    content = StructType([StructField("name", StringType()), StructField("k", LongType())])

    def draw(rows):
        import pyarrow as pa

        for batch in rows:
            data = [b"broken" if k % 7 == 0 else images.encode(_image(k)) for k in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["name", "content"])

    root = shared_path(spark, "images")
    exports.put_files(named.select("name", "k").to(content).mapInArrow(draw, "name string, content binary"), root).where("error is not null").count()
    return root, named


_NAMED = "SELECT s_suppkey AS k, CASE s_suppkey % 5 WHEN 0 THEN 'out/' WHEN 1 THEN 'about/out/' ELSE 'a/' END || 'i' || printf('%06d', s_suppkey) || '.' || ['PNG', 'png', 'Jpeg', 'txt'][s_suppkey % 4 + 1] AS name FROM supplier"


def _below(root: str):
    return F.substring_index("path", root.rstrip("/").rsplit("/", 1)[1] + "/", -1)


@query(f"SELECT name, CAST(row_number() OVER (ORDER BY name) - 1 AS BIGINT) AS ord FROM ({_NAMED}) WHERE k % 4 <> 3")
def image_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, _ = _folder(spark, sf_dir)
    return images.listing(images.scan(spark, root)).select(_below(root).alias("name"), F.col("ord").cast("long").alias("ord"))


@query(f"SELECT (SELECT count(*) FROM ({_NAMED}) WHERE k % 4 <> 3) AS n, (SELECT count(*) FROM ({_NAMED}) WHERE k % 4 <> 3 AND k % 5 <> 0) AS outside")
def image_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, _ = _folder(spark, sf_dir)
    inside = images.count(images.scan(spark, root))
    return inside.join(images.count(images.scan(spark, root, outside=f"{root}/out/")).withColumnRenamed("n", "outside"))


@query(f"SELECT name FROM ({_NAMED}) WHERE k % 4 <> 3 AND k % 5 <> 0")
def image_scan_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, _ = _folder(spark, sf_dir)
    return images.scan(spark, root, outside=f"{root}/out").select(_below(root).alias("name"))


@query("""
WITH p AS (SELECT p_partkey, 'd/' || p_size AS folder, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '/' || p_brand WHEN 2 THEN '0' ELSE '' END AS tail, p_partkey % 8 >= 4 AS turned FROM part)
SELECT p_partkey, tail = '0' AS apart FROM p""")
def folders_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of folders: the same in other words, one within the other, either way, and one whose name only begins alike."""
    k = F.col("p_partkey") % 4
    source = F.concat(F.lit("/d/"), "p_size")
    out = F.when(k == 0, F.concat(F.lit("file:///d//"), "p_size", F.lit("/"))).when(k == 1, F.concat(source, F.lit("/"), "p_brand")).when(k == 2, F.concat(source, F.lit("0"))).otherwise(source)
    turned = F.col("p_partkey") % 8 >= 4
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(turned, out).otherwise(source).alias("a"), F.when(turned, source).otherwise(out).alias("b"))
    return rows.select("p_partkey", images.lie_apart(F.col("a"), F.col("b")).alias("apart"))


@query(f"""
WITH p AS (SELECT name, k, unnest(range(8)) AS x FROM ({_NAMED}) WHERE k % 4 <> 3), q AS (SELECT name, k, x, unnest(range(6)) AS y FROM p)
SELECT name, CASE WHEN k % 7 <> 0 THEN 8 ELSE 0 END AS w, CASE WHEN k % 7 <> 0 THEN 6 ELSE 0 END AS h, CASE WHEN k % 7 <> 0 THEN CAST(sum((x * 7 + k) % 256 + (y * 11 + k) % 256 + k % 256 + CASE WHEN k % 3 = 0 AND (x + k) % 8 < 3 THEN 0 ELSE 255 END) AS DOUBLE) ELSE 0 END AS total,
  k % 7 <> 0 AND k % 3 = 0 AS cutout, k % 7 = 0 AS failed FROM q GROUP BY name, k""")
def image_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures decoded, probed for being cut-outs; a broken one is a row with its error."""
    root, _ = _folder(spark, sf_dir)
    schema = StructType.fromDDL("path string, w int, h int, total double, cutout boolean")

    def kernel(row: dict) -> list[dict]:
        try:
            px = images.decode(row["content"])
        except Exception as e:
            raise ValueError(f"{row['path']}: {e}") from e
        return [{"path": row["path"], "w": px.shape[1], "h": px.shape[0], "total": float(px.sum()), "cutout": images.is_cutout(px)}]

    found = map_leaves(images.scan(spark, root).select("path", "content"), kernel, schema)
    path = F.coalesce("path", F.regexp_extract("error", r"^ValueError: (\S+): ", 1))
    return found.withColumn("path", path).select(_below(root).alias("name"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("w", "h")], F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("cutout", F.lit(False)).alias("cutout"), F.col("error").isNotNull().alias("failed"))


@query("""
SELECT s_suppkey AS k, printf('i%06d_x%d_y%d.png', s_suppkey, s_suppkey % 12 - 3, s_suppkey % 9 - 2) AS name, greatest(0, least(8, s_suppkey % 12 - 3 + 5) - greatest(0, s_suppkey % 12 - 3)) * greatest(0, least(6, s_suppkey % 9 - 2 + 5) - greatest(0, s_suppkey % 9 - 2)) AS inside FROM supplier""")
def tile_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = StructType.fromDDL("k long, inside long")

    def kernel(row: dict) -> list[dict]:
        whole = np.full((6, 8, 4), 255, np.uint8)
        cut = exports.stamp(whole, row["k"] % 12 - 3, row["k"] % 9 - 2, 5)
        return [{"k": row["k"], "inside": int((cut[..., 3] > 0).sum())}]

    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k"))
    name = exports.stamp_name(F.concat(F.lit("x/i"), F.format_string("%06d", "k"), F.lit(".png")), F.col("k") % 12 - 3, F.col("k") % 9 - 2)
    return map_leaves(rows, kernel, schema).select("k", name.alias("name"), "inside")


@query("SELECT s_suppkey AS k, CAST(24 * round_even(CAST((s_suppkey % 256) * 0.4 + 200 * 0.6 AS DOUBLE), 0) + 24 * (s_suppkey % 256) AS BIGINT) AS blue, 24 AS opaque FROM supplier")
def overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions painted over pictures, written as files and read again."""
    root = shared_path(spark, "overlays")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k"))

    def draw(row: dict) -> list[dict]:
        px, mask = np.zeros((6, 8, 4), np.uint8), np.zeros((6, 8), bool)
        px[..., 2], mask[:, :4] = row["k"] % 256, True
        return [{"name": f"{row['k']}.png", "content": images.encode(exports.paint(px, mask, (10, 20, 200)))}]

    painted = map_leaves(rows, draw, StructType.fromDDL("name string, content binary")).drop("error")
    exports.export_run({}, painted, exports.folder_writer(root), slices=2)

    def read(row: dict) -> list[dict]:
        px = images.decode(row["content"])
        return [{"k": int(row["path"].rsplit("/", 1)[1][:-4]), "blue": int(px[..., 2].astype(int).sum()), "opaque": int((px[..., 3] == 255).sum())}]

    return map_leaves(images.scan(spark, root).select("path", "content"), read, StructType.fromDDL("k long, blue long, opaque int")).drop("error")


# --- models and features ---


@query(f"SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS row_id, round(sum(x * (dim + 1)), 3) AS s FROM ({EXPLODED}) GROUP BY vec_id")
def bank_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bank written in its binary form, in parts, and read again by ranges."""
    from verdure.functions import vectors

    root = shared_path(spark, "bank")
    binary.write_bank(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v")), ["vec_id"], root, 300)
    ones = F.lit([float(d + 1) for d in range(64)])
    return binary.bank(spark, root, 20_000).select("row_id", F.round(vectors.dot(F.col("v"), ones), 3).alias("s"))


@query("""
SELECT event_type AS channel, round(max(value), 6) AS threshold, round(min(value), 6) AS floor, round((SELECT max(value) FROM events), 6) AS top FROM events GROUP BY 1 UNION ALL SELECT 'none', CAST('inf' AS DOUBLE), 0, round((SELECT max(value) FROM events), 6)""")
def detector_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("event_type").agg(F.max("value").alias("hi"), F.min("value").alias("lo")).collect()
    path = shared_path(spark, "meta") + "/meta.json"
    exports.put_text(spark, path, exports.meta_json({r.event_type: r.hi for r in rows}, {r.event_type: r.lo for r in rows}, 0.5, 64))
    meta = files.detector_meta(spark, path)
    out = None
    for name in [*(r.event_type for r in rows), "none"]:
        one = files.channel_threshold(meta, name).join(meta.select("threshold").withColumnRenamed("threshold", "top")).select(F.lit(name).alias("channel"), r6("threshold").alias("threshold"), r6("floor").alias("floor"), r6("top").alias("top"))
        out = one if out is None else out.union(one)
    return out


@query("SELECT 'now' AS file, n_nationkey AS class, n_name AS name, CAST(n_regionkey * 0.5 AS DOUBLE) AS intercept, CAST(n_nationkey * 3 AS DOUBLE) AS total, CAST(CASE WHEN n_nationkey % 2 = 0 THEN 0.6 ELSE 0.8 END AS DOUBLE) AS tau FROM nation UNION ALL SELECT 'before', n_nationkey, n_name, n_regionkey * 0.5, CAST(n_nationkey * 3 AS DOUBLE), 0.8 FROM nation")
def classifier_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A head written twice; the first version stays beside it."""
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()
    head = {"dim": 2, "classes": [r.n_nationkey for r in rows], "intercept": [r.n_regionkey * 0.5 for r in rows], "coef": [[r.n_nationkey, 2 * r.n_nationkey] for r in rows], "tau_default": 0.8, "families": {str(r.n_nationkey): r.n_name for r in rows}}
    path = shared_path(spark, "head") + "/head.json"
    exports.put_text(spark, path, json.dumps(head), backup=True)
    exports.put_text(spark, path, json.dumps(head | {"per_family_tau": {str(r.n_nationkey): 0.6 for r in rows if r.n_nationkey % 2 == 0}}), backup=True)
    shown = lambda name, file: files.classifier_head(spark, file).select(F.lit(name).alias("file"), "class", "name", "intercept", F.aggregate("coef", F.lit(0.0), lambda a, x: a + x).alias("total"), "tau")
    return shown("now", path).union(shown("before", path + ".bak"))


@query(f"SELECT vec_id AS row_id, CAST(label AS INTEGER) AS class, CAST(vec_id % 4 * 0.25 AS DOUBLE) AS weight, round(sum(x * (dim + 1)), 3) AS s FROM ({EXPLODED}) GROUP BY vec_id, label")
def training_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training matrix in its binary form, in parts, read again as a base set by ranges."""
    from verdure.functions import vectors

    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("int").alias("class"), (F.col("vec_id") % 4 * 0.25).alias("weight"), F.col("embedding").alias("v"))
    root = shared_path(spark, "dump")
    binary.write_dump(rows, ["vec_id"], root, 300)
    ones = F.lit([float(d + 1) for d in range(64)])
    return binary.base_set(spark, root, 20_000).select("row_id", "class", F.col("weight").cast("double").alias("weight"), F.round(vectors.dot(F.col("v"), ones), 3).alias("s"))


@query(f"""
WITH s AS (SELECT label, dim, sum(x) AS t FROM ({EXPLODED}) GROUP BY ALL), m AS (SELECT label, dim, avg(x) AS t FROM ({EXPLODED}) GROUP BY ALL),
n AS (SELECT 'before' AS phase, label, sqrt(sum(CAST(t AS DOUBLE) ** 2)) AS norm FROM s GROUP BY label UNION ALL SELECT 'after', label, sqrt(sum(CAST(t AS DOUBLE) ** 2)) FROM m GROUP BY label)
SELECT phase, CAST(label AS INTEGER) AS class, CASE WHEN label = 0 THEN 'Healthy' ELSE 'family ' || label END AS name, round(norm, 4) AS coef_norm, CAST(-label AS DOUBLE) AS intercept, (SELECT count(*) FROM embeddings) AS n_rows, 64 AS dim FROM n""")
def retrain_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Norms of a head's coefficients before and after a run, as one row of JSON, read again."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("total"), F.avg("x").alias("mean"))

    def head(column: str) -> DataFrame:
        coef = e.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", column))).alias("c"))
        return coef.select(F.col("label").alias("class"), F.when(F.col("label") > 0, F.concat(F.lit("family "), "label")).alias("name"), F.transform("c", lambda c: c[column]).alias("coef"), (-F.col("label")).cast("double").alias("intercept"))

    n = table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n_rows"), F.lit(64).alias("dim"))
    path = shared_path(spark, "diagnostics")
    exports.diagnostics(n, head("total"), head("mean")).write.text(path)
    return files.diagnostics(spark, path).select("phase", "class", "name", F.round("coef_norm", 4).alias("coef_norm"), "intercept", "n_rows", "dim")


@query("SELECT p_partkey AS path, p_size AS resolution, 64 AS dim, p_partkey < 500 AND p_size % 2 = 0 AND p_partkey % 10 <> 0 AS cached FROM part")
def feature_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of another size, resolution or dimension is a miss, never an error."""
    wanted = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("resolution"), F.lit(64).alias("dim"))
    path = shared_path(spark, "cache")
    kept = wanted.where("path < 500").select("path", F.when(F.col("resolution") % 2 == 0, F.col("resolution")).otherwise(0).alias("resolution"), F.when(F.col("path") % 10 == 0, 32).otherwise(64).alias("dim"), F.lit(1.0).alias("feature"))
    kept.write.partitionBy("dim").parquet(path)
    hit, miss = files.features(spark.read.parquet(path), wanted)
    return hit.select("path", "resolution", "dim", F.lit(True).alias("cached")).union(miss.select("path", "resolution", "dim", F.lit(False).alias("cached")))


@query("SELECT 'h' || p_size || '_' || (1000 + p_partkey) || '.json' AS name, 1000 + p_partkey AS ts, 5000 - p_partkey AS age FROM part WHERE p_partkey % 3 = 0")
def head_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    path = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("dir/h"), "p_size", F.lit("_"), F.col("p_partkey") + 1000, F.lit(".json"))).otherwise(F.concat(F.lit("dir/h"), "p_size", F.lit(".json")))
    return files.head_versions(part.select(path.alias("path")), 6000).select(scalars.file_name(F.col("path")).alias("name"), "ts", "age")


# --- logs ---


def _log(spark: SparkSession, sf_dir: str, name: str) -> str:
    """The events as a review log that grew in three appends, each in files of its own, dealt by ranges, with broken lines between."""
    path = shared_path(spark, name)
    e = table(spark, sf_dir, "events")
    for k in range(3):
        part = e.where((F.col("event_id") >= F.lit(k) * 350) & (F.col("event_id") < (k + 1) * 350 if k < 2 else F.lit(True)))
        rows = part.select("event_id", F.to_json(F.struct(F.col("user_id").cast("string").alias("src"), (F.col("event_id") % 2).alias("n"), F.when(F.col("event_type") == "error", "none").otherwise(F.col("event_type")).alias("state"), (F.col("event_id") % 50).alias("w"))).alias("value"))
        broken = spark.createDataFrame([(-1, "not json"), (-1, '{"n": 1}'), (-1, "")], "event_id long, value string")
        rows.union(broken).repartitionByRange("event_id").sortWithinPartitions("event_id").select("value").write.mode("append").text(path)
    return path


@query("""
SELECT src, n, state, w, h FROM (SELECT CAST(user_id AS VARCHAR) AS src, CAST(event_id % 2 AS INTEGER) AS n, arg_max(CASE WHEN event_type = 'error' THEN 'none' ELSE event_type END, event_id) AS state, CAST(arg_max(event_id % 50, event_id) AS INTEGER) AS w, 0 AS h FROM events GROUP BY 1, 2) WHERE state <> 'none'""")
def review_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.review_state(spark, _log(spark, sf_dir, "review"))


@query("""
SELECT 'dir, x/' || user_id || '.png' AS source_path, arg_max(event_type, event_id) AS status, 'log' AS by FROM events GROUP BY 1 UNION ALL SELECT 'dir, x/' || user_id || '.png', arg_max(event_type, event_id), 'archived' FROM events GROUP BY 1""")
def sort_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sorting log with a header in each file, read before and after it was archived."""
    path = shared_path(spark, "sort") + "/_sorting_log.csv"
    e = table(spark, sf_dir, "events")
    lines = e.select("event_id", F.concat(F.lit("dir, x/"), "user_id", F.lit(".png, "), "event_type").alias("value"))

    def headed(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"value": ["source_path,status"]})
        yield from batches

    lines.repartitionByRange("event_id").sortWithinPartitions("event_id").select("value").mapInArrow(headed, "value string").write.text(path)
    live = files.sort_state(spark, path).withColumn("by", F.lit("log"))
    kept = cut(live)
    return kept.union(files.sort_state(spark, exports.archive(spark, path)).withColumn("by", F.lit("archived")))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat(F.lit("region_"), F.floor(F.col("p_partkey") / 2), F.when(F.col("p_partkey") % 2 == 0, ".png").otherwise("_1.png")).alias("crop"), F.col("p_brand").alias("family"))


_LABELS = "SELECT 'region_' || p_partkey // 2 || CASE WHEN p_partkey % 2 = 0 THEN '.png' ELSE '_1.png' END AS crop, p_brand AS family, p_partkey // 2 AS r FROM part"


@query(f"""
SELECT 'upsert' AS op, crop, family FROM ({_LABELS}) WHERE r NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT 'upsert', 'region_' || s_suppkey || '.png', 'new' FROM supplier
UNION ALL SELECT 'retract', crop, family FROM ({_LABELS}) WHERE crop NOT IN (SELECT 'region_' || s_suppkey || '_1.png' FROM supplier)
UNION ALL SELECT 'rename', crop, CASE WHEN family = 'Brand#2' THEN 'two' ELSE family END FROM ({_LABELS})""")
def label_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _labels(spark, sf_dir)
    key = table(spark, sf_dir, "supplier")
    new = key.select(F.concat(F.lit("region_"), "s_suppkey", F.lit(".png")).alias("crop"), F.lit("new").alias("family"))
    gone = key.select(F.concat(F.lit("region_"), "s_suppkey", F.lit("_1.png")).alias("crop"))
    ops = {"upsert": state.upsert_labels(labels, new), "retract": state.retract_labels(labels, gone), "rename": state.rename_family(labels, "Brand#2", "two")}
    out = None
    for op, rows in ops.items():
        one = rows.select(F.lit(op).alias("op"), "crop", "family")
        out = one if out is None else out.union(one)
    return out


@query(f"""
WITH l AS (SELECT *, r % 64 AS b FROM ({_LABELS})), s AS (SELECT s_suppkey FROM supplier WHERE s_suppkey % 64 < 7)
SELECT op, crop, family, rewritten FROM (
  SELECT 'upsert' AS op, crop, family FROM l WHERE r NOT IN (FROM s) UNION ALL SELECT 'upsert', 'region_' || s_suppkey || '.png', 'new' FROM s
  UNION ALL SELECT 'retract', crop, family FROM l WHERE r NOT IN (FROM s) UNION ALL SELECT 'retract', 'region_' || s_suppkey || '.png', 'new' FROM s WHERE s_suppkey % 2 = 1
  UNION ALL SELECT 'rename', crop, CASE WHEN family = 'Brand#2' THEN 'two' ELSE family END FROM l WHERE r NOT IN (FROM s) UNION ALL SELECT 'rename', 'region_' || s_suppkey || '.png', 'new' FROM s WHERE s_suppkey % 2 = 1)
JOIN (SELECT 'upsert' AS op, (SELECT count(DISTINCT s_suppkey % 64) FROM s) AS rewritten UNION ALL SELECT 'retract', (SELECT count(DISTINCT s_suppkey % 64) FROM s WHERE s_suppkey % 2 = 0)
  UNION ALL SELECT 'rename', (SELECT count(DISTINCT b) FROM l WHERE family = 'Brand#2' AND r NOT IN (FROM s))) USING (op)""")
def label_table_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of curation rows on disk, and how many of the table's 64 buckets each of them rewrote."""
    rows = _labels(spark, sf_dir).select("crop", F.lit("").alias("mask"), "family", F.lit("").alias("source"), F.lit("").alias("leaf_src"), F.lit(0).cast("long").alias("ts"))
    labels = buckets.label_table(spark, shared_path(spark, "curation"))
    buckets.upsert_label_rows(labels, rows)
    key = table(spark, sf_dir, "supplier").where("s_suppkey % 64 < 7")
    crop = F.concat(F.lit("region_"), "s_suppkey", F.lit(".png")).alias("crop")
    out = None
    for op, edit in (
        ("upsert", lambda: buckets.upsert_label_rows(labels, key.select(crop, F.lit("").alias("mask"), F.lit("new").alias("family"), F.lit("").alias("source"), F.lit("").alias("leaf_src"), F.lit(1).cast("long").alias("ts")))),
        ("retract", lambda: buckets.retract_label_rows(labels, key.where("s_suppkey % 2 = 0").select(crop))),
        ("rename", lambda: buckets.rename_label_family(labels, "Brand#2", "two")),
    ):
        done = edit()
        one = cut(labels.read().select(F.lit(op).alias("op"), "crop", "family", F.lit(len(done.buckets)).cast("long").alias("rewritten")))
        out = one if out is None else out.union(one)
    return out


@query("""
WITH e AS (SELECT *, sum(bytes) OVER (ORDER BY used DESC, item_id ROWS UNBOUNDED PRECEDING) <= 400000 AS kept FROM (SELECT item_id, 100 + coalesce(size, 0) * 10 AS bytes, item_id * 37 % 1009 AS used FROM items) WHERE used >= 100),
now AS (SELECT item_id, bytes, CASE WHEN item_id % 3 = 0 THEN 2000 ELSE used END AS used FROM e WHERE kept), w AS (SELECT item_id, count(*) FILTER (kept) > 0 AS hit FROM items LEFT JOIN e USING (item_id) WHERE item_id % 3 = 0 GROUP BY item_id),
last AS (SELECT item_id, sum(bytes) OVER (ORDER BY used DESC, item_id ROWS UNBOUNDED PRECEDING) <= 200000 AS kept FROM now)
SELECT item_id, hit, coalesce(kept, false) AS kept, true AS bound FROM w LEFT JOIN last USING (item_id)""")
def bounded_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache on disk held to a number of bytes and an age, asked for every third entry, and held to fewer bytes then: what was asked for stays first."""
    items = table(spark, sf_dir, "items").select("item_id", (F.lit(100) + F.coalesce("size", F.lit(0)) * 10).cast("long").alias("bytes"), (F.col("item_id") * 37 % 1009).alias("used"))
    cache = buckets.Buckets(spark, shared_path(spark, "cache"), "item_id long, bytes long, used long", F.col("item_id"), 32)
    buckets.upsert(cache, items, ["item_id"], ["used"])
    held = []
    for most, since in ((400_000, 100), (200_000, None)):
        buckets.evict(cache, ["item_id"], "bytes", "used", most, since)
        held.append(cache.read().agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0] <= most)
        if since:
            hits, misses, _ = buckets.look_up(cache, items.where("item_id % 3 = 0"), ["item_id"], "used", 2000)
    asked = hits.select("item_id", F.lit(True).alias("hit")).union(misses.select("item_id", F.lit(False)))
    kept = cache.read().select("item_id", F.lit(True).alias("kept"))
    return asked.join(kept, "item_id", "left").select("item_id", "hit", F.coalesce("kept", F.lit(False)).alias("kept"), F.lit(all(held)).alias("bound"))


@query(f"SELECT crop, family, '' AS mask, 0 AS ts FROM ({_LABELS})")
def label_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label rows appended to a JSON-lines file amid broken lines."""
    path = shared_path(spark, "labels")
    sinks.append_json(_labels(spark, sf_dir), path)
    spark.createDataFrame([("broken",), ("",), ('{"family": "x"}',)], "value string").coalesce(1).write.mode("append").text(path)
    return files.labels(spark, path).select("crop", "family", "mask", F.col("ts").cast("int").alias("ts"))


@query("""
WITH e AS (SELECT event_id AS seq, user_id AS key, event_type = 'error' AS undo, value AS after FROM events), u AS (SELECT key, arg_max(seq, seq) FILTER (NOT undo) AS last FROM e GROUP BY key),
gone AS (SELECT max(p.seq) AS seq FROM e x JOIN e p ON p.key = x.key AND p.seq < x.seq AND NOT p.undo WHERE x.undo GROUP BY x.seq)
SELECT CAST(key AS BIGINT) AS key, arg_max(after, seq) AS after FROM e WHERE NOT undo AND seq NOT IN (SELECT seq FROM gone) GROUP BY key""")
def undo_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of which an error undoes the user's last edit before it."""
    from pyspark.sql import Window

    w = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("key"), F.when(F.col("event_type") == "error", "undo").otherwise("paint").alias("kind"), F.col("value").alias("after"))
    e = e.withColumn("undoes", F.when(F.col("kind") == "undo", F.last(F.when(F.col("kind") == "paint", F.col("seq")), True).over(w)))
    return state.fold_edits(e, "key", "seq")


@query("""
SELECT CAST(user_id AS VARCHAR) AS source_folder, CAST(max(event_id) AS INTEGER) AS last_index, printf('%d.png', event_id % 3) AS name, arg_max(event_type, event_id) AS status FROM (SELECT * REPLACE (user_id % 10 AS user_id), max(event_id) OVER (PARTITION BY user_id % 10) AS top FROM events) GROUP BY user_id, event_id % 3, top""".replace("CAST(max(event_id) AS INTEGER)", "CAST(top AS INTEGER)"))
def session_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions of a few folders, each in a file named by a hash of its folder, saved twice and read again."""
    folder = shared_path(spark, "sessions")
    key, name = (F.col("user_id") % 10).alias("k"), F.concat(F.col("event_id") % 3, F.lit(".png")).alias("name")
    rows = table(spark, sf_dir, "events").groupBy(key, name).agg(F.max_by("event_type", "event_id").alias("status"), F.max("event_id").cast("int").alias("last_index"))
    rows = rows.withColumn("source_folder", F.col("k").cast("string"))
    cut(exports.save_sessions(rows.withColumn("status", F.lit("x")), folder))
    cut(exports.save_sessions(rows, folder))
    return exports.sessions(spark, folder)


# --- datasets and copies ---


@query("SELECT p_partkey AS src, CAST(p_partkey * 2 AS INTEGER) AS \"index\", CASE WHEN p_partkey % 4 = 0 THEN 'val' ELSE 'train' END AS split FROM part")
def export_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "map")
    split = F.when(F.col("p_partkey") % 4 == 0, "val").otherwise("train")
    exports.write_export_map(table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("src"), (F.col("p_partkey") * 2).cast("int").alias("index"), split.alias("split")), path, 700)
    return files.export_map(spark, path).select(F.col("src").cast("long").alias("src"), "index", "split")


@query("SELECT CAST(p_size AS INTEGER) AS class, CAST(p_partkey AS DOUBLE) AS x0, CAST(p_size * 2 AS DOUBLE) AS y2, 3 AS n FROM part WHERE p_partkey % 5 <> 0")
def polygon_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label lines of polygons; every fifth is cut short, and some hold a word that is no number."""
    part = table(spark, sf_dir, "part")
    p = lambda c, k=1: (F.col(c) * k).cast("double").cast("string")
    good = F.concat_ws(" ", F.col("p_size").cast("string"), p("p_partkey"), F.lit("0.0"), F.when(F.col("p_partkey") % 3 == 0, F.lit("oops")), F.lit("1"), F.lit("2"), F.lit("3"), p("p_size", 2))
    path = shared_path(spark, "polygons")
    part.select(F.when(F.col("p_partkey") % 5 == 0, F.concat_ws(" ", "p_size", F.lit("1 2 3 4"))).otherwise(good).alias("value")).write.text(path)
    return files.polygons(spark, path).select("class", F.get("ring", F.lit(0))["x"].alias("x0"), F.get("ring", F.lit(2))["y"].alias("y2"), F.size("ring").alias("n"))


@query("SELECT 'leaf' || n_nationkey AS stem, CAST(n_regionkey AS INTEGER) AS class, 0.25 * (100 + n_nationkey) AS x1, 0.5 * (50 + n_nationkey * 2) AS y2, 4 AS n FROM nation WHERE n_nationkey % 5 <> 4")
def polygon_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label files of polygons in shares of their image, with the images' sizes as pixels; an image of unknown size has none."""
    nation = table(spark, sf_dir, "nation")
    root = shared_path(spark, "polygons")
    stem = F.concat(F.lit("leaf"), "n_nationkey")
    line = F.concat_ws(" ", F.col("n_regionkey").cast("string"), F.lit("0 0 0.25 0 0.25 0.5 0 0.5"))
    cut(exports.put_files(nation.select(F.concat(stem, F.lit(".txt")).alias("name"), F.encode(line, "UTF-8").alias("content")), root))
    sizes = nation.where("n_nationkey % 5 <> 4").select(stem.alias("stem"), (F.col("n_nationkey") + 100).alias("w"), (F.col("n_nationkey") * 2 + 50).alias("h"))
    found = files.polygons(spark, root, sizes)
    name = F.regexp_extract("path", r"([^/]*)\.txt$", 1)
    return found.select(name.alias("stem"), "class", F.get("ring", F.lit(1))["x"].alias("x1"), F.get("ring", F.lit(2))["y"].alias("y2"), F.size("ring").alias("n"))


@query("SELECT CAST(count(*) AS INTEGER) AS epoch, round(avg(value), 6) AS iou FROM events")
def epoch_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "events").agg(F.count("*").alias("n"), F.avg("value").alias("v")).first()
    path = shared_path(spark, "sidecar") + "/best.txt"
    exports.put_text(spark, path, f"epoch={r.n}\niou = {r.v!r}\nother=x\n".replace("iou = ", "iou="))
    return files.sidecar(spark, path).select("epoch", r6("iou").alias("iou"))


def _scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    ring = F.array(point(0, 0), point(50, 0), point(50, 40))
    one = F.struct(F.lit(0).alias("class"), ring.alias("ring"))
    return table(spark, sf_dir, "supplier").select(F.format_string("dir/s%04d.png", "s_suppkey").alias("src"), (F.col("s_suppkey") % 4 != 0).alias("reviewed"), F.lit(100).alias("w"), F.lit(80).alias("h"), F.encode(F.col("s_name"), "UTF-8").alias("content"), F.array_repeat(one, (F.col("s_suppkey") % 3).cast("int")).alias("instances"), "s_suppkey")


@query("""
WITH s AS (SELECT s_suppkey, printf('dir/s%04d.png', s_suppkey) AS src FROM supplier WHERE s_suppkey % 4 <> 0), r AS (SELECT src, s_suppkey + 5 AS i FROM s WHERE s_suppkey % 5 = 1)
SELECT s.src, CAST(coalesce(i, (SELECT max(i) FROM r) + row_number() OVER (PARTITION BY i IS NULL ORDER BY s.src)) AS BIGINT) AS "index", CAST(s_suppkey % 3 AS INTEGER) AS polygons, CASE WHEN s_suppkey % 5 = 1 THEN 'val' END AS recorded FROM s LEFT JOIN r USING (src)""")
def dataset_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset written and read again: its plan, and the polygons of each label file."""
    root = shared_path(spark, "dataset")
    scenes = _scenes(spark, sf_dir)
    recorded = scenes.where("s_suppkey % 4 <> 0 and s_suppkey % 5 = 1").select("src", (F.col("s_suppkey") + 5).alias("index"), F.lit("val").alias("split"))
    plan, _ = exports.export_dataset(scenes, recorded, root)
    lines = files.polygons(spark, f"{root}/labels/*/*.txt").groupBy(F.regexp_extract("path", r"(labels/.*)$", 1).alias("label")).agg(F.count("*").cast("int").alias("polygons"))
    known = recorded.select("src", F.col("split").alias("recorded"))
    return plan.join(lines, "label", "left").join(known, "src", "left").select("src", F.col("index").cast("long").alias("index"), F.coalesce("polygons", F.lit(0)).alias("polygons"), "recorded")


@query("SELECT count(*) FILTER (s_suppkey % 4 <> 0) AS exported, count(*) FILTER (s_suppkey % 4 = 0) AS skipped, CAST(0 AS BIGINT) AS failed FROM supplier")
def dataset_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = spark.createDataFrame([], "src string, index long, split string")
    return exports.export_dataset(_scenes(spark, sf_dir), empty, shared_path(spark, "dataset"))[1]


@query(f"SELECT CASE k % 2 WHEN 0 THEN 'even' ELSE 'odd' END || '/' || name AS name, CASE WHEN k % 2 = 0 THEN 'copied' ELSE 'moved' END AS by FROM ({_NAMED}) WHERE k % 4 <> 3")
def sorted_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures copied or moved into their category's folder, each at its place below the source."""
    root, named = _folder(spark, sf_dir)
    out = shared_path(spark, "sorted")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    source = "/" + root.split("file:", 1)[-1].lstrip("/") if root.startswith("file:") else root
    found = images.scan(spark, root).select(plain(F.col("path")).alias("path"))
    k = F.regexp_extract("path", r"i(\d+)\.[^.]*$", 1).cast("long")
    items = found.select("path", exports.destination(F.col("path"), source, F.when(k % 2 == 0, "even").otherwise("odd")).alias("target"), (k % 2 == 1).alias("odd"))
    items = cut(items)  # what lies in the folder before anything is moved
    done = exports.copy_files(items.where("not odd"), out).count() + exports.copy_files(items.where("odd"), out, move=True).count()
    left = images.scan(spark, root).select(F.lit(1)).count()
    by = F.when(F.startswith("name", F.lit("even/")), "copied").otherwise(F.when(F.lit(left + items.where("odd").count() == done), "moved").otherwise("kept"))
    return images.scan(spark, out).select(_below(out).alias("name")).withColumn("by", by)


# --- result tables ---

_LEAVES = "SELECT o_orderkey AS leaf, 'p/' || o_custkey % 50 || '.jpg' AS leaf_src, CAST(floor(o_totalprice / 100) AS BIGINT) AS leaf_px, CAST(o_orderkey % 90 AS BIGINT) AS recon_area, CAST(o_orderkey % 7 * 100 AS BIGINT) AS recon_whole, o_orderkey % 13 / 4.0 AS ec_length, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 100 END AS mc_area FROM orders"


def _leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    morphology = {c: F.lit(None).cast("double") for c in exports.MORPHOLOGY} | {"ec_length": k % 13 / 4.0, "mc_area": F.when(k % 5 != 0, k % 100)}
    return table(spark, sf_dir, "orders").select(k.alias("leaf"), F.concat(F.lit("p/"), F.col("o_custkey") % 50, F.lit(".jpg")).alias("leaf_src"), F.floor(F.col("o_totalprice") / 100).alias("leaf_px"), (k % 90).alias("recon_area"), (k % 7 * 100).alias("recon_whole"), *[v.alias(c) for c, v in morphology.items()])


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_orderkey").alias("leaf"), (F.col("l_partkey") * 8 + F.col("l_linenumber")).cast("long").alias("region"), (F.col("l_suppkey") % 6 - 1).cast("int").alias("cluster_id"), F.col("l_quantity").cast("long").alias("area_px"), *[F.lit(i).alias(f"bbox_{c}") for i, c in enumerate("xywh")])


_FOUND = "SELECT l_orderkey AS leaf, CAST(l_partkey * 8 + l_linenumber AS BIGINT) AS region, CAST(l_suppkey % 6 - 1 AS INTEGER) AS cluster_id, CAST(l_quantity AS BIGINT) AS area_px FROM lineitem"
_IDENTITY = f"SELECT *, regexp_extract(leaf_src, '([^/]*)\\.jpg$', 1) AS image, CAST(row_number() OVER (PARTITION BY leaf_src ORDER BY leaf) AS INTEGER) AS nth FROM ({_LEAVES})"


@query(f"""
WITH l AS ({_IDENTITY})
SELECT r.leaf, image, nth AS leaf_in_image, printf('%s_leaf%02d', image, nth - 1) AS leaf_file, region, r.cluster_id, coalesce(n_name, 'Cluster ' || r.cluster_id) AS family, area_px, round(area_px * 100.0 / greatest(leaf_px, 1), 5) AS pct_leaf,
  round(area_px * 100.0 / nullif(recon_whole, 0), 5) AS recon_pct, round(CASE WHEN recon_whole > 0 THEN recon_area * 100.0 / recon_whole END, 5) AS lost_tissue_pct, r.leaf || '_' || region || '.png' AS crop_file, round(ec_length, 4) AS ec_length, CAST(mc_area AS DOUBLE) AS mc_area, 31 AS n_columns
FROM ({_FOUND}) r JOIN l USING (leaf) LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 3) ON n_nationkey = r.cluster_id""")
def long_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").where("n_nationkey < 3").select(F.col("n_nationkey").alias("cluster_id"), F.col("n_name").alias("name"))
    out = exports.long_table(_regions(spark, sf_dir), _leaves(spark, sf_dir), names)
    n = len(out.columns)
    return out.select("leaf", "image", "leaf_in_image", "leaf_file", "region", "cluster_id", "family", "area_px", *[F.round(c, 5).alias(c) for c in ("pct_leaf", "recon_pct", "lost_tissue_pct")], "crop_file", F.round("ec_length", 4).alias("ec_length"), F.col("mc_area").cast("double").alias("mc_area"), F.lit(n).alias("n_columns"))


@query(f"""
WITH l AS ({_IDENTITY}), t AS (SELECT leaf, count(*) AS n, sum(area_px) AS a, count(*) FILTER (cluster_id = 0) AS n0, sum(area_px) FILTER (cluster_id = 0) AS a0, count(*) FILTER (cluster_id = 4) AS n4, sum(area_px) FILTER (cluster_id = 4) AS a4 FROM ({_FOUND}) WHERE cluster_id >= 0 GROUP BY leaf)
SELECT l.leaf, image, nth AS leaf_in_image, greatest(leaf_px, 1) AS leaf_area_px, coalesce(n, 0) AS n_anomalies, CAST(coalesce(a, 0) AS BIGINT) AS anomaly_area_px, round(coalesce(a, 0) * 100.0 / greatest(leaf_px, 1), 5) AS anomaly_pct_leaf, round(CASE WHEN recon_whole > 0 THEN recon_area * 100.0 / recon_whole END, 5) AS lost_tissue_pct,
  coalesce(n0, 0) AS f0_count, round(a0 / nullif(n0, 0), 5) AS f0_avg_area_px, coalesce(n4, 0) AS f4_count, round(coalesce(a4, 0) * 100.0 / greatest(leaf_px, 1), 5) AS f4_pct_leaf, 44 AS n_columns
FROM l LEFT JOIN t ON t.leaf = l.leaf WHERE l.leaf % 10 <> 0""")
def wide_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = _leaves(spark, sf_dir)
    out = exports.wide_table(_regions(spark, sf_dir), leaves, leaves.where("leaf % 10 = 0"), [(k, f"f{k}") for k in range(5)])
    n = len(out.columns)
    return out.select("leaf", "image", "leaf_in_image", "leaf_area_px", "n_anomalies", "anomaly_area_px", *[F.round(c, 5).alias(c) for c in ("anomaly_pct_leaf", "lost_tissue_pct")], "f0_count", F.round("f0_avg_area_px", 5).alias("f0_avg_area_px"), "f4_count", F.round("f4_pct_leaf", 5).alias("f4_pct_leaf"), F.lit(n).alias("n_columns"))


@query(f"SELECT 'tables,images-0,images-1' AS done, (SELECT count(*) FROM ({_LEAVES})) AS rows, (SELECT count(*) FROM supplier) AS images")
def export_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables are written before any image; both are read again."""
    root = shared_path(spark, "export")
    pictures = table(spark, sf_dir, "supplier").select(F.concat("s_suppkey", F.lit(".png")).alias("name"), F.encode(F.col("s_name"), "UTF-8").alias("content"))
    done = exports.export_run({"tables": lambda: sinks.write_csv(exports.morphology_table(_leaves(spark, sf_dir)), f"{root}/summary")}, pictures, exports.folder_writer(f"{root}/images"), slices=2)
    rows = spark.read.option("header", "true").csv(f"{root}/summary")
    return rows.agg(F.lit(",".join(done)).alias("done"), F.count("*").alias("rows")).join(images.count(images.scan(spark, f"{root}/images")).withColumnRenamed("n", "images"))


@query(f"SELECT regexp_extract(leaf_src, '([^/]*)$', 1) AS \"Filename\", printf('%.4f', ec_length) AS \"EC_Length\", CAST(mc_area AS VARCHAR) AS \"MC_Area\", 15 AS n_columns FROM ({_LEAVES})")
def morphology_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "morphology")
    out = exports.morphology_table(_leaves(spark, sf_dir).withColumn("mc_area", F.col("mc_area").cast("int")))
    sinks.write_csv(sinks.fixed(out, {"EC_Length": 4}), path)
    back = spark.read.option("header", "true").csv(path)
    return back.select("Filename", "EC_Length", "MC_Area", F.lit(len(back.columns)).alias("n_columns"))


@query("""
SELECT p_partkey || '.png' AS "Filename", CAST(greatest(p_size * 20 - floor(p_retailprice), 0) AS VARCHAR) AS "Damage_px", printf('%.2f', floor(greatest(p_size * 20 - floor(p_retailprice), 0) * 10000.0 / (p_size * 20) + 0.5) / 100) AS "Pct_Damage", 6 AS n_columns FROM part""".replace("CAST(greatest(p_size * 20 - floor(p_retailprice), 0) AS VARCHAR)", "CAST(CAST(greatest(p_size * 20 - floor(p_retailprice), 0) AS BIGINT) AS VARCHAR)"))
def reconstruction_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("d/"), "p_partkey", F.lit(".png")).alias("path"), F.floor("p_retailprice").alias("leaf"), (F.col("p_size") * 20).cast("long").alias("predicted"))
    path = shared_path(spark, "recon")
    sinks.write_csv(sinks.fixed(exports.reconstruction_table(rows, "path", "leaf", "predicted"), {"Pct_Damage": 2}), path)
    back = spark.read.option("header", "true").csv(path)
    return back.select("Filename", "Damage_px", "Pct_Damage", F.lit(len(back.columns)).alias("n_columns"))


@query("""
WITH v AS (SELECT *, CASE WHEN value < 20 THEN '<20' WHEN value < 40 THEN '20-40' ELSE '>=40' END AS bucket FROM events)
SELECT 'all' AS section, 'all' AS name, count(*) AS n FROM v UNION ALL SELECT 'type', event_type, count(*) FROM v GROUP BY 2 UNION ALL SELECT 'severity', bucket, count(*) FROM v GROUP BY 2""")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's overall, by-type and by-severity tables, written as Markdown and parsed again."""
    from verdure.operators import evaluation

    rows = table(spark, sf_dir, "events")
    kinds = [r.asDict() for r in evaluation.overall_and_by_type(rows, "event_type", "value").collect()]
    severe = [r.asDict() for r in evaluation.severity(rows.withColumn("d", F.col("value")), "d", "value").collect()]
    text = sinks.markdown("all", [k for k in kinds if k["type"] == "all"]) + sinks.markdown("type", [k for k in kinds if k["type"] != "all"]) + sinks.markdown("severity", severe)
    path = shared_path(spark, "report") + "/report.md"
    exports.put_text(spark, path, text)
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", "(?=## )")).alias("part")).where("part like '## %'")
    section = F.regexp_extract("part", r"^## (\w+)", 1)
    cells = lines.select(section.alias("section"), F.explode(F.split("part", "\n")).alias("line")).where("line like '| %' and line not like '| type %' and line not like '| bucket %'")
    cell = lambda k: F.trim(F.get(F.split("line", r"\|"), F.lit(k)))
    return cells.select("section", cell(1).alias("name"), cell(2).cast("long").alias("n"))


@query(f"""
{pixels.WITH}, s AS (SELECT leaf, v > 50 AS p, f < 2 AS t, v % 3 = 0 AS seen, v FROM px),
c AS (SELECT leaf, count(*) FILTER (p AND t) AS a, count(*) FILTER (p AND NOT t) AS b, count(*) FILTER (NOT p AND t) AS c, count(*) FILTER (NOT seen AND p AND t) AS za, count(*) FILTER (NOT seen AND p AND NOT t) AS zb,
  count(*) FILTER (NOT seen AND NOT p AND t) AS zc, count(*) FILTER (NOT seen AND NOT p AND NOT t) AS zd, 100.0 * count(*) FILTER (NOT seen AND t) / greatest(count(*) FILTER (t), 1) AS pct, avg(v) / 100 AS head FROM s GROUP BY leaf)
SELECT CASE leaf % 3 WHEN 0 THEN 'coastal' WHEN 1 THEN 'spots' ELSE 'lobe' END AS damage_type, round(pct, 3) AS damage_pct_actual, round(za / greatest(za + zb + zc, 1e-7), 4) AS zone_iou, round(2 * za / greatest(2 * za + zb + zc, 1e-7), 4) AS zone_dice,
  round(za / greatest(za + zb, 1e-7), 4) AS zone_precision, round(za / greatest(za + zc, 1e-7), 4) AS zone_recall, round((za + zd) / greatest(za + zb + zc + zd, 1e-7), 4) AS zone_pixel_acc,
  round(a / greatest(a + b + c, 1e-7), 4) AS whole_iou_t05, round(2 * a / greatest(2 * a + b + c, 1e-7), 4) AS whole_dice_t05, round(head, 4) AS head_area_pred FROM c""")
def validation_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The validation table of all samples, a leaf each, written as CSV by the tasks and read again."""
    from verdure.operators import evaluation

    px = pixels.pixels(spark, sf_dir).withColumn("prob", F.col("v") / 100)
    truth, seen = F.col("f") < 2, F.col("v") % 3 == 0
    about = [(F.lit(100.0) * F.count_if(~seen & truth) / F.greatest(F.count_if(truth), F.lit(1))).alias("damage_pct_actual"), (F.avg("v") / 100).alias("head_area_pred")]
    found = evaluation.sample_table(px, ["leaf"], "prob", truth, seen, about)
    kind = F.when(F.col("leaf") % 3 == 0, "coastal").when(F.col("leaf") % 3 == 1, "spots").otherwise("lobe")
    path = shared_path(spark, "validation")
    sinks.write_csv(exports.validation_table(found.withColumn("damage_type", kind)), path)
    back = spark.read.option("header", "true").csv(path)
    return back.select("damage_type", *[F.col(c).cast("double").alias(c) for c in back.columns[1:]])


# --- streams and failures ---


@query("SELECT l_returnflag AS label, count(*) AS n, sum(l_quantity) AS area FROM lineitem WHERE l_discount > 0.02 GROUP BY 1")
def stream_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions appended as they arrive, in bounded batches; the grouping runs over the whole table afterwards."""
    from verdure.streaming.state import append_regions, read_stream

    root = shared_path(spark, "stream")
    table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_discount").repartition(4).write.parquet(f"{root}/in")
    schema = spark.read.parquet(f"{root}/in").schema
    append_regions(read_stream(spark, f"{root}/in", schema, per_trigger=2), lambda df: df.where("l_discount > 0.02"), f"{root}/out", f"{root}/log").awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy(F.col("l_returnflag").alias("label")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("area"))


@query("SELECT event_id, n_name AS state FROM events LEFT JOIN nation ON n_nationkey = user_id % 40")
def stream_with_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known state applied to rows as they arrive: a join of a stream with a table."""
    from verdure.streaming.state import append_regions, read_stream, with_state

    root = shared_path(spark, "stream")
    schema = table(spark, sf_dir, "events").schema
    known = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("state"))
    rows = read_stream(spark, sf_dir, schema, glob="events.parquet").select("event_id", (F.col("user_id") % 40).alias("key"))
    append_regions(with_state(rows, known, ["key"]), lambda df: df.select("event_id", "state"), f"{root}/out", f"{root}/log").awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query("SELECT count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS s, count(*) FILTER (o_orderkey % 4 < 2) AS before, true AS cancelled, 4 AS batches FROM orders")
def stream_stopped_and_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over four files that is cancelled while its second batch is written leaves two of them; started again it does the rest, each once."""
    from verdure.streaming.state import BatchRun, read_stream

    root = shared_path(spark, "stream")
    rows = table(spark, sf_dir, "orders").select("o_orderkey")
    for k in range(4):  # files are taken in order of their time
        rows.where(F.col("o_orderkey") % 4 == k).coalesce(1).write.mode("append").parquet(f"{root}/in")
    start = lambda after=None: BatchRun(read_stream(spark, f"{root}/in", rows.schema, per_trigger=1), lambda df: df, f"{root}/out", f"{root}/log", after)
    run: list[BatchRun] = []
    begun = threading.Event()

    def after(number: int) -> None:
        if number == 1:
            begun.wait(60)
            run[0].cancel()

    run.append(start(after))
    begun.set()
    ended = run[0].wait()
    kept = lambda: spark.read.schema("o_orderkey long, batch int").parquet(f"{root}/out")
    before = kept().count()
    start().wait()
    return kept().agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("s"), F.lit(before).cast("long").alias("before"), F.lit(not ended).alias("cancelled"), F.count_distinct("batch").cast("int").alias("batches"))


@query("""
WITH c AS (SELECT *, client_id % 64 < 5 AND change_id % 2 = 1 AS late FROM client_changes WHERE client_id IS NOT NULL),
n AS (SELECT count(DISTINCT client_id % 64) FILTER (NOT late) AS first, count(DISTINCT client_id % 64) FILTER (late) AS second FROM c)
SELECT client_id, arg_max(change_id, (seq, change_id)) AS change_id, arg_max(coalesce(op, '-'), (seq, change_id)) AS op, any_value(first) AS first, any_value(second) AS second FROM c, n WHERE seq IS NOT NULL GROUP BY client_id""")
def stream_keyed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last change of each client, kept by a stream: its second batch rewrites the buckets of its own clients only."""
    from verdure.streaming.state import latest_generation, read_stream, upsert_state

    root = shared_path(spark, "stream")
    rows = table(spark, sf_dir, "client_changes").where("client_id is not null and change_id is not null").select("client_id", "seq", "change_id", F.coalesce("op", F.lit("-")).alias("op"))
    late = (F.col("client_id") % 64 < 5) & (F.col("change_id") % 2 == 1)
    commits: list = []
    for part in (~late, late):
        rows.where(part).coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = read_stream(spark, f"{root}/in", rows.schema, per_trigger=1)
        upsert_state(stream, f"{root}/state", f"{root}/log", ["client_id"], ["seq", "change_id"], F.col("client_id"), 64, commits).awaitTermination()
    found = latest_generation(spark, f"{root}/state").where("seq is not null")
    return found.select("client_id", "change_id", "op", *[F.lit(len(c.buckets)).cast("long").alias(n) for n, c in zip(("first", "second"), commits)])


@query("SELECT s_suppkey % 6 = 0 AS failed, count(*) AS n FROM supplier GROUP BY 1")
def failure_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A leaf that fails is a row with its error; the others are done."""

    def kernel(row: dict) -> list[dict]:
        if row["k"] % 6 == 0:
            raise ValueError("bad leaf")
        return [{"k": row["k"]}]

    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k"))
    out = map_leaves(rows, kernel, StructType.fromDDL("k long"))
    return out.groupBy(F.col("error").isNotNull().alias("failed")).agg(F.count("*").alias("n"))


@query("""
SELECT CASE n_nationkey % 4 WHEN 0 THEN 'ValueError: no header' WHEN 1 THEN 'ValueError: the body doesn''t match the header' WHEN 2 THEN 'not a base set' ELSE 'read' END AS said, count(*) AS n FROM nation GROUP BY 1""")
def failure_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What readers say of files made from the nations' rows: too short, cut, of another kind, or good; one bad file is one row and the others are read."""
    root = shared_path(spark, "bad")
    k = F.col("n_nationkey")
    word = lambda n: F.unhex(F.concat(F.lpad(F.hex(F.lit(n)), 2, "0"), F.lit("000000")))
    number = F.unhex(F.concat(F.lpad(F.hex(k), 2, "0"), F.lit("00803F")))
    content = F.when(k % 4 == 0, F.unhex(F.lit("010203"))).when(k % 4 == 1, F.concat(word(2), word(1), number)).otherwise(F.concat(word(1), word(1), number))
    name = F.concat(F.when(k % 4 == 2, "dump/").otherwise("bank/"), k.cast("string"), F.lit(".bin"))
    cut(exports.put_files(table(spark, sf_dir, "nation").select(name.alias("name"), content.alias("content")), root))
    said = files.bank(spark, f"{root}/bank").select("error").union(exports.base_set(spark, f"{root}/dump").select("error"))
    return said.groupBy(F.coalesce("error", F.lit("read")).alias("said")).agg(F.count("*").alias("n"))
