"""Filters, joins, aggregates, orderings and functions of the reference as queries, with SQL.

Roles as in ``verdure.plans.catalog``; the evaluation samples are the leaves of
``verdure.plans.pixels``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdure.functions import scalars, vectors
from verdure.kernels.apply import map_masks
from verdure.operators.ranking import numbered
from verdure.operators import cluster, evaluation, mining, neighbors, regions, sampling, state, stats
from verdure.plans import pixels
from verdure.plans.catalog import EXPLODED, REGION, points, query, r6, table

KEYS = ", ".join(REGION)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


# --- filters ---


@query(f"SELECT {KEYS} FROM lineitem WHERE l_returnflag = 'N' AND l_suppkey = 7 AND l_discount > 0.03")
def gallery_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).select(*REGION, F.col("l_returnflag").alias("label"), F.col("l_suppkey").alias("leaf"), (F.col("l_discount") > 0.03).alias("flagged"))
    return regions.gallery(rows, "N", 7, True).select(*REGION)


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND contains(lower(o_orderpriority || '.PNG'), 'high.p')")
def sorter_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("dir/"), "o_orderpriority", F.lit(".PNG"))
    return table(spark, sf_dir, "orders").where(scalars.name_matches(path, "HIGH.p", F.col("o_orderstatus"), "F")).select("o_orderkey")


@query(f"SELECT {KEYS}, l_discount FROM lineitem WHERE l_discount >= 0.06 ORDER BY l_discount DESC, {KEYS} LIMIT 300")
def top_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.confident(_lines(spark, sf_dir).select(*REGION, "l_discount"), "l_discount", 0.06)


@query("SELECT n_nationkey FROM nation WHERE lower(trim('  ' || n_name || ' ')) = 'nation_3'")
def class_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "nation").withColumn("n_name", F.concat(F.lit("  "), "n_name", F.lit(" ")))
    return state.class_named(named, "n_name", " Nation_3 ").select("n_nationkey")


@query("""
SELECT event_id, event_type IN ('error') OR props LIKE '%6%' AND event_type = 'click' AS reject, CASE WHEN lower(trim(event_type)) IN ('', 'healthy', 'reject', 'rejected', 'view') AND event_type <> 'view' THEN 'rejected' ELSE event_type END AS word,
  'tile' || event_id % 5 || CASE WHEN event_id % 3 = 0 THEN '_hardneg_' ELSE '_' END || '1.png' LIKE '%\\_hardneg\\_%' ESCAPE '\\' AS hard FROM events""")
def reject_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    source = F.when(F.col("event_type") == "error", "reject").otherwise("curated")
    family = F.when(F.col("props").contains("6") & (F.col("event_type") == "click"), "rejected").otherwise("x")
    crop = F.concat(F.lit("tile"), F.col("event_id") % 5, F.when(F.col("event_id") % 3 == 0, "_hardneg_").otherwise("_"), F.lit("1.png"))
    return e.select("event_id", state.is_reject(source, family).alias("reject"), state.reject_word(F.col("event_type")).alias("word"), mining.is_hard_negative(crop).alias("hard"))


@query("SELECT n, CASE n WHEN 0 THEN 'rejected' WHEN 1 THEN 'rejected' WHEN 2 THEN 'rejected' WHEN 3 THEN 'rejected' ELSE 'Rust' END AS word, count(*) AS c FROM (SELECT p_partkey % 5 AS n FROM part) GROUP BY n")
def reject_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.array(*map(F.lit, ("", " Healthy", "REJECT ", "rejected", "Rust")))
    n = F.col("p_partkey") % 5
    return table(spark, sf_dir, "part").select(n.alias("n"), state.reject_word(F.element_at(words, (n + 1).cast("int"))).alias("word")).groupBy("n", "word").agg(F.count("*").alias("c"))


@query(f"""
SELECT vec_id, round(CASE WHEN vec_id % 7 = 0 THEN 0 ELSE sum(x * (dim + 1)) END, 5) AS s, (SELECT count(*) FROM embeddings WHERE vec_id % 7 = 0) AS bad FROM ({EXPLODED}) GROUP BY vec_id""")
def finite_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    broken = F.when(F.col("vec_id") % 7 == 0, F.concat(F.slice(vectors.doubles(F.col("embedding")), 1, 63), F.array(F.when(F.col("vec_id") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))))).otherwise(vectors.doubles(F.col("embedding")))
    e = e.select("vec_id", broken.alias("v"))
    bad = e.agg(vectors.count_bad(F.col("v")).alias("bad"))
    ones = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: i.cast("double"))
    return e.select("vec_id", F.round(vectors.dot(vectors.zero_if_bad(F.col("v"), 64), ones), 5).alias("s")).join(F.broadcast(bad))


@query("SELECT p_partkey FROM part WHERE (p_size, p_brand) IN (SELECT (p_size, p_brand) FROM part GROUP BY p_size, p_brand HAVING count(*) >= 3)")
def populated_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/", "p_size", "p_brand").alias("class"))
    return sampling.drop_small_classes(part, "class").select("p_partkey")


@query("SELECT (SELECT count(DISTINCT quality) >= 2 AND count(quality) >= 15 FROM labels) AS enough, (SELECT count(DISTINCT n_name) >= 2 AND count(*) >= 15 FROM nation WHERE n_nationkey < 3) AS few")
def enough_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = sampling.enough(table(spark, sf_dir, "labels"), "quality"), sampling.enough(table(spark, sf_dir, "nation").where("n_nationkey < 3"), "n_name")
    return spark.createDataFrame([(a, b)], "enough boolean, few boolean")


def _placed(rows: DataFrame, columns: list[str], order: list[Column]) -> DataFrame:
    """The rows' places, from 1, in an order of all of them; by ranges, in no single task."""
    return numbered(rows, [], order, "place").select(*columns, (F.col("place") + 1).alias("place"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size > 25 DESC, p_retailprice DESC, p_partkey) AS place FROM part")
def palette_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [*scalars.palette_rank(F.col("p_size") > 25, F.col("p_retailprice")), F.col("p_partkey")]
    return _placed(table(spark, sf_dir, "part"), ["p_partkey"], order)


# --- joins ---


@query(f"""
{pixels.WITH}, r AS (SELECT leaf * 10 AS region, leaf, x, y FROM px UNION ALL SELECT leaf * 10 + 1 + f, leaf, x, y FROM px), b AS (SELECT region, (max(x) - min(x) + 1) * (max(y) - min(y) + 1) AS box FROM r GROUP BY region),
p AS (SELECT c_custkey AS point, CAST(c_custkey % 50 + 1 AS INTEGER) AS leaf, CAST(c_custkey * 13 % {pixels.W} AS INTEGER) AS x, CAST(c_custkey * 7 % {pixels.H} AS INTEGER) AS y FROM customer)
SELECT point, arg_min(region, (box, region)) AS region FROM p JOIN r USING (leaf, x, y) JOIN b USING (region) GROUP BY point""")
def point_in_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels.pixels(spark, sf_dir)
    every = px.select((F.col("leaf") * 10).alias("region"), "leaf", "x", "y").union(px.select(F.col("leaf") * 10 + 1 + F.col("f"), "leaf", "x", "y"))
    k = F.col("c_custkey")
    points_ = table(spark, sf_dir, "customer").select(k.alias("point"), (k % 50 + 1).cast("int").alias("leaf"), (k * 13 % pixels.W).cast("int").alias("x"), (k * 7 % pixels.H).cast("int").alias("y"))
    return regions.smallest_mask_hit(points_, every, "point", "region", ["leaf", "x", "y"])


@query("SELECT l_orderkey, sum(l_quantity * o_totalprice) AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1 HAVING count(*) >= 2")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists that share an index are joined by it, never by the order of rows."""
    both = _lines(spark, sf_dir).join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.groupBy("l_orderkey").agg(F.sum(F.col("l_quantity") * F.col("o_totalprice")).alias("s"), F.count("*").alias("n")).where("n >= 2").select("l_orderkey", "s")


@query("""
WITH r AS (SELECT p_partkey AS src, p_partkey * 2 AS idx FROM part WHERE p_partkey % 3 = 0)
SELECT p_partkey AS src, CAST(coalesce(idx, (SELECT max(idx) FROM r) + row_number() OVER (PARTITION BY idx IS NULL ORDER BY p_partkey)) AS BIGINT) AS "index" FROM part LEFT JOIN r ON src = p_partkey""")
def dataset_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdure.sources.sinks import dataset_index as f

    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"))
    return f(part, part.where("src % 3 = 0").select("src", (F.col("src") * 2).alias("index"))).select("src", F.col("index").cast("long"))


@query("""
SELECT o_orderkey, event_type AS status, 'log' AS by FROM orders LEFT JOIN (SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id) ON user_id = o_orderkey
UNION ALL SELECT o_orderkey, CASE WHEN s_suppkey IS NOT NULL THEN 'done' END, 'session' FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey""")
def fallback_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("path"), F.col("o_custkey").alias("name"))
    log = state.last_write_wins(table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.col("event_type").alias("status"), "event_id"), ["path"], ["event_id"]).drop("event_id")
    session = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("name"), F.lit("done").alias("status"))
    one = lambda log, by: mining.fallback_status(items, log, session, "path", "name").select("o_orderkey", "status", F.lit(by).alias("by"))
    return one(log, "log").union(one(log.limit(0), "session"))


@query("SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10) GROUP BY 1")
def base_rows_of_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rows whose class is in the head, of the listed crops alone: two semi-joins."""
    head = table(spark, sf_dir, "supplier").where("s_nationkey < 5").select(F.col("s_suppkey").alias("l_suppkey"))
    crops = table(spark, sf_dir, "part").where("p_size < 10").select(F.col("p_partkey").alias("l_partkey"))
    return _lines(spark, sf_dir).join(head, "l_suppkey", "left_semi").join(crops, "l_partkey", "left_semi").groupBy("l_partkey").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey) AS place FROM part WHERE p_partkey NOT IN (SELECT vec_id FROM embeddings WHERE vec_id % 2 = 0)")
def rank_not_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where("vec_id % 2 = 0").select(F.col("vec_id").alias("p_partkey"), F.col("embedding").alias("v"))
    rows = table(spark, sf_dir, "part").join(e, "p_partkey", "left")
    order = [F.desc("p_size"), F.col("p_partkey")]
    return _placed(regions.to_embed(rows, "v"), ["p_partkey"], order)


@query(f"""
WITH p AS (SELECT * FROM lineitem WHERE l_tax >= 0.06 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {KEYS}) <= 10), q AS (SELECT * FROM p ORDER BY {KEYS} LIMIT 2000)
SELECT {KEYS}, 'rejected' AS family, 'mined' AS source, 'leaf' || l_orderkey || '_hardneg_' || l_partkey % 40 * 16 || '_' || l_suppkey % 30 * 16 || '.png' AS crop, 'leaf' || l_orderkey || '_hardneg_' || l_partkey % 40 * 16 || '_' || l_suppkey % 30 * 16 || '_mask.png' AS mask, l_partkey % 40 * 16 + 256 AS x1, l_suppkey % 30 * 16 + 256 AS y1 FROM q""")
def mined_label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mining.hard_negatives(_lines(spark, sf_dir).select(*REGION, "l_tax"), "l_tax", 0.06, "l_orderkey", REGION)
    image = F.concat(F.lit("d/leaf"), "l_orderkey", F.lit(".jpg"))
    return mining.mined_rows(found, image, F.col("l_partkey") % 40 * 16, F.col("l_suppkey") % 30 * 16, 256).select(*REGION, "family", "source", "crop", "mask", "x1", "y1")


@query(f"{pixels.WITH} SELECT p.leaf, p.x, p.y FROM (SELECT DISTINCT leaf, x + 1 AS x, y FROM px WHERE f = 0) p WHERE NOT EXISTS (SELECT 1 FROM px q WHERE q.leaf = p.leaf AND q.x = p.x AND q.y = p.y AND q.f <> 0)")
def paint_stroke(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels.pixels(spark, sf_dir)
    stroke = px.where("f = 0").select("leaf", (F.col("x") + 1).alias("x"), "y")
    return mining.paint(stroke, px.where("f <> 0"), ["leaf", "x", "y"])


def _families(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    head = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("class"), F.col("n_name").alias("name"))
    labels = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("crop"), F.concat(F.lit("NATION_"), "s_nationkey").alias("family"))
    return head, labels


@query("""
SELECT 'merged' AS op, f AS family, count(*) AS n FROM (SELECT CASE WHEN s_nationkey = 3 THEN 'NATION_4' ELSE 'NATION_' || s_nationkey END AS f FROM supplier) GROUP BY f
UNION ALL SELECT 'unknown', 'NATION_' || s_nationkey, count(*) FROM supplier GROUP BY s_nationkey UNION ALL SELECT 'deleted', 'NATION_' || s_nationkey, count(*) FROM supplier WHERE s_nationkey <> 5 GROUP BY s_nationkey
UNION ALL SELECT op, '', n FROM (VALUES ('merged', (SELECT count(*) - 1 FROM nation)), ('unknown', (SELECT count(*) FROM nation)), ('deleted', (SELECT count(*) - 1 FROM nation))) t(op, n)""")
def merge_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    head, labels = _families(spark, sf_dir)
    out = None
    for op, (h, rows) in {"merged": state.merge_family(head, labels, "NATION_3", "NATION_4"), "unknown": state.merge_family(head, labels, "NATION_3", "none"), "deleted": state.delete_class(head, labels, "NATION_5")}.items():
        n = rows.groupBy("family").agg(F.count("*").alias("n")).union(h.agg(F.lit("").alias("family"), F.count("*").alias("n"))).select(F.lit(op).alias("op"), "family", "n")
        out = n if out is None else out.union(n)
    return out


@query("SELECT n_nationkey AS class, n_name AS name FROM nation WHERE n_name <> 'NATION_2'")
def merge_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.merge_class(_families(spark, sf_dir)[0], "NATION_2", "NATION_1")


# --- aggregates ---


@query("""
WITH r AS (SELECT l_orderkey AS leaf, CAST(l_suppkey % 7 - 1 AS INTEGER) AS label, l_quantity AS area FROM lineitem), t AS (SELECT leaf, count(*) FILTER (label <> -1) AS n, sum(area) FILTER (label <> -1) AS a, count(*) FILTER (label = 0) AS n0, sum(area) FILTER (label = 0) AS a0 FROM r GROUP BY leaf)
SELECT o_orderkey AS leaf, coalesce(n, 0) AS total_n, coalesce(a, 0.0) AS total_area, coalesce(n0, 0) AS zero_n, coalesce(a0, 0.0) AS zero_area FROM orders LEFT JOIN t ON leaf = o_orderkey""")
def totals_without_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("leaf"), (F.col("l_suppkey") % 7 - 1).cast("int").alias("label"), F.col("l_quantity").alias("area"))
    leaves = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("leaf"), F.lit(1).alias("leaf_px"))
    return regions.wide_export(found, leaves, [(0, "zero")], noise=-1).select("leaf", "total_n", "total_area", "zero_n", "zero_area")


@query("""
WITH l AS (SELECT floor(o_totalprice) AS px, floor(o_totalprice / 2) AS whole FROM orders WHERE o_orderkey = 5)
SELECT l_returnflag AS label, sum(l_quantity) AS total, sum(l_quantity) FILTER (l_orderkey = 5) AS here, count(DISTINCT l_orderkey) AS leaves, round(coalesce(sum(l_quantity) FILTER (l_orderkey = 5), 0) * 100 / max(px), 6) AS leaf_pct,
  round(coalesce(sum(l_quantity) FILTER (l_orderkey = 5), 0) * 100 / max(whole), 6) AS recon_pct FROM lineitem, l GROUP BY 1""")
def cluster_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("leaf"), F.col("l_returnflag").alias("label"), F.col("l_quantity").alias("area"))
    leaves = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("leaf"), F.floor("o_totalprice").alias("leaf_px"), F.floor(F.col("o_totalprice") / 2).alias("recon_whole"))
    return regions.cluster_table(found, leaves, 5).withColumn("leaf_pct", r6("leaf_pct")).withColumn("recon_pct", r6("recon_pct"))


@query("""
SELECT CASE WHEN o_orderstatus = 'O' THEN 'unsorted' ELSE o_orderstatus END AS category, count(*) AS n FROM orders GROUP BY 1
UNION ALL SELECT 'flagged', 0 UNION ALL SELECT 'skipped', 0 UNION ALL SELECT 'total', count(*) FROM orders""")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.category_counts(table(spark, sf_dir, "orders"), "o_orderstatus", "O", ("flagged", "skipped"))


@query("SELECT p_type AS family, count(*) AS n FROM part GROUP BY 1")
def family_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.family_histogram(table(spark, sf_dir, "part"), "p_type")


@query("SELECT count(DISTINCT l_suppkey % 9 - 2) FILTER (l_suppkey % 9 >= 2) AS n FROM lineitem")
def distinct_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.distinct_clusters(_lines(spark, sf_dir).select((F.col("l_suppkey") % 9 - 2).alias("label")), "label")


@query(f"""
WITH p AS (SELECT vec_id, dim, x FROM ({EXPLODED}))
SELECT CAST(a.dim AS INTEGER) AS i, CAST(b.dim AS INTEGER) AS j, round(covar_pop(a.x, b.x), 7) AS cov FROM p a JOIN p b ON a.vec_id = b.vec_id AND a.dim <= b.dim GROUP BY 1, 2""")
def covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.covariance(table(spark, sf_dir, "embeddings"), "embedding").withColumn("cov", F.round("cov", 7))


@query("""
WITH RECURSIVE c AS (SELECT p_size % 4 AS class, count(*) AS n FROM part WHERE p_size % 4 <> 1 OR p_partkey % 40 = 0 GROUP BY 1),
w AS (SELECT q FROM (SELECT unnest(range(1, 1 + (SELECT max(n) FROM c))) AS q) WHERE (SELECT sum(least(n, q)) FROM c) <= 100 ORDER BY q DESC LIMIT 1),
quota AS (SELECT class, n, least(n, q) + CASE WHEN n > q AND row_number() OVER (PARTITION BY n > q ORDER BY class) <= 100 - (SELECT sum(least(n, q)) FROM c, w) THEN 1 ELSE 0 END AS want FROM c, w),
r AS (SELECT p_partkey, class, n, want, row_number() OVER (PARTITION BY class ORDER BY p_partkey) - 1 AS i FROM part JOIN quota ON class = p_size % 4 WHERE p_size % 4 <> 1 OR p_partkey % 40 = 0)
SELECT p_partkey, class FROM r WHERE i % greatest(1, n // want) = 0 AND i // greatest(1, n // want) < want""")
def base_set_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 4).alias("class")).where("class <> 1 or p_partkey % 40 = 0")
    return sampling.by_quota(rows, "class", ["p_partkey"], 100)


@query("SELECT round(avg(abs(l_extendedprice - l_quantity * 1000)), 4) AS mae, round(sqrt(avg((l_extendedprice - l_quantity * 1000) ** 2)), 4) AS rmse FROM lineitem WHERE l_quantity > 0")
def area_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir).withColumn("truth", F.col("l_quantity") * 1000)
    return evaluation.area_report(rows, "l_extendedprice", "truth").select(F.round("mae", 4).alias("mae"), F.round("rmse", 4).alias("rmse"))


@query("SELECT count(*) AS done, true AS ahead, (SELECT count(*) FROM lineitem) - count(*) AS left FROM orders")
def run_pace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pace of a stream over a table, by its own progress, against all rows that it is to do."""
    from verdure.session import shared_path
    from verdure.streaming.state import append_regions, pace, read_stream

    root, rows = shared_path(spark, "pace"), table(spark, sf_dir, "orders").select("o_orderkey")
    rows.repartition(3).write.parquet(f"{root}/in")
    run = append_regions(read_stream(spark, f"{root}/in", rows.schema, per_trigger=1), lambda df: df, f"{root}/out", f"{root}/log")
    run.awaitTermination()
    total = table(spark, sf_dir, "lineitem").count()
    p = pace([{"numInputRows": r["numInputRows"], "durationMs": r["durationMs"]} for r in run.recentProgress], total)
    # What is left at this pace, in rows again: the pace itself differs from run to run.
    return spark.createDataFrame([(p["done"], p["per_minute"] > 0, round(p["minutes_left"] * p["per_minute"]))], "done long, ahead boolean, left long")


#: The evaluation samples: one leaf and threshold is one image of the SQL.
_TAU = "WITH RECURSIVE " + pixels.PX.replace("SELECT leaf, x, y, max(v) AS v, min(f) AS f FROM (", "SELECT leaf * 100 + t AS leaf, x, y, v, f, t FROM (SELECT leaf, x, y, max(v) AS v, min(f) AS f FROM (", 1).replace("GROUP BY leaf, x, y),", "GROUP BY leaf, x, y), (SELECT unnest(range(31)) AS t)),", 1)
_COUNTS = f"""{_TAU}, s AS (SELECT * FROM px WHERE (v + 0.5) / 100.0 > 0.2 + 0.02 * t OR f = 0),{pixels.comp('k', 's', True)},
kept AS (SELECT k.leaf, k.x, k.y FROM k JOIN (SELECT DISTINCT leaf, c FROM k JOIN px USING (leaf, x, y) WHERE f = 0) USING (leaf, c)),{pixels.outside('o', 'kept')},
sil AS (SELECT g.leaf, g.x, g.y FROM grid g LEFT JOIN o ON o.leaf = g.leaf AND o.x = g.x AND o.y = g.y WHERE o.leaf IS NULL),
j AS (SELECT coalesce(px.leaf, sil.leaf) AS leaf, px.leaf IS NOT NULL AND px.f <> 2 AS g, px.leaf IS NOT NULL AND coalesce(px.f = 0, false) AS seen, sil.leaf IS NOT NULL AS p FROM px FULL JOIN sil ON px.leaf = sil.leaf AND px.x = sil.x AND px.y = sil.y),
n AS (SELECT leaf, leaf % 100 AS k, count(*) FILTER (g) AS whole, count(*) FILTER (g AND NOT seen) AS lost, count(*) FILTER (p) AS found, count(*) FILTER (p AND NOT seen) AS added, count(*) FILTER (p AND g) AS both_, count(*) FILTER (p OR g) AS either_, count(*) FILTER (seen) AS seen FROM j GROUP BY leaf)"""
_REPORT = """
d AS (SELECT *, coalesce(added / nullif(found, 0), 0) - lost / whole AS d, greatest(0, least(1, (greatest(40.0, 1) - seen) / greatest(40.0, 1))) AS head FROM n WHERE whole > 0),
r AS (SELECT CAST(k AS INTEGER) AS k, 0.2 + 0.02 * k AS tau, count(*) AS n, avg(abs(d)) AS lost_mae, avg(d) AS lost_bias, avg(abs(found - whole) / whole) AS whole_mape, avg(both_ / greatest(either_, 1)) AS iou, avg(2 * both_ / greatest(whole + found, 1)) AS dice, avg(abs(head - lost / whole)) AS head_mae FROM d GROUP BY k)"""
_FIELDS = ("tau", "lost_mae", "lost_bias", "whole_mape", "iou", "dice", "head_mae")
_SHOWN = "k, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in _FIELDS)


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels.pixels(spark, sf_dir)
    samples = px.select("leaf", "x", "y", ((F.col("v") + 0.5) / 100).alias("prob"), (F.col("f") == 0).cast("int").alias("visible"), (F.col("f") != 2).cast("int").alias("truth"))
    counts = map_masks(samples, lambda mask, c: evaluation.silhouette_counts(mask, c), evaluation.SILHOUETTE, pixels.H, pixels.W)
    return evaluation.silhouette_report(counts, F.lit(40.0))


def _shown(reports: DataFrame) -> DataFrame:
    return reports.select("k", "n", *[r6(c).alias(c) for c in _FIELDS])


@query(f"{_COUNTS},{_REPORT} SELECT {_SHOWN} FROM r")
def silhouette_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_reports(spark, sf_dir))


@query(f"{_COUNTS},{_REPORT} SELECT {_SHOWN} FROM r QUALIFY row_number() OVER (ORDER BY round(abs(lost_bias), 12), k) = 1")
def best_silhouette_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(evaluation.best_report(_reports(spark, sf_dir)))


@query("SELECT 'all' AS type, count(*) AS n, round(avg(value), 6) AS mean FROM events UNION ALL SELECT event_type, count(*), round(avg(value), 6) FROM events GROUP BY 1")
def overall_and_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.overall_and_by_type(table(spark, sf_dir, "events"), "event_type", "value").withColumn("mean", r6("mean"))


# --- orderings, samples, sets ---


@query(f"""
WITH m AS (SELECT l_returnflag, list_sort(list(l_quantity))[len(list(l_quantity)) // 2 + 1] AS m FROM lineitem GROUP BY 1),
s AS (SELECT {KEYS}, greatest(0, greatest(l_quantity / greatest(m, 1), greatest(m, 1) / greatest(l_quantity, 1)) - 1) AS score FROM lineitem JOIN m USING (l_returnflag))
SELECT {KEYS}, row_number() OVER (ORDER BY score DESC, {KEYS}) AS place FROM s""")
def least_typical_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _lines(spark, sf_dir)
    m = stats.upper_median(rows, ["l_returnflag"], "l_quantity")
    scored = rows.join(F.broadcast(m), "l_returnflag").select(*REGION, stats.area_atypicality(F.col("l_quantity"), F.col("upper_median")).alias("score"))
    return _placed(scored, REGION, regions.least_typical(scored, "score", REGION))


@query("""
WITH s AS (SELECT * FROM events ORDER BY md5(CAST(event_id AS VARCHAR)), event_id LIMIT 1500)
SELECT round(count(*) FILTER (value > 60) / count(*), 8) AS before, round(count(*) FILTER (value > 40) / count(*), 8) AS after,
  CASE WHEN 100.0 * (count(*) FILTER (value > 40) / count(*) - count(*) FILTER (value > 60) / count(*)) > 0.5 THEN 'worse' WHEN 100.0 * (count(*) FILTER (value > 40) / count(*) - count(*) FILTER (value > 60) / count(*)) < -0.5 THEN 'better' ELSE 'same' END AS verdict FROM s""")
def rate_before_and_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fixed sample, judged by the old head and by the new one."""
    from verdure.operators.head import false_positive_change

    sample = sampling.reservoir(table(spark, sf_dir, "events"), F.md5(F.col("event_id").cast("string")), 1500)
    rate = lambda t: F.count_if(F.col("value") > t) / F.count("*")
    both = sample.agg(rate(60).alias("before"), rate(40).alias("after"))
    return both.select(F.round("before", 8).alias("before"), F.round("after", 8).alias("after"), false_positive_change(F.col("before"), F.col("after")).alias("verdict"))


@query("SELECT user_id, CAST(row_number() OVER (ORDER BY last DESC) - 1 AS INTEGER) AS place FROM (SELECT user_id, max(event_id) AS last FROM events GROUP BY 1 ORDER BY last DESC LIMIT 10)")
def recent_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.recent(table(spark, sf_dir, "events"), "user_id", "event_id")


@query("SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR))) <= ceil(0.9 * (SELECT count(*) FROM orders)) THEN 'train' ELSE 'val' END AS part FROM orders")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.hash_split(table(spark, sf_dir, "orders").select("o_orderkey"), F.md5(F.col("o_orderkey").cast("string")))


@query(f"{pixels.WITH} SELECT 'or' AS op, count(*) AS n FROM (SELECT leaf, x, y FROM px WHERE f = 0 UNION SELECT leaf, x, y FROM px WHERE v > 50) UNION ALL SELECT 'and', count(*) FROM px WHERE f = 0 AND v > 50 UNION ALL SELECT 'andnot', count(*) FROM px WHERE f = 0 AND v <= 50")
def mask_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels.pixels(spark, sf_dir)
    a, b = px.where("f = 0").select("leaf", "x", "y"), px.where("v > 50").select("leaf", "x", "y")
    n = lambda df, op: df.agg(F.lit(op).alias("op"), F.count("*").alias("n"))
    return n(a.union(b).distinct(), "or").union(n(a.intersect(b), "and")).union(n(a.exceptAll(b), "andnot"))


@query("""
SELECT p_brand AS component, min(p_partkey) AS survivor, min(p_partkey % 60) AS x, min(p_size) AS y, max(p_partkey % 60 + 3) - min(p_partkey % 60) AS w, CAST(max(p_size + 2) - min(p_size) AS INTEGER) AS h, count(*) * 6 AS area, count(*) AS parts FROM part GROUP BY 1""")
def merge_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = table(spark, sf_dir, "part").select(F.col("p_brand").alias("component"), F.col("p_partkey").alias("region"), (F.col("p_partkey") % 60).alias("x"), F.col("p_size").alias("y"), F.lit(3).alias("w"), F.lit(2).alias("h"), F.lit(6).alias("area"))
    return regions.merge_groups(members, "component", "region")


@query(f"""
{pixels.WITH}, m AS (SELECT leaf AS region, x, y FROM px WHERE v < 60 UNION ALL SELECT leaf + 100, x, y FROM px WHERE v >= 40),
g AS (SELECT DISTINCT region, region % 100 // 3 AS component FROM m WHERE region % 100 > 10), l AS (SELECT component, min(region) AS survivor FROM g GROUP BY component)
SELECT DISTINCT coalesce(survivor, region) AS survivor, x, y FROM m LEFT JOIN g USING (region) LEFT JOIN l USING (component)""")
def merge_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = pixels.pixels(spark, sf_dir)
    m = px.where("v < 60").select(F.col("leaf").alias("region"), "x", "y").union(px.where("v >= 40").select(F.col("leaf") + 100, "x", "y"))
    groups = m.select("region").distinct().where("region % 100 > 10").withColumn("component", F.floor(F.col("region") % 100 / 3))
    return regions.merge_masks(m, groups)


@query("SELECT src, count(*) AS n, CAST(sum(k) AS BIGINT) AS s FROM (SELECT 'curation' AS src, s_suppkey AS k FROM supplier UNION ALL SELECT 'base', p_partkey FROM part) GROUP BY src")
def curation_and_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "supplier").select(F.lit("curation").alias("src"), F.col("s_suppkey").alias("k"))
    b = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.lit("base").alias("src"))
    return a.unionByName(b).groupBy("src").agg(F.count("*").alias("n"), F.sum("k").alias("s"))


@query("SELECT p_partkey FROM part WHERE p_size % 3 = 1 AND (p_partkey * 37) % 300 < 180 AND (p_partkey * 37) % 300 + p_size % 13 + 5 > 60 AND CAST(floor(p_retailprice) AS BIGINT) % 400 < 220 AND CAST(floor(p_retailprice) AS BIGINT) % 400 + p_size > 100")
def select_in_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rectangle's selection within one cluster."""
    from verdure.plans.catalog import _boxes

    chosen = regions.rect_overlap(_boxes(spark, sf_dir), F.lit(100), F.lit(60), F.lit(220), F.lit(180)).select(F.col("region").alias("p_partkey"))
    return table(spark, sf_dir, "part").where("p_size % 3 = 1").join(chosen, "p_partkey", "left_semi").select("p_partkey")


# --- vectors, features, heads ---


@query(f"""
WITH n AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM ({EXPLODED}) GROUP BY 1)
SELECT e.vec_id, round(sum(x / greatest(n, 1e-8) * (dim + 1)), 5) AS unit, round(sum(x * sqrt(2) / n * (dim + 1)), 5) AS root2, round(sum(x * (dim % 5 - 2)) + 0.25, 5) AS logit, round(1 / (1 + exp(-(sum(x * (dim % 5 - 2)) + 0.25))), 6) AS share FROM ({EXPLODED}) e JOIN n USING (vec_id) GROUP BY e.vec_id""")
def vector_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, ones, w = F.col("embedding"), F.lit([float(d + 1) for d in range(64)]), F.lit([float(d % 5 - 2) for d in range(64)])
    z = vectors.logit(v, w, F.lit(0.25))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.dot(vectors.normalize(v), ones), 5).alias("unit"), F.round(vectors.dot(vectors.rescale(v), ones), 5).alias("root2"), F.round(z, 5).alias("logit"), r6(vectors.sigmoid(z)).alias("share"))


@query(f"SELECT vec_id, round(sum(x * x * (dim + 1)), 4) AS score FROM ({EXPLODED}) GROUP BY vec_id")
def model_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pluggable network's place, taken by a fixed function."""
    from verdure.kernels.apply import predict

    def model():
        import numpy as np

        return lambda batch: ((np.asarray(batch, float) ** 2) * np.arange(1, 65)).sum(axis=1)

    e = table(spark, sf_dir, "embeddings").select("vec_id", vectors.doubles(F.col("embedding")).alias("v"))
    return e.select("vec_id", F.round(predict(model, "v", T.DoubleType(), input_tensor_shapes=[[64]]), 4).alias("score"))


@query(f"""
WITH m AS (SELECT dim, avg(x) AS m FROM ({EXPLODED}) GROUP BY dim), t AS (SELECT sum(v) AS t FROM (SELECT var_pop(x) AS v FROM ({EXPLODED}) GROUP BY dim))
SELECT vec_id, round(sum((x - m) ** 2), 5) AS norm2, round(max(t), 5) AS total FROM ({EXPLODED}) JOIN m USING (dim), t GROUP BY vec_id""")
def pca_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on all principal components: its distance to the mean and the sum of variances stay the same."""
    e = table(spark, sf_dir, "embeddings")
    values, directions, mean = stats.principal(e, "embedding", 64)
    out = stats.project(e.select("vec_id", "embedding"), "embedding", directions, mean)
    return out.select("vec_id", F.round(vectors.dot(F.col("projected"), F.col("projected")), 5).alias("norm2"), F.lit(round(sum(values), 5)).alias("total"))


_K5 = "SELECT a AS point_id, round(d, 6) AS d FROM (SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM (SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a, embeddings b) WHERE a <> b) WHERE r = 5"


@query(_K5)
def kth_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbors.kth_distance(points(spark, sf_dir), 5).withColumn("d", r6("d"))


@query(f"""
WITH d AS (SELECT p_partkey, i, CASE i WHEN 0 THEN CAST(p_size AS DOUBLE) ELSE p_retailprice END AS x FROM part, (SELECT unnest([0, 1]) AS i)), s AS (SELECT i, avg(x) AS m, greatest(stddev_pop(x), 1e-6) AS sd FROM d GROUP BY i),
e AS (SELECT vec_id, dim + 2 AS i, x FROM ({EXPLODED}))
SELECT p_partkey, CAST(i AS INTEGER) AS i, round(y, 5) AS y FROM (SELECT p_partkey, i, (x - m) / sd * 0.5 AS y FROM d JOIN s USING (i) UNION ALL SELECT p_partkey, i, x FROM part JOIN e ON vec_id = p_partkey)""")
def hybrid_descriptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("p_partkey"), "embedding")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.array(F.col("p_size").cast("double"), "p_retailprice").alias("d")).join(e, "p_partkey", "left")
    out = mining.hybrid_descriptor(rows, "p_partkey", "d", "embedding", 0.5)
    return out.select("p_partkey", F.posexplode("v").alias("i", "y")).withColumn("y", F.round("y", 5))


@query("SELECT event_id FROM events WHERE event_type <> 'error' ORDER BY md5(event_id || '/' || user_id) LIMIT 400")
def bank_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.fit_bank(table(spark, sf_dir, "events"), F.md5(F.concat_ws("/", "event_id", "user_id")), F.col("event_type") != "error", 400).select("event_id")


# --- merges of a hierarchy, by a fixed list ---

#: Point j = n - 1 - step is absorbed by (7 j + 3) mod j, at heights that grow.
_MERGES = "n AS (SELECT count(*) AS n FROM part), g AS (SELECT CAST(n - 1 - p_partkey AS INTEGER) AS step, CAST((p_partkey * 7 + 3) % p_partkey AS INTEGER) AS i, CAST(p_partkey AS INTEGER) AS j, (n - 1 - p_partkey) + ((n - 1 - p_partkey) * 37 % 11) / 16.0 AS dist FROM part, n WHERE p_partkey > 0)"
_ROOTS = "up(point, node) AS (SELECT node, node FROM tree UNION ALL SELECT point, t.parent FROM up JOIN tree t ON t.node = up.node WHERE t.parent <> t.node), root AS (SELECT point, node AS cluster FROM up JOIN tree USING (node) WHERE parent = node)"
_LABEL = "size AS (SELECT cluster, min(point) AS first, count(*) AS n FROM lead_ GROUP BY 1), rank_ AS (SELECT cluster, n, row_number() OVER (ORDER BY first) - 1 AS label FROM size)"


def _fixed_merges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    part = table(spark, sf_dir, "part")
    n = part.count()
    step, j = F.lit(n - 1) - F.col("p_partkey"), F.col("p_partkey")
    return part.where("p_partkey > 0").select(step.cast("int").alias("step"), ((j * 7 + 3) % j).cast("int").alias("i"), j.cast("int").alias("j"), (step + (step * 37 % 11) / 16.0).alias("dist")), n


def _cut_sql(k: int, least: int) -> str:
    return f"""
WITH RECURSIVE {_MERGES}, tree AS (SELECT CAST(p_partkey AS INTEGER) AS node, coalesce(i, CAST(p_partkey AS INTEGER)) AS parent FROM part LEFT JOIN (SELECT g.* FROM g, n WHERE step < n - {k}) ON j = p_partkey), {_ROOTS}, lead_ AS (SELECT * FROM root), {_LABEL}
SELECT point, CAST(CASE WHEN n >= {least} THEN label ELSE -1 END AS INTEGER) AS label FROM root JOIN rank_ USING (cluster)"""


@query(_cut_sql(8, 3))
def fixed_cut_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    merges, n = _fixed_merges(spark, sf_dir)
    return cluster.cut_k(merges, n, 8, 3).select("point", F.col("label").cast("int"))


@query(f"SELECT 20 AS k, point, label FROM ({_cut_sql(20, 1)}) UNION ALL SELECT 5, point, label FROM ({_cut_sql(5, 2)})")
def fixed_recut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same merges, kept in a table, cut at other numbers without being made again."""
    from verdure.session import cut

    merges, n = _fixed_merges(spark, sf_dir)
    kept = cut(merges)
    one = lambda k, least: cluster.cut_k(kept, n, k, least).select(F.lit(k).alias("k"), "point", F.col("label").cast("int"))
    return one(20, 1).union(one(5, 2))


@query(f"""
WITH {_MERGES}, d AS (SELECT step, lead(dist) OVER (ORDER BY step) - dist AS gap FROM g)
SELECT CAST(row_number() OVER (ORDER BY gap DESC, step) AS INTEGER) AS place, gap, CAST((SELECT n FROM n) - step - 1 AS INTEGER) AS k FROM d WHERE gap IS NOT NULL ORDER BY gap DESC, step LIMIT 4""")
def fixed_suggest_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    merges, n = _fixed_merges(spark, sf_dir)
    return cluster.suggest_k(merges, n).withColumn("k", F.col("k").cast("int"))


@query(f"""
WITH RECURSIVE {_MERGES},
l AS (SELECT a.step, max(b.step) AS s FROM g a LEFT JOIN g b ON b.i = a.i AND b.step < a.step GROUP BY a.step), r AS (SELECT a.step, max(b.step) AS s FROM g a LEFT JOIN g b ON b.i = a.j AND b.step < a.step GROUP BY a.step),
node AS (SELECT CAST(n + step AS INTEGER) AS id, dist AS height, CAST(coalesce(n + l.s, i) AS INTEGER) AS lft, CAST(coalesce(n + r.s, j) AS INTEGER) AS rgt FROM g JOIN l USING (step) JOIN r USING (step), n),
kid AS (SELECT id, lft AS child FROM node UNION ALL SELECT id, rgt FROM node), one AS (SELECT k.id, k.child, h.height FROM kid k JOIN node h ON h.id = k.child),
two AS (SELECT id, height FROM one UNION ALL SELECT o.id, x.height FROM one o JOIN kid k ON k.id = o.child JOIN node x ON x.id = k.child), st AS (SELECT id, avg(height) AS m, stddev_pop(height) AS sd FROM two GROUP BY id),
split AS (SELECT node.id FROM node JOIN st USING (id) WHERE sd > 1e-6 AND (height - m) / sd > 1.8),
tree AS (SELECT CAST(p_partkey AS INTEGER) AS node, coalesce(CASE WHEN s.id IS NULL THEN k.id ELSE CAST(p_partkey AS INTEGER) END, CAST(p_partkey AS INTEGER)) AS parent FROM part LEFT JOIN kid k ON k.child = p_partkey LEFT JOIN split s ON s.id = k.id
  UNION ALL SELECT d.id, coalesce(CASE WHEN s.id IS NULL THEN k.id ELSE d.id END, d.id) FROM node d LEFT JOIN kid k ON k.child = d.id LEFT JOIN split s ON s.id = k.id), {_ROOTS}, lead_ AS (SELECT * FROM root, n WHERE point < n), {_LABEL}
SELECT point, CAST(label AS INTEGER) AS label FROM lead_ JOIN rank_ USING (cluster)""")
def fixed_adaptive_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    merges, n = _fixed_merges(spark, sf_dir)
    return cluster.adaptive_cut(merges, n, 1.8).select("point", F.col("label").cast("int"))


# --- functions ---


@query("""
SELECT p_partkey, replace(replace(p_name || '\\"x', '\\', '\\\\'), '"', '\\"') AS escaped, greatest(5, least(20, p_size)) AS clamped, greatest(p_size - 30, 0) AS minus,
  CAST(greatest(floor(p_size * 0.75 + 0.5), 1) AS INTEGER) AS w75, CAST(greatest(floor((p_size % 13 + 5) * (100.0 / greatest(p_size, p_size % 13 + 5)) + 0.5), 1) AS INTEGER) AS h100,
  printf('%.2f', p_size / 4.0) AS fixed, format('{:,}', p_partkey * 12345) AS grouped,
  CASE WHEN p_partkey * 7 < 60 THEN p_partkey * 7 || 's' WHEN p_partkey * 7 < 3600 THEN printf('%dm %02ds', p_partkey * 7 // 60, p_partkey * 7 % 60) ELSE printf('%dh %02dm', p_partkey * 7 // 3600, p_partkey * 7 % 3600 // 60) END AS took FROM part""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    w, _ = scalars.resized(size, size % 13 + 5, percent=75)
    _, h = scalars.resized(size, size % 13 + 5, longest=100)
    return table(spark, sf_dir, "part").select(
        "p_partkey", scalars.json_escape(F.concat("p_name", F.lit('\\"x'))).alias("escaped"), scalars.clamp(size, F.lit(5), F.lit(20)).alias("clamped"), scalars.saturating_minus(size, F.lit(30)).alias("minus"),
        w.alias("w75"), h.alias("h100"), scalars.fixed(size / 4.0, 2).alias("fixed"), scalars.grouped(key * 12345).alias("grouped"), scalars.duration(key * 7).alias("took"),
    )


@query("""
SELECT p_partkey, round(p_partkey % s + ((h & 65535) / 65535.0 - 0.5) * 0.7, 6) AS x, round(floor(p_partkey / s) + ((h >> 16) / 65535.0 - 0.5) * 0.7, 6) AS y
FROM (SELECT p_partkey, (p_partkey * 2654435761) % 4294967296 AS h, (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) FROM part) AS s FROM part)""")
def scatter_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey")
    x, y = scalars.scatter(F.col("p_partkey"), F.lit(part.count()))
    return part.select("p_partkey", r6(x).alias("x"), r6(y).alias("y"))


def _path(*xy: tuple[float, float]) -> Column:
    return F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in xy])


_LINE = [(0.0, 0.0), (6.0, 1.0), (9.0, 7.0), (3.0, 4.5)]
_SEGMENTS = "SELECT c_custkey, closing, min(sqrt((x - ax - t * (bx - ax)) ** 2 + (y - ay - t * (bys - ay)) ** 2)) AS d FROM (SELECT *, greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * (bys - ay)) / ((bx - ax) ** 2 + (bys - ay) ** 2))) AS t FROM (SELECT c_custkey, c_custkey % 130 / 10.0 AS x, c_custkey % 97 / 10.0 AS y FROM customer), (SELECT unnest([0.0, 6.0, 9.0, 3.0]) AS ax, unnest([0.0, 1.0, 7.0, 4.5]) AS ay, unnest([6.0, 9.0, 3.0, 0.0]) AS bx, unnest([1.0, 7.0, 4.5, 0.0]) AS bys, unnest([false, false, false, true]) AS closing)) GROUP BY 1, 2"


@query(f"WITH s AS ({_SEGMENTS}) SELECT c_custkey, round(min(d) FILTER (NOT closing), 6) AS line, round(min(d), 6) AS ring FROM s GROUP BY 1")
def line_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 130 / 10.0).alias("x"), (F.col("c_custkey") % 97 / 10.0).alias("y"))
    line = _path(*_LINE)
    return p.select("c_custkey", r6(scalars.polyline_distance(line, F.col("x"), F.col("y"))).alias("line"), r6(scalars.polyline_distance(line, F.col("x"), F.col("y"), closed=True)).alias("ring"))


@query("SELECT p_partkey, CAST(p_size * (p_size % 13 + 5) AS DOUBLE) / 2 AS area, round(p_size + (p_size % 13 + 5) + sqrt(p_size ** 2 + (p_size % 13 + 5) ** 2), 6) AS perimeter FROM part")
def ring_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h, zero = F.col("p_size").cast("double"), (F.col("p_size") % 13 + 5).cast("double"), F.lit(0.0)
    ring = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((zero, zero), (w, zero), (w, h))])
    return table(spark, sf_dir, "part").select("p_partkey", scalars.shoelace(ring).alias("area"), r6(scalars.perimeter(ring)).alias("perimeter"))


@query("""
WITH m AS (SELECT p_brand, median(p_size) AS ma, median(p_retailprice) AS mb FROM part GROUP BY 1)
SELECT p_partkey, round(CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE sqrt((p_size - ma) ** 2 + (p_retailprice - mb) ** 2) END, 5) AS d FROM part JOIN m USING (p_brand)""")
def chroma_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    both = part.join(stats.counted_median(part, ["p_brand"], "p_size", "ma"), "p_brand").join(stats.counted_median(part, ["p_brand"], "p_retailprice", "mb"), "p_brand")
    return both.select("p_partkey", F.round(scalars.chroma_distance(F.col("p_size"), F.col("p_retailprice"), F.col("ma"), F.col("mb"), F.col("p_partkey") % 5 != 0), 5).alias("d"))


@query("""
WITH RECURSIVE t AS (SELECT p_partkey, lower(p_name) AS t, strlen(p_name) AS n FROM part),
w(p_partkey, i, k, last, score) AS (SELECT p_partkey, 0, 0, -2, 0 FROM t
  UNION ALL SELECT w.p_partkey, i + 1, k + hit, CASE WHEN hit = 1 THEN i + 1 ELSE last END, score + CASE WHEN hit = 1 THEN 1 + CASE WHEN last = i THEN 4 ELSE 0 END + CASE WHEN i = 0 OR t[i] IN (' ', '.') THEN 3 ELSE 0 END ELSE 0 END
  FROM (SELECT w.*, t.t, CASE WHEN k < 2 AND t.t[i + 1] = 'ae'[k + 1] THEN 1 ELSE 0 END AS hit FROM w JOIN t USING (p_partkey) WHERE i < length(t.t)) w)
SELECT t.p_partkey, CASE WHEN k = 2 THEN CAST(score * 100 - n AS DOUBLE) END AS score FROM t JOIN w ON w.p_partkey = t.p_partkey AND w.i = length(t.t)""")
def fuzzy_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", scalars.fuzzy_score(F.col("p_name"), F.lit("ae")).cast("double").alias("score"))


@query(f"""
{pixels.WITH}, {pixels.ALL}, p AS (SELECT leaf, x, y, v / 100.0 AS p FROM alln)
SELECT a.leaf, round(avg(abs(a.p - r.p)), 6) AS tv_x, round(avg(abs(a.p - d.p)), 6) AS tv_y FROM p a LEFT JOIN p r ON r.leaf = a.leaf AND r.y = a.y AND r.x = a.x + 1 LEFT JOIN p d ON d.leaf = a.leaf AND d.x = a.x AND d.y = a.y + 1 GROUP BY a.leaf""")
def total_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdure.kernels import raster

    out = map_masks(pixels.pixels(spark, sf_dir), lambda mask, c: dict(zip(("tv_x", "tv_y"), ([x] for x in raster.total_variation(c["v"] / 100)))), "tv_x double, tv_y double", pixels.H, pixels.W)
    return out.withColumn("tv_x", r6("tv_x")).withColumn("tv_y", r6("tv_y"))


@query("""
SELECT l_suppkey AS sample, round(avg(greatest(CASE WHEN l_tax > 0.04 THEN 1 ELSE 0 END - l_discount * 8, 0)) FILTER (l_tax > 0.04), 6) AS no_delete, round(avg(CASE WHEN l_linenumber <= 2 THEN 1 - greatest(0, least(1, l_discount * 8)) END), 6) AS hole FROM lineitem GROUP BY 1""")
def deletion_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("l_discount") * 8
    return _lines(spark, sf_dir).groupBy(F.col("l_suppkey").alias("sample")).agg(r6(scalars.no_delete_loss(p, F.col("l_tax") > 0.04)).alias("no_delete"), r6(scalars.hole_loss(p, F.col("l_linenumber") <= 2)).alias("hole"))
