"""The reference operators as queries over whole tables, with their SQL.

Roles: lineitem holds regions (id: order, line, part and supplier keys; leaf: order;
family: return flag; area: quantity), orders holds leaves, embeddings holds vectors,
events is the append-only log, part gives boxes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdure.functions import scalars
from verdure.functions.vectors import distance, dot, norm
from verdure.operators import cluster, evaluation, geometry, head, neighbors, regions, sampling, state, stats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FAMILIES = [("A", "A"), ("N", "N"), ("R", "R")]
REGION = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x):
    return F.round(x, 6)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("v"), "label")


# --- exports and visibility ---


@query("""
WITH f AS (SELECT l_orderkey, l_returnflag AS fam, count(*) AS n, sum(l_quantity) AS area FROM lineitem GROUP BY ALL)
SELECT o_orderkey AS leaf, o_custkey AS src, CAST(greatest(floor(o_totalprice), 1) AS BIGINT) AS leaf_px,
  CAST(coalesce(sum(n), 0) AS BIGINT) AS total_n, coalesce(sum(area), 0) AS total_area,
""" + ",".join(f"""
  CAST(coalesce(sum(n) FILTER (fam = '{k}'), 0) AS BIGINT) AS "{k}_n", coalesce(sum(area) FILTER (fam = '{k}'), 0) AS "{k}_area",
  round(sum(area) FILTER (fam = '{k}') / sum(n) FILTER (fam = '{k}'), 6) AS "{k}_mean",
  round(coalesce(sum(area) FILTER (fam = '{k}'), 0) * 100.0 / greatest(floor(o_totalprice), 1), 6) AS "{k}_pct\"""" for k, _ in FAMILIES) + """
FROM orders LEFT JOIN f ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_totalprice""")  # fmt: skip
def wide_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("leaf"), F.col("o_custkey").alias("src"), F.greatest(F.floor("o_totalprice"), F.lit(1)).cast("long").alias("leaf_px"))
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("leaf"), F.col("l_returnflag").alias("label"), F.col("l_quantity").alias("area"))
    out = regions.wide_export(found, leaves, FAMILIES)
    return out.select(*[r6(F.col(c)).alias(c) if c.endswith(("_mean", "_pct")) else F.col(c) for c in out.columns])


@query("""
SELECT l_orderkey AS leaf, o_custkey AS src, l_linenumber AS region, CAST(l_suppkey % 7 - 1 AS INTEGER) AS label,
  CASE WHEN l_suppkey % 7 - 1 < 0 THEN 'noise' WHEN n_name IS NOT NULL THEN n_name ELSE 'Cluster ' || CAST(l_suppkey % 7 - 1 AS INTEGER) END AS family,
  l_quantity AS area, round(l_quantity * 100.0 / greatest(coalesce(floor(o_totalprice), 1), 1), 6) AS leaf_pct,
  round(CASE WHEN o_totalprice <> 0 THEN 0.5 * o_totalprice * 100.0 / o_totalprice END, 6) AS lost_pct
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 4) ON n_nationkey = l_suppkey % 7 - 1""")
def long_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("leaf"), F.col("l_linenumber").alias("region"), (F.col("l_suppkey") % 7 - 1).cast("int").alias("label"), F.col("l_quantity").alias("area"))
    leaves = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("leaf"), F.col("o_custkey").alias("src"), F.floor("o_totalprice").alias("leaf_px"), (F.col("o_totalprice") * 0.5).alias("recon_area"), F.col("o_totalprice").alias("recon_whole"))
    names = table(spark, sf_dir, "nation").where("n_nationkey < 4").select(F.col("n_nationkey").alias("label"), F.col("n_name").alias("name"))
    return regions.long_export(found, leaves, names).withColumn("leaf_pct", r6("leaf_pct")).withColumn("lost_pct", r6("lost_pct"))


@query("SELECT o_orderkey AS leaf, o_custkey AS src, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS ordinal FROM orders")
def leaf_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.leaf_ordinal(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("leaf"), F.col("o_custkey").alias("src")), "src", "leaf")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size >= 45)
  AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'P')""")
def visible_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    hidden = table(spark, sf_dir, "part").where("p_size >= 45").select(F.col("p_partkey").alias("l_partkey"))
    rejected = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return regions.visible(table(spark, sf_dir, "lineitem"), hidden, ["l_partkey"], rejected, "l_orderkey").select(*REGION, "l_quantity")


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS unsorted, count(*) FILTER (o_orderstatus <> 'O') AS done FROM orders")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.status_counts(table(spark, sf_dir, "orders"), "o_orderstatus", "O")


@query("""
SELECT label, n AS count, CAST(row_number() OVER (ORDER BY label < 0, n DESC, label) AS INTEGER) AS place
FROM (SELECT CAST(l_suppkey % 7 - 1 AS INTEGER) AS label, count(*) AS n FROM lineitem GROUP BY 1)""")
def cluster_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.cluster_order(table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 7 - 1).cast("int").alias("label")), "label")


@query("""
SELECT l_returnflag AS label, sum(l_quantity) AS total, sum(l_quantity) FILTER (l_orderkey = 1) AS here, count(DISTINCT l_orderkey) AS leaves
FROM lineitem GROUP BY 1""")
def cluster_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("leaf"), F.col("l_returnflag").alias("label"), F.col("l_quantity").alias("area"))
    leaves = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("leaf"), F.lit(1).alias("leaf_px"), F.lit(0).alias("recon_whole"))
    return regions.cluster_table(found, leaves, 1).select("label", "total", "here", "leaves")


@query("""
SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey IN
  (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(l_linestatus = 'F'))""")
def fully_reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = table(spark, sf_dir, "orders")
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linestatus")
    return regions.fully_reviewed(leaves, found, leaves.where("o_orderstatus = 'P'").select("o_orderkey"), "o_orderkey", F.col("l_linestatus") == "F").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey < 700, o_orderkey LIMIT 1")
def unreviewed_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.next_unreviewed(table(spark, sf_dir, "orders"), "o_orderkey", F.col("o_orderstatus") == "O", 700).select("o_orderkey")


BOX = "SELECT p_partkey AS region, CAST(floor(p_retailprice) AS BIGINT) % 400 AS x, (p_partkey * 37) % 300 AS y, p_size AS w, p_size % 13 + 5 AS h FROM part"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("region"), (F.floor("p_retailprice") % 400).alias("x"), (F.col("p_partkey") * 37 % 300).alias("y"), F.col("p_size").alias("w"), (F.col("p_size") % 13 + 5).alias("h"))


@query(f"SELECT region FROM ({BOX}) WHERE x < 220 AND x + w > 100 AND y < 180 AND y + h > 60")
def rect_overlap_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.rect_overlap(_boxes(spark, sf_dir), F.lit(100), F.lit(60), F.lit(220), F.lit(180)).select("region")


@query(f"""
WITH hit AS (SELECT c_custkey AS point, region, CAST(w AS BIGINT) * h AS a FROM customer JOIN ({BOX})
  ON (c_custkey * 13) % 400 >= x AND (c_custkey * 13) % 400 < x + w AND (c_custkey * 7) % 300 >= y AND (c_custkey * 7) % 300 < y + h)
SELECT point, region FROM hit QUALIFY row_number() OVER (PARTITION BY point ORDER BY a, region) = 1""")
def point_in_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("point"), (F.col("c_custkey") * 13 % 400).alias("px"), (F.col("c_custkey") * 7 % 300).alias("py"))
    return regions.smallest_hit(p, _boxes(spark, sf_dir), "point", "region", 32)


@query("""
SELECT l_returnflag AS label, l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CAST(floor((row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1) / 60) AS BIGINT) AS page FROM lineitem""")
def gallery_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("label"), *REGION, "l_quantity")
    return regions.page_of(rows, ["label"], [F.desc("l_quantity"), *map(F.col, REGION)]).drop("l_quantity")


# --- logs and names ---


@query("""
SELECT user_id, event_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def last_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return state.last_write_wins(log, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type", "value")


def _stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdure.session import shared_path
    from verdure.streaming.state import latest_generation, read_stream, upsert_state

    schema = table(spark, sf_dir, "events").schema
    out = shared_path(spark, "stream")
    stream = read_stream(spark, sf_dir, schema, glob="events.parquet").select("user_id", "ts", "event_id", "event_type", "value")
    upsert_state(stream, f"{out}/state", f"{out}/log", ["user_id"], ["ts", "event_id"]).awaitTermination()
    return latest_generation(spark, f"{out}/state").select("user_id", "event_id", "event_type", "value")


def stream_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stream_latest(spark, sf_dir)


QUERIES["stream_latest_state"] = stream_latest_state
ORACLE_SQL["stream_latest_state"] = ORACLE_SQL["last_write_wins"]


@query("""
WITH leaf AS (SELECT o_orderkey AS leaf, o_custkey AS src, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS n, o_orderkey % 50 AS w, o_orderkey % 40 AS h FROM orders),
mark AS (SELECT user_id AS src, 0 AS n, arg_max(event_type, (ts, event_id)) AS state, arg_max(event_id % 3 * (event_id % 50), (ts, event_id)) AS w, arg_max(event_id % 40, (ts, event_id)) AS h FROM events GROUP BY user_id)
SELECT leaf, CASE WHEN NOT bad THEN state END AS state, bad AS mismatch FROM (
  SELECT leaf, state, coalesce(m.w <> 0 AND m.h <> 0 AND (m.w <> l.w OR m.h <> l.h), false) AS bad FROM leaf l LEFT JOIN mark m ON m.src = l.src AND m.n = l.n)""")
def review_join_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaf = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("leaf"), F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 50).alias("w"), (F.col("o_orderkey") % 40).alias("h"))
    leaf = regions.leaf_ordinal(leaf, "src", "leaf").withColumnRenamed("ordinal", "n")
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("src"), F.lit(0).alias("n"), F.col("event_type").alias("state"), (F.col("event_id") % 3 * (F.col("event_id") % 50)).alias("w"), (F.col("event_id") % 40).alias("h"), "ts", "event_id")
    marks = state.last_write_wins(log, ["src", "n"], ["ts", "event_id"])
    return state.join_marks(leaf, marks, ["src", "n"]).select("leaf", "state", "mismatch")


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN label < 0 THEN 'noise' ELSE coalesce(r_name, n_name, 'Cluster ' || label) END AS name FROM
(SELECT *, CAST(l_suppkey % 40 - 1 AS INTEGER) AS label FROM lineitem) LEFT JOIN region ON r_regionkey = label LEFT JOIN nation ON n_nationkey = label""")
def name_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(*REGION, (F.col("l_suppkey") % 40 - 1).cast("int").alias("label"))
    runtime = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("label"), F.col("r_name").alias("name"))
    known = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("label"), F.col("n_name").alias("name"))
    return state.name_chain(rows, runtime, known).drop("label")


@query("""
WITH seen AS (SELECT lower(trim(p_brand)) AS key, min(p_partkey) AS first FROM part GROUP BY 1),
head AS (SELECT lower(trim(p_brand)) AS key, CAST(min(p_size) AS BIGINT) AS class FROM part GROUP BY 1 HAVING min(p_partkey) % 2 = 0)
SELECT key, coalesce(class, (SELECT coalesce(max(class), 0) FROM head) + row_number() OVER (PARTITION BY class IS NULL ORDER BY first, key)) AS class
FROM seen LEFT JOIN head USING (key)""")
def name_to_class_new_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    known = part.groupBy(F.col("p_brand").alias("name")).agg(F.min("p_size").cast("long").alias("class"), F.min("p_partkey").alias("first")).where("first % 2 = 0").drop("first")
    return state.class_ids(part, known, "p_brand", "p_partkey")


@query("SELECT DISTINCT p_type AS name, CASE WHEN trim(regexp_replace(p_type, '[^A-Za-z0-9]+', '_', 'g'), '_') = '' THEN 'family' ELSE trim(regexp_replace(p_type, '[^A-Za-z0-9]+', '_', 'g'), '_') END AS slug FROM part")
def header_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("name")).distinct().select("name", scalars.slug(F.col("name")).alias("slug"))


@query(r"""
SELECT page_id, regexp_extract(replace(url, '\', '/'), '([^/]*)$', 1) AS file,
  regexp_replace(regexp_extract(replace(url, '\', '/'), '([^/]*)$', 1), '(.)\.[^.]*$', '\1') AS stem,
  lower(regexp_extract(regexp_extract(replace(url, '\', '/'), '([^/]*)$', 1), '.\.([^.]+)$', 1)) AS ext FROM pages""")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", scalars.file_name(u).alias("file"), scalars.stem(u).alias("stem"), scalars.extension(u).alias("ext"))


# --- robust statistics ---

MAD = """
med AS (SELECT event_type, median(value) AS med FROM events WHERE value IS NOT NULL GROUP BY 1),
mad AS (SELECT event_type, med, median(med - value) AS mad FROM events JOIN med USING (event_type) WHERE value <= med GROUP BY ALL),
scale AS (SELECT *, greatest(1.4826 * mad, 0.5) + 1e-6 AS scale FROM mad)"""


@query(f"WITH {MAD} SELECT event_type, round(med, 6) AS med, round(mad, 6) AS mad, round(scale, 6) AS scale FROM scale")
def robust_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.robust_scale(table(spark, sf_dir, "events"), ["event_type"], "value", 0.5).select("event_type", *[r6(c).alias(c) for c in ("med", "mad", "scale")])


@query(f"WITH {MAD} SELECT event_id, round(CASE WHEN value IS NULL THEN 0 ELSE (value - med) / scale END, 6) AS z FROM events JOIN scale USING (event_type)")
def robust_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.robust_z(table(spark, sf_dir, "events"), ["event_type"], "value", 0.5).select("event_id", r6("z").alias("z"))


@query("""
SELECT event_type, value AS pct FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
WHERE r = CAST(round(0.25 * (n - 1)) AS BIGINT) + 1""")
def nearest_rank_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.nearest_rank(table(spark, sf_dir, "events"), ["event_type"], "value", 25.0)


@query("""
WITH m AS (SELECT l_returnflag, list_sort(list(l_quantity))[len(list(l_quantity)) // 2 + 1] AS m FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(greatest(0, greatest(l_quantity / greatest(m, 1), greatest(m, 1) / greatest(l_quantity, 1)) - 1), 6) AS score
FROM lineitem JOIN m USING (l_returnflag)""")
def upper_median_atypicality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    m = stats.upper_median(rows, ["l_returnflag"], "l_quantity")
    # Flags are few; dealt by them, a task would hold half of all rows.
    return rows.join(F.broadcast(m), "l_returnflag").select(*REGION, r6(stats.area_atypicality(F.col("l_quantity"), F.col("upper_median"))).alias("score"))


EXPLODED = "SELECT vec_id, label, unnest(range(64)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings"


@query(f"""
WITH p AS ({EXPLODED}), s AS (SELECT dim, avg(x) AS m, greatest(stddev_pop(x), 1e-6) AS sd FROM p GROUP BY 1)
SELECT vec_id, CAST(dim AS INTEGER) AS dim, round((x - m) / sd, 5) AS value FROM p JOIN s USING (dim)""")
def standardize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.standardize(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").select("vec_id", "dim", F.round("value", 5).alias("value"))


@query(f"WITH p AS ({EXPLODED}) SELECT round(greatest(sqrt(sum(v) / 8), 1e-3), 6) AS weight FROM (SELECT var_pop(x) AS v FROM p GROUP BY dim)")
def variance_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.variance_weight(table(spark, sf_dir, "embeddings"), "embedding").select(r6("weight").alias("weight"))


@query("""
WITH g AS (SELECT l_returnflag, count(*) AS n, var_pop(l_linenumber) AS xx, var_pop(l_quantity) AS yy, covar_pop(l_linenumber, l_quantity) AS xy,
  (max(l_linenumber) - min(l_linenumber) + 1) * (max(l_quantity) - min(l_quantity) + 1) AS box FROM lineitem GROUP BY 1),
e AS (SELECT *, (xx + yy) / 2 AS half, sqrt(((xx - yy) / 2) ** 2 + xy ** 2) AS root FROM g)
SELECT l_returnflag, round(CASE WHEN n < 2 THEN 1 ELSE least(sqrt((half + root) / greatest(half - root, 1e-6)), 20) END, 6) AS elongation,
  round(CASE WHEN n < 2 THEN 1 ELSE n / box END, 6) AS extent FROM e""")
def elongation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.elongation(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linenumber", "l_quantity").select("l_returnflag", r6("elongation").alias("elongation"), r6("extent").alias("extent"))


@query("SELECT p_size AS cx, CAST(floor(p_retailprice / 100) AS BIGINT) AS cy, 2 * count(*) FILTER (p_partkey % 3 = 0) >= count(*) AS majority, bool_and(p_partkey % 3 = 0) AS whole, count(*) AS n FROM part GROUP BY 1, 2")
def grid_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "part").select(F.col("p_size").alias("cx"), F.floor(F.col("p_retailprice") / 100).alias("cy"), "p_partkey")
    return stats.majority_cells(cells, ["cx", "cy"], F.col("p_partkey") % 3 == 0)


@query("""
WITH ring AS (SELECT o_custkey AS k, i, max(v) AS v, bool_or(ok) AS ok FROM
  (SELECT o_custkey, unnest(range(16)) AS i, NULL::DOUBLE AS v, false AS ok FROM (SELECT DISTINCT o_custkey FROM orders)
   UNION ALL SELECT o_custkey, o_orderkey % 16, round(o_totalprice), true FROM orders) GROUP BY 1, 2),
three AS (SELECT k, i, v, ok, t, i + 16 * t AS p FROM ring, (SELECT unnest([-1, 0, 1]) AS t)),
f AS (SELECT *, last_value(CASE WHEN ok THEN p END IGNORE NULLS) OVER a AS lp, last_value(CASE WHEN ok THEN v END IGNORE NULLS) OVER a AS lv,
  first_value(CASE WHEN ok THEN p END IGNORE NULLS) OVER b AS rp, first_value(CASE WHEN ok THEN v END IGNORE NULLS) OVER b AS rv FROM three
  WINDOW a AS (PARTITION BY k ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY k ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT k, CAST(i AS BIGINT) AS i, round(CASE WHEN ok THEN v ELSE coalesce(lv + (rv - lv) * CASE WHEN rp = lp THEN 0 ELSE (p - lp) / (rp - lp) END, 0) END, 6) AS r FROM f WHERE t = 0""")
def ring_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    rays = orders.select(F.col("o_custkey").alias("k")).distinct().select("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias("i"))
    seen = orders.groupBy(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 16).alias("i")).agg(F.max(F.round("o_totalprice")).alias("v"))
    ring = rays.join(seen, ["k", "i"], "left").withColumn("ok", F.col("v").isNotNull())
    return stats.ring_interpolation(ring, ["k"], "i", "v", "ok", 16).select("k", "i", r6("r").alias("r"))


# --- vectors and clusters ---

PAIRS = "SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a, embeddings b"


@query(f"""
SELECT a AS q_id, round(avg(d), 6) AS score FROM (SELECT a, b, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM ({PAIRS}) WHERE a % 20 = 0) WHERE r <= 3 GROUP BY 1""")
def knn_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir, "rows")


@query(f"""
SELECT a AS q_id, round(avg(d), 6) AS score FROM (SELECT DISTINCT a, round(d, 9) AS d, dense_rank() OVER (PARTITION BY a ORDER BY round(d, 9)) AS r FROM ({PAIRS}) WHERE a % 20 = 0) WHERE r <= 3 GROUP BY 1""")
def knn_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir, "distinct")


def _knn(spark: SparkSession, sf_dir: str, ties: str) -> DataFrame:
    p = points(spark, sf_dir)
    # The query set is every twentieth vector; the bank is the whole table.
    q = p.where("point_id % 20 = 0").select(F.col("point_id").alias("q_id"), "v")
    return neighbors.knn_mean(q, p.select(F.col("point_id").alias("row_id"), "v"), 3, ties).select("q_id", r6("score").alias("score"))


@query(f"SELECT a AS point_id, count(*) AS degree, count(*) >= 5 AS core FROM ({PAIRS}) WHERE d <= 1.15 GROUP BY 1")
def eps_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.eps_degrees(points(spark, sf_dir), 1.15).withColumn("core", F.col("degree") >= 5)


@query(f"""
WITH RECURSIVE p AS (SELECT * FROM ({PAIRS}) WHERE d <= 1.15),
core AS (SELECT a AS id FROM p GROUP BY 1 HAVING count(*) >= 5),
e AS (SELECT a, b FROM p WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach(a, b) AS (SELECT id, id FROM core UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
comp AS (SELECT a AS id, min(b) AS c FROM reach GROUP BY 1),
named AS (SELECT id, dense_rank() OVER (ORDER BY c) - 1 AS label FROM comp),
border AS (SELECT a AS id, min(label) AS label FROM p JOIN named ON named.id = p.b GROUP BY 1)
SELECT vec_id AS point_id, CAST(coalesce(n.label, b.label, -1) AS INTEGER) AS label FROM embeddings LEFT JOIN named n ON n.id = vec_id LEFT JOIN border b ON b.id = vec_id""")
def dbscan_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.dbscan(points(spark, sf_dir), 1.15, 5)


@query(f"""
WITH k AS (SELECT d, row_number() OVER (ORDER BY d) - 1 AS i FROM (SELECT a, d, row_number() OVER (PARTITION BY a ORDER BY d, b) AS r FROM ({PAIRS}) WHERE a <> b) WHERE r = 5),
s AS (SELECT min(d) AS lo, max(d) AS hi, count(*) AS n FROM k)
SELECT round(arg_max(d, (round(abs((hi - lo) * i - (n - 1) * (d - lo)) / sqrt((n - 1) ** 2 + (hi - lo) ** 2), 12), -i)), 6) AS eps FROM k, s""")
def eps_elbow(spark: SparkSession, sf_dir: str) -> DataFrame:
    eps = cluster.elbow(neighbors.kth_distance(points(spark, sf_dir), 5), 5)
    return spark.createDataFrame([(None if eps is None else round(eps, 6),)], "eps double")


@query(f"""
WITH s AS (SELECT label, dim, sum(x) AS t FROM ({EXPLODED}) GROUP BY ALL), n AS (SELECT label, sqrt(sum(t * t)) AS norm FROM s GROUP BY 1)
SELECT vec_id, round(1 - coalesce(sum(x * t) / max(norm), 0), 6) AS score FROM ({EXPLODED}) JOIN s USING (label, dim) JOIN n USING (label) GROUP BY vec_id""")
def family_centroid_atypicality(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return head.atypicality(e, "vec_id", "label", "embedding").select("vec_id", r6("score").alias("score"))


@query(f"""
WITH m AS (SELECT label, dim, avg(x) AS c FROM ({EXPLODED}) GROUP BY ALL), n AS (SELECT label, sqrt(sum(c * c)) AS n FROM m GROUP BY 1)
SELECT label, CAST(dim AS INTEGER) AS dim, round(c * 10 / n, 5) AS coef, round(-n * 5, 6) AS intercept FROM m JOIN n USING (label)""")
def centroid_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = head.centroid_head(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return h.select("label", r6("intercept").alias("intercept"), F.posexplode("coef").alias("dim", "coef")).withColumn("coef", F.round("coef", 5))


def _fixed_head() -> list[tuple[int, float, list[float]]]:
    return [(c, 0.1 * c, [((c * 7 + d * 3) % 11 - 5) / 2.0 for d in range(64)]) for c in range(4)]


@query(f"""
WITH z AS (SELECT vec_id, c, sum(x * (((c * 7 + dim * 3) % 11) - 5) / 2.0) + 0.1 * c AS z FROM ({EXPLODED}), (SELECT unnest(range(4)) AS c) GROUP BY vec_id, c),
q AS (SELECT vec_id, c, exp(z - max(z) OVER (PARTITION BY vec_id)) AS e FROM z)
SELECT vec_id, round(1 - sum(e) FILTER (c = 0) / sum(e), 6) AS defect, CAST(arg_max(c, (e, -c)) FILTER (c <> 0) AS INTEGER) AS best FROM q GROUP BY 1""")
def softmax_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return head.classify(table(spark, sf_dir, "embeddings"), _fixed_head(), "vec_id", "embedding").select("vec_id", r6("defect").alias("defect"), "best")


@query("""
WITH o AS (SELECT embedding::DOUBLE[] AS o FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_distance(embedding::DOUBLE[], o), 6) AS d, round(list_dot_product(embedding::DOUBLE[], o), 6) AS p, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS n FROM embeddings, o""")
def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    first = e.where("vec_id = 0").select("embedding").first()[0]
    o = F.lit([float(x) for x in first])
    return e.select("vec_id", r6(distance(F.col("embedding"), o)).alias("d"), r6(dot(F.col("embedding"), o)).alias("p"), F.round(norm(F.col("embedding")), 5).alias("n"))


def _merges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    from verdure.operators.pivots import finite
    from verdure.session import cut

    p = points(spark, sf_dir)
    return cut(cluster.linkage(p)), p.where(finite("v")).count()


@query()
def linkage_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.linkage(points(spark, sf_dir))


@query()
def hierarchical_cut_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    merges, n = _merges(spark, sf_dir)
    return cluster.cut_k(merges, n, 8, 3)


@query()
def suggest_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    merges, n = _merges(spark, sf_dir)
    return cluster.suggest_k(merges, n)


@query()
def adaptive_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    merges, n = _merges(spark, sf_dir)
    return cluster.adaptive_cut(merges, n, 3.0)


#: A fixed merge list over the orders of a customer: each is absorbed by an earlier one.
FIXED = "SELECT o_orderkey AS node, first_value(o_orderkey) OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS f, lag(o_orderkey) OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS parent FROM orders"


@query(f"SELECT node, f AS root FROM ({FIXED})")
def merge_forest_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdure.operators.graph import roots

    w = Window.partitionBy("o_custkey", "o_orderstatus").orderBy("o_orderkey")
    return roots(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("node"), F.coalesce(F.lag("o_orderkey").over(w), F.col("o_orderkey")).alias("parent")))


@query()
def pca_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    values, _, _ = stats.principal(table(spark, sf_dir, "embeddings"), "embedding", 64)
    return spark.createDataFrame([(i, x / sum(values)) for i, x in enumerate(values[:8])], "component int, share double")


@query()
def ml_head_retrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    import numpy as np

    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("class"), F.lit(1.0).alias("weight"), F.col("embedding").cast("array<double>").alias("x"))
    w, losses = head.retrain(rows, list(range(10)), np.zeros((10, 65)), iterations=2_000)
    return spark.createDataFrame([(c, float(np.linalg.norm(w[c, :-1])), float(w[c, -1]), losses[-1]) for c in range(10)], "class int, norm double, intercept double, loss double")


# --- sampling ---


@query("""
WITH RECURSIVE f(doc_id, source, i, h) AS (
  SELECT doc_id, source || '/' || doc_id, 0, 14695981039346656037::HUGEINT FROM documents
  UNION ALL SELECT doc_id, source, i + 1, (xor(h::UBIGINT, ascii(source[i + 1])::UBIGINT)::HUGEINT * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT FROM f WHERE i < length(source))
SELECT doc_id, CASE WHEN h % 100 < 15 THEN 'val' ELSE 'train' END AS part FROM f WHERE i = length(source)""")
def fnv_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", scalars.split(F.concat("source", F.lit("/"), "doc_id")).alias("part"))


@query("""
WITH c AS (SELECT l_returnflag AS k, count(*) AS n FROM lineitem GROUP BY 1),
r AS (SELECT l.*, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS i, n, CASE WHEN k = 'N' THEN 300 ELSE 100 END AS want FROM lineitem l JOIN c ON k = l_returnflag)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag FROM r WHERE i % greatest(1, n // want) = 0 AND i // greatest(1, n // want) < want""")
def stratified_stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.stratified_stride(table(spark, sf_dir, "lineitem").select(*REGION, "l_returnflag"), "l_returnflag", REGION, {"A": 100, "N": 300, "R": 100})


@query("SELECT event_id FROM events ORDER BY md5(CAST(event_id AS VARCHAR)), event_id LIMIT 500")
def reservoir_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.reservoir(table(spark, sf_dir, "events").select("event_id"), F.md5(F.col("event_id").cast("string")), 500)


@query("""
SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r <= 10 ORDER BY event_id LIMIT 2000""")
def per_item_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.capped(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", ["event_id"], 10, 2000)


@query("""
WITH r AS (SELECT doc_id, source, quality FROM labels JOIN documents USING (doc_id)), c AS (SELECT quality, count(*) AS n FROM r GROUP BY 1)
SELECT doc_id, round(((SELECT count(*) FROM r) / ((SELECT count(*) FROM c) * greatest(n, 15.0))) * CASE WHEN doc_id % 7 = 0 THEN 4 ELSE 1 END / count(*) OVER (PARTITION BY source), 8) AS weight
FROM r JOIN c USING (quality)""")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return sampling.class_weights(rows, "quality", "source", F.col("doc_id") % 7 == 0).select("doc_id", F.round("weight", 8).alias("weight"))


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) WHERE i IN (SELECT k * n2 // 40 FROM (SELECT unnest(range(40)) AS k, (SELECT count(*) FROM orders) AS n2))")
def evenly_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.evenly_spaced(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 40)


# --- evaluation ---

EVAL = "SELECT l_suppkey % 20 AS sample, l_discount * 10 > 0.5 AS p, l_tax * 10 > 0.3 AS t, l_linenumber <= 3 AS zone FROM lineitem"
METRICS = """
SELECT sample, tp / greatest(tp + fp + fn, 1e-7) AS iou, 2 * tp / greatest(2 * tp + fp + fn, 1e-7) AS dice, tp / greatest(tp + fp, 1e-7) AS "precision", tp / greatest(tp + fn, 1e-7) AS recall, (tp + tn) / greatest(tp + fp + fn + tn, 1e-7) AS pixel_acc
FROM (SELECT sample, count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (NOT p AND t) AS fn, count(*) FILTER (NOT p AND NOT t) AS tn FROM (""" + EVAL + ") WHERE zone GROUP BY 1)"
NAMES = ("iou", "dice", "precision", "recall", "pixel_acc")


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("sample"), (F.col("l_discount") * 10 > 0.5).alias("p"), (F.col("l_tax") * 10 > 0.3).alias("t"), (F.col("l_linenumber") <= 3).alias("zone"))
    return evaluation.confusion(rows, ["sample"], F.col("p"), F.col("t"), F.col("zone"))


@query("SELECT sample, " + ", ".join(f'round("{c}", 6) AS "{c}"' for c in NAMES) + f" FROM ({METRICS})")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select("sample", *[r6(c).alias(c) for c in NAMES])


@query("SELECT " + ", ".join(f'round(avg("{c}"), 6) AS "{c}"' for c in NAMES) + f" FROM ({METRICS})")
def macro_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.macro_average(_metrics(spark, sf_dir)).select(*[r6(c).alias(c) for c in NAMES])


@query("""
WITH s AS (SELECT l_suppkey AS sample, l_discount * 8 + 0.001 AS p, l_tax > 0.03 AS t FROM lineitem),
g AS (SELECT 0.2 + 0.02 * k AS tau FROM (SELECT unnest(range(31)) AS k)),
b AS (SELECT sample, tau, (count(*) FILTER (p > tau) - count(*) FILTER (t)) * 100.0 / count(*) AS b FROM s, g GROUP BY ALL)
SELECT round(tau, 2) AS tau, round(avg(b), 6) AS bias FROM b GROUP BY tau""")
def area_report_tau_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("sample"), (F.col("l_discount") * 8 + 0.001).alias("p"), "l_tax")
    return evaluation.tau_sweep(rows, "sample", "p", F.col("l_tax") > 0.03).select(F.round("tau", 2).alias("tau"), r6("bias").alias("bias"))


@query("""
SELECT l_returnflag, count(*) AS n, round(avg(abs(l_extendedprice - l_quantity * 1000)), 4) AS mae, round(avg(l_extendedprice - l_quantity * 1000), 4) AS bias,
  round(avg(abs(l_extendedprice - l_quantity * 1000) / (l_quantity * 1000)), 6) AS mape FROM lineitem WHERE l_quantity > 0 GROUP BY 1""")
def area_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").withColumn("truth", F.col("l_quantity") * 1000)
    return evaluation.area_report(rows, "l_extendedprice", "truth", ["l_returnflag"]).select("l_returnflag", "n", F.round("mae", 4).alias("mae"), F.round("bias", 4).alias("bias"), r6("mape").alias("mape"))


@query("""
SELECT b.bucket, count(l_orderkey) AS n, round(avg(l_extendedprice), 4) AS mean FROM (SELECT unnest(['<20', '20-40', '>=40']) AS bucket) b
LEFT JOIN lineitem ON b.bucket = CASE WHEN l_quantity < 20 THEN '<20' WHEN l_quantity < 40 THEN '20-40' ELSE '>=40' END GROUP BY 1""")
def severity_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.severity(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice").select("bucket", "n", F.round("mean", 4).alias("mean"))


@query("SELECT count(*) FILTER (value > 50 AND event_type <> 'click') AS fired, count(*) FILTER (event_type <> 'click') AS valid, round(count(*) FILTER (value > 50 AND event_type <> 'click') / count(*) FILTER (event_type <> 'click'), 8) AS rate FROM events")
def fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.false_positive_rate(table(spark, sf_dir, "events"), F.col("value") > 50, F.col("event_type") != "click").withColumn("rate", F.round("rate", 8))


# --- geometry and pixels ---

RUNS = "SELECT p_size AS leaf, p_partkey AS region, p_partkey % 60 AS y, CAST(floor(p_retailprice) AS BIGINT) % 90 AS x0, CAST(floor(p_retailprice) AS BIGINT) % 90 + p_partkey % 4 AS x1 FROM part"


@query(f"""
WITH RECURSIVE r AS ({RUNS}),
e AS (SELECT a.region AS a, b.region AS b FROM r a JOIN r b ON a.leaf = b.leaf AND abs(a.y - b.y) <= 1 AND a.x0 <= b.x1 + 1 AND b.x0 <= a.x1 + 1),
reach(a, b) AS (SELECT region, region FROM r UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
SELECT a AS node, min(b) AS component FROM reach GROUP BY 1""")
def touch_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.floor("p_retailprice") % 90
    runs = table(spark, sf_dir, "part").select(F.col("p_size").alias("leaf"), F.col("p_partkey").alias("region"), (F.col("p_partkey") % 60).alias("y"), price.alias("x0"), (price + F.col("p_partkey") % 4).alias("x1"))
    return geometry.touch_components(runs, ["leaf"], "region")


RING = [(0.0, 0.0), (6.0, 1.0), (9.0, 7.0), (3.0, 4.5), (-2.0, 8.0)]


@query("""
WITH ring AS (SELECT unnest([0, 1, 2, 3, 4]) AS i, unnest([0.0, 6.0, 9.0, 3.0, -2.0]) AS ax, unnest([0.0, 1.0, 7.0, 4.5, 8.0]) AS ay, unnest([6.0, 9.0, 3.0, -2.0, 0.0]) AS bx, unnest([1.0, 7.0, 4.5, 8.0, 0.0]) AS bys)
SELECT c_custkey, sum(CASE WHEN (ay > y) <> (bys > y) AND x < (bx - ax) * (y - ay) / (bys - ay) + ax THEN 1 ELSE 0 END) % 2 = 1 AS inside
FROM (SELECT c_custkey, c_custkey % 130 / 10.0 - 2.05 AS x, c_custkey % 97 / 10.0 - 0.55 AS y FROM customer), ring GROUP BY 1""")
def polygon_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in RING])
    p = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 130 / 10.0 - 2.05).alias("x"), (F.col("c_custkey") % 97 / 10.0 - 0.55).alias("y"))
    return p.select("c_custkey", scalars.contains(ring, F.col("x"), F.col("y")).alias("inside"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_discount > 0.05 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_totalprice > 100000)")
def novel_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    closed = table(spark, sf_dir, "orders").where("o_totalprice > 100000").select(F.col("o_orderkey").alias("l_orderkey"))
    return geometry.novel(table(spark, sf_dir, "lineitem").where("l_discount > 0.05"), closed, ["l_orderkey"]).select(*REGION)


_LINEAR = "CASE WHEN {0} / 255.0 <= 0.04045 THEN {0} / 255.0 / 12.92 ELSE pow(({0} / 255.0 + 0.055) / 1.055, 2.4) END"
_ROOT = "CASE WHEN {0} > 0.008856 THEN cbrt({0}) ELSE 7.787 * {0} + 16.0 / 116.0 END"


@query(f"""
WITH c AS (SELECT p_partkey, {_LINEAR.format('(p_partkey % 256)')} AS r, {_LINEAR.format('(p_partkey * 7 % 256)')} AS g, {_LINEAR.format('(p_partkey * 13 % 256)')} AS b FROM part),
t AS (SELECT p_partkey, (r * 0.4124 + g * 0.3576 + b * 0.1805) / 0.95047 AS x, r * 0.2126 + g * 0.7152 + b * 0.0722 AS y, (r * 0.0193 + g * 0.1192 + b * 0.9505) / 1.08883 AS z FROM c),
f AS (SELECT p_partkey, {_ROOT.format('x')} AS fx, {_ROOT.format('y')} AS fy, {_ROOT.format('z')} AS fz FROM t)
SELECT p_partkey, round(116 * fy - 16, 5) AS l, round(500 * (fx - fy), 5) AS a, round(200 * (fy - fz), 5) AS b FROM f""")
def lab_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    lab = scalars.lab(k % 256, k * 7 % 256, k * 13 % 256)
    return table(spark, sf_dir, "part").select("p_partkey", *[F.round(x, 5).alias(n) for x, n in zip(lab, "lab")])


@query("""
WITH h AS (SELECT p_partkey, (p_partkey * 2654435761) % 4294967296 AS h FROM part)
SELECT p_partkey, round(((h & 65535) / 65535.0 - 0.5) * 0.7, 6) AS jx, round(((h >> 16) / 65535.0 - 0.5) * 0.7, 6) AS jy FROM h""")
def family_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = scalars.jitter(F.col("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", r6(x).alias("jx"), r6(y).alias("jy"))


@query("""
SELECT p_size AS leaf, CAST(ty * nx + tx AS BIGINT) AS tile, CAST(tx * 8 AS INTEGER) AS ox, CAST(ty * 8 AS INTEGER) AS oy FROM
(SELECT DISTINCT p_size, CAST(ceil(p_size / 8.0) AS BIGINT) AS nx, CAST(ceil((p_size % 13 + 5) / 8.0) AS BIGINT) AS ny FROM part), LATERAL (SELECT unnest(range(nx)) AS tx), LATERAL (SELECT unnest(range(ny)) AS ty)""")
def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = table(spark, sf_dir, "part").select(F.col("p_size").alias("leaf"), F.col("p_size").alias("w"), (F.col("p_size") % 13 + 5).alias("h")).distinct()
    return geometry.tiles(leaves, 8).select("leaf", F.col("tile").cast("long").alias("tile"), "ox", "oy")


# --- the curation cycle ---


@query("""
WITH n AS (SELECT l_suppkey AS blob, l_returnflag AS family, count(*) AS c FROM lineitem GROUP BY ALL),
s AS (SELECT *, c / sum(c) OVER (PARTITION BY blob) AS share, row_number() OVER (PARTITION BY blob ORDER BY c DESC, family) AS r FROM n),
b AS (SELECT *, count(*) FILTER (share >= 0.35) OVER (PARTITION BY blob) AS big FROM s)
SELECT blob, family, round(share, 6) AS share FROM b WHERE CASE WHEN big >= 2 THEN share >= 0.35 ELSE r = 1 END""")
def significant_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdure.operators.mining import significant_families as f

    return f(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_returnflag", 0.35).select(F.col("l_suppkey").alias("blob"), F.col("l_returnflag").alias("family"), r6("share").alias("share"))


@query("""
WITH p AS (SELECT * FROM lineitem WHERE l_discount >= 0.08 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) <= 2)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'rejected' AS family, 'mined' AS source FROM p ORDER BY 1, 2, 3, 4 LIMIT 2000""")
def hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdure.operators.mining import hard_negatives

    return hard_negatives(table(spark, sf_dir, "lineitem").select(*REGION, "l_discount"), "l_discount", 0.08, "l_orderkey", REGION, 2, 2000).drop("l_discount")


@query("""
SELECT p_partkey, p_size FROM part p WHERE p_size IN (SELECT p_size FROM part GROUP BY 1 HAVING count(*) > 3)
  AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey = p_partkey)""")
def unmarked_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdure.operators.mining import unmarked

    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    covered = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_partkey")).join(part, "p_partkey")
    reviewed = part.groupBy("p_size").count().where("count > 3").select("p_size")
    return unmarked(part, covered, reviewed, "p_size", ["p_partkey"]).select("p_partkey", "p_size")


@query("""
WITH t AS (SELECT event_type AS channel, user_id % 20 AS tile, value FROM events WHERE value IS NOT NULL),
med AS (SELECT channel, tile, median(value) AS med FROM t GROUP BY ALL),
mad AS (SELECT channel, tile, med, median(med - value) * 1.4826 AS scale FROM t JOIN med USING (channel, tile) WHERE value <= med GROUP BY ALL),
fl AS (SELECT channel, scale AS floor FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY scale, tile) AS r, count(*) OVER (PARTITION BY channel) AS n FROM mad WHERE scale > 0) WHERE r = round(0.25 * (n - 1)) + 1),
z AS (SELECT channel, tile, floor, (value - med) / (greatest(scale, floor) + 1e-6) AS z FROM t JOIN mad USING (channel, tile) JOIN fl USING (channel)),
k AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY z, tile) AS r, count(*) OVER (PARTITION BY channel) AS n FROM z)
SELECT channel, round(floor, 6) AS floor, round(z, 6) AS threshold FROM k WHERE r = round((1 - 0.01) * (n - 1)) + 1""")
def detector_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdure.operators.mining import calibrate

    t = table(spark, sf_dir, "events").where("value is not null").select(F.col("event_type").alias("channel"), (F.col("user_id") % 20).alias("tile"), "value")
    return calibrate(t, "channel", "tile", "value", 0.01).select("channel", r6("floor").alias("floor"), r6("threshold").alias("threshold"))


@query("""
SELECT l_suppkey AS region, count(*) FILTER (l_partkey % 5 = 0) AS erased, count(*) FILTER (l_partkey % 5 <> 0) AS "left"
FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_partkey % 5 = 0) > 0""")
def erase_stroke(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdure.operators.mining import erase

    stroke = table(spark, sf_dir, "part").where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("l_partkey"))
    return erase(table(spark, sf_dir, "lineitem"), stroke, ["l_partkey"], "l_suppkey").withColumnRenamed("l_suppkey", "region")


@query(f"""
WITH p AS ({EXPLODED}), t AS (SELECT label, vec_id % 2 = 0 AS ok, dim, x FROM p), u AS (SELECT *, bool_or(ok) OVER (PARTITION BY label) AS lit FROM t)
SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(x), 5) AS value FROM u WHERE ok OR NOT lit GROUP BY 1, 2""")
def masked_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdure.operators.mining import masked_pool as f

    return f(table(spark, sf_dir, "embeddings"), "label", "embedding", F.col("vec_id") % 2 == 0).withColumn("value", F.round("value", 5))


@query("SELECT round(arg_min(tau, (abs(bias), tau)), 2) AS tau FROM (" + ORACLE_SQL["area_report_tau_sweep"] + ")")
def best_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.best_tau(area_report_tau_sweep(spark, sf_dir)).withColumn("tau", F.round("tau", 2))


@query("""
SELECT l_returnflag AS sample, round(count(*) FILTER (a AND b) / count(*) FILTER (a OR b), 8) AS iou FROM
(SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey, bool_or(l_discount > 0.05) AS a, bool_or(l_tax > 0.04) AS b FROM lineitem GROUP BY 1, 2, 3, 4, 5) GROUP BY 1""")
def mask_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["sample", *REGION]
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "sample")
    return geometry.mask_iou(rows.where("l_discount > 0.05").select(*keys).distinct(), rows.where("l_tax > 0.04").select(*keys).distinct(), keys).withColumn("iou", F.round("iou", 8))


@query("""
SELECT p_partkey, round(CASE WHEN p_retailprice = 0 THEN 0 ELSE p_size * 100.0 / p_retailprice END, 6) AS damage, CAST(greatest(64, least(256, greatest(p_size, p_size % 13 + 5) * 6 + 16)) AS INTEGER) AS side,
  round(0.001 * (0.1 + 0.9 * 0.5 * (1 + cos(3.141592653589793 * p_size / 50.0))), 9) AS rate, CASE WHEN regexp_matches(p_name, '[,"\n]') THEN '"' || replace(p_name, '"', '""') || '"' ELSE p_name END AS cell,
  printf('%s_leaf%02d', p_brand, p_size) AS leaf FROM part""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", r6(scalars.damage_percent(size, F.col("p_retailprice"))).alias("damage"), scalars.window_side(size * 6, (size % 13 + 5) * 6).cast("int").alias("side"),
        F.round(scalars.cosine_rate(size / 50.0, 0.001, 0.1), 9).alias("rate"), scalars.csv_field(F.col("p_name")).alias("cell"), scalars.leaf_name(F.col("p_brand"), size).alias("leaf"),
    )


@query()
def domain_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    from verdure.operators import projection

    e = table(spark, sf_dir, "embeddings")
    return projection.project(e, "vec_id", "embedding", projection.fit(e, "label", "embedding"))


@query("""
SELECT l_suppkey AS sample, round(1 - (tp + 1e-6) / (tp + 0.3 * fp + 0.7 * fn + 1e-6), 6) AS tversky, round(bce, 6) AS bce, round(ent, 6) AS entropy FROM (
  SELECT l_suppkey, count(*) FILTER (l_discount > 0.05 AND l_tax > 0.04) AS tp, count(*) FILTER (l_discount > 0.05 AND l_tax <= 0.04) AS fp, count(*) FILTER (l_discount <= 0.05 AND l_tax > 0.04) AS fn,
    avg(CASE WHEN l_tax > 0.04 THEN -ln(q) ELSE -ln(1 - q) END) AS bce, avg(-(q * ln(q) + (1 - q) * ln(1 - q))) AS ent
  FROM (SELECT *, greatest(1e-7, least(1 - 1e-7, l_discount * 8)) AS q FROM lineitem) GROUP BY 1)""")
def loss_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, t = F.col("l_discount") > 0.05, F.col("l_tax") > 0.04
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("sample")).agg(
        F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"),
        F.avg(scalars.cross_entropy(F.col("l_discount") * 8, t)).alias("bce"), F.avg(scalars.entropy(F.col("l_discount") * 8)).alias("entropy"),
    )
    return g.select("sample", r6(scalars.tversky(F.col("tp"), F.col("fp"), F.col("fn"))).alias("tversky"), r6("bce").alias("bce"), r6("entropy").alias("entropy"))
