"""The raster kernels as queries over a pixel table, with SQL over the same pixels.

Leaves are the sizes of ``part``; each part lays a run of up to six pixels, with a value
v from 0 to 99 and a family f from 0 to 2, on its leaf's canvas of 40 by 30.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdure.kernels import decide, raster
from verdure.kernels.apply import map_masks
from verdure.operators import regions
from verdure.plans.catalog import query, r6, table

W, H = 40, 30


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.explode(F.sequence(F.lit(0), (F.col("p_partkey") % 6).cast("int")))
    runs = table(spark, sf_dir, "part").select(F.col("p_size").alias("leaf"), F.floor("p_retailprice").alias("at"), "p_partkey", k.alias("k"))
    rows = runs.select("leaf", ((F.col("at") + F.col("k")) % W).cast("int").alias("x"), (F.col("p_partkey") * 7 % H).cast("int").alias("y"), (F.col("p_partkey") % 100).cast("int").alias("v"), (F.col("p_partkey") % 3).cast("int").alias("f"))
    return rows.groupBy("leaf", "x", "y").agg(F.max("v").alias("v"), F.min("f").alias("f"))


def at(mask: np.ndarray, **more: np.ndarray) -> dict[str, np.ndarray]:
    """The mask's pixels as columns, with the values of other arrays there."""
    y, x = np.nonzero(mask)
    return {"x": x, "y": y, **{k: v[y, x] for k, v in more.items()}}


def on_leaves(kernel: Callable, schema: str, sql: str, name: str, finish: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Registers a kernel as the query ``name``."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = map_masks(pixels(spark, sf_dir), kernel, schema, H, W)
        return finish(out) if finish else out

    run.__name__ = name
    query(sql)(run)


# --- SQL parts ---

PX = f"""
px AS (SELECT leaf, x, y, max(v) AS v, min(f) AS f FROM (
  SELECT p_size AS leaf, CAST((CAST(floor(p_retailprice) AS BIGINT) + k) % {W} AS INTEGER) AS x, CAST(p_partkey * 7 % {H} AS INTEGER) AS y, CAST(p_partkey % 100 AS INTEGER) AS v, CAST(p_partkey % 3 AS INTEGER) AS f
  FROM part, (SELECT unnest(range(6)) AS k) WHERE k <= p_partkey % 6) GROUP BY leaf, x, y),
leaves AS (SELECT DISTINCT leaf FROM px),
grid AS (SELECT leaf, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM leaves, (SELECT unnest(range({W})) AS x), (SELECT unnest(range({H})) AS y)),
off AS (SELECT dx, dy FROM (SELECT unnest([-1, 0, 1]) AS dx), (SELECT unnest([-1, 0, 1]) AS dy))"""
WITH = f"WITH RECURSIVE {PX}"


def comp(name: str, src: str, four: bool = False) -> str:
    """CTEs: ``name`` (leaf, x, y, c), c being the first pixel, in scan order, of the component."""
    near = "abs(dx) + abs(dy) <= 1" if four else "true"
    return f"""
{name}_r(leaf, a, x, y) AS (SELECT leaf, y * {W} + x, x, y FROM {src}
  UNION SELECT r.leaf, r.a, q.x, q.y FROM {name}_r r CROSS JOIN off JOIN {src} q ON q.leaf = r.leaf AND q.x = r.x + dx AND q.y = r.y + dy WHERE {near}),
{name} AS (SELECT leaf, x, y, min(a) AS c FROM {name}_r GROUP BY leaf, x, y)"""


def around(name: str, src: str, every: bool) -> str:
    """A CTE: pixels of the canvas with any, or every, neighbour within one step in ``src``."""
    return f"""
{name} AS (SELECT g.leaf, g.x, g.y FROM grid g CROSS JOIN off LEFT JOIN {src} p ON p.leaf = g.leaf AND p.x = g.x + dx AND p.y = g.y + dy
  WHERE g.x + dx BETWEEN 0 AND {W - 1} AND g.y + dy BETWEEN 0 AND {H - 1} GROUP BY g.leaf, g.x, g.y HAVING {'count(p.leaf) = count(*)' if every else 'count(p.leaf) > 0'})"""


def close(name: str, src: str) -> str:
    return around(f"{name}_d", src, False) + "," + around(name, f"{name}_d", True)


def outside(name: str, src: str, four: bool = True) -> str:
    """CTEs: the pixels off ``src`` that are connected to the border without it."""
    near = "abs(dx) + abs(dy) <= 1" if four else "true"
    return f"""
{name}_f AS (SELECT g.* FROM grid g LEFT JOIN {src} p ON p.leaf = g.leaf AND p.x = g.x AND p.y = g.y WHERE p.leaf IS NULL),
{name}(leaf, x, y) AS (SELECT leaf, x, y FROM {name}_f WHERE x IN (0, {W - 1}) OR y IN (0, {H - 1})
  UNION SELECT q.leaf, q.x, q.y FROM {name} r CROSS JOIN off JOIN {name}_f q ON q.leaf = r.leaf AND q.x = r.x + dx AND q.y = r.y + dy WHERE {near})"""


def seeded(name: str, low: str, high: str, least: int = 1) -> str:
    """CTEs: pixels of the components of ``low`` that hold a pixel of ``high``; (leaf, x, y, v, f)."""
    return f"""
{name}_l AS (SELECT * FROM px WHERE {low}),{comp(name + '_c', name + '_l')},
{name}_k AS (SELECT c.leaf, c.c FROM {name}_c c JOIN {name}_l USING (leaf, x, y) GROUP BY c.leaf, c.c HAVING bool_or({high}) AND count(*) >= {least}),
{name} AS (SELECT p.* FROM {name}_l p JOIN {name}_c c USING (leaf, x, y) JOIN {name}_k k ON k.leaf = c.leaf AND k.c = c.c)"""


# --- components ---

on_leaves(
    lambda mask, _: at(mask, label=raster.label(mask)[0]), "x int, y int, label int",
    f"{WITH},{comp('k', 'px')} SELECT leaf, x, y, CAST(dense_rank() OVER (PARTITION BY leaf ORDER BY c) AS INTEGER) AS label FROM k", "px_components",
)


def _region_rows(found: DataFrame) -> DataFrame:
    return regions.extract(found, ["leaf", "label"], 3).select("leaf", "label", "x", "y", "w", "h", "area", r6("cx").alias("cx"), r6("cy").alias("cy"))


on_leaves(
    lambda mask, _: at(mask, label=raster.label(mask)[0]), "x int, y int, label int",
    f"""{WITH},{comp('k', 'px')}, l AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY leaf ORDER BY c) AS INTEGER) AS label FROM k)
SELECT leaf, label, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS area, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM l GROUP BY leaf, label HAVING count(*) >= 3""",
    "px_regions", _region_rows,
)
on_leaves(
    lambda mask, _: at(raster.largest(mask)), "x int, y int",
    f"""{WITH},{comp('k', 'px', True)}, s AS (SELECT leaf, c, row_number() OVER (PARTITION BY leaf ORDER BY count(*) DESC, c) AS r FROM k GROUP BY leaf, c)
SELECT leaf, x, y FROM k JOIN s USING (leaf, c) WHERE r = 1""", "px_largest",
)
on_leaves(
    lambda mask, _: at(raster.drop_small(mask, 0.02, 4)), "x int, y int",
    f"""{WITH},{comp('k', 'px', True)}, s AS (SELECT leaf, c, count(*) AS n, sum(count(*)) OVER (PARTITION BY leaf) AS total FROM k GROUP BY leaf, c)
SELECT leaf, x, y FROM k JOIN s USING (leaf, c) WHERE n >= greatest(0.02 * total, 4)""", "px_drop_small",
)
on_leaves(
    lambda mask, _: at(raster.drop_speckles(mask, 0.15, 3)), "x int, y int",
    f"""{WITH},{comp('k', 'px')}, s AS (SELECT leaf, c, count(*) AS n, max(count(*)) OVER (PARTITION BY leaf) AS big FROM k GROUP BY leaf, c)
SELECT leaf, x, y FROM k JOIN s USING (leaf, c) WHERE n >= greatest(0.15 * big, 3)""", "px_speckles",
)
on_leaves(
    lambda mask, c: at(raster.hysteresis(c["v"], 80, 30, mask)), "x int, y int",
    f"{WITH},{seeded('k', 'v >= 30', 'v >= 80')} SELECT leaf, x, y FROM k", "px_hysteresis",
)
on_leaves(
    lambda mask, c: at(raster.family_hysteresis(c["v"], c["f"], 85, {1: 60}, 40, 3, mask)), "x int, y int",
    f"{WITH},{seeded('k', 'v >= least(40, CASE WHEN f = 1 THEN 60 ELSE 85 END)', 'v >= CASE WHEN f = 1 THEN 60 ELSE 85 END', 3)} SELECT leaf, x, y FROM k", "px_family_hysteresis",
)
on_leaves(
    lambda mask, c: at(raster.scale_gate(mask, mask & (c["v"] >= 90), 3)), "x int, y int",
    f"""{WITH},{comp('k', 'px')}, s AS (SELECT leaf, c FROM k JOIN px USING (leaf, x, y) GROUP BY leaf, c HAVING count(*) <= 3 OR bool_or(v >= 90))
SELECT leaf, x, y FROM k JOIN s USING (leaf, c)""", "px_scale_gate",
)


# --- morphology ---


def _morphology(mask: np.ndarray, _: dict) -> dict[str, np.ndarray]:
    parts = [(name, at(f(mask, 1))) for name, f in (("erode", raster.erode), ("dilate", raster.dilate), ("close", raster.close))]
    return {"op": np.concatenate([np.full(len(p["x"]), name, object) for name, p in parts]), **{c: np.concatenate([p[c] for _, p in parts]) for c in "xy"}}


on_leaves(
    _morphology, "op string, x int, y int",
    f"""{WITH},{around('e', 'px', True)},{around('d', 'px', False)},{close('c', 'px')}
SELECT leaf, 'erode' AS op, x, y FROM e UNION ALL SELECT leaf, 'dilate', x, y FROM d UNION ALL SELECT leaf, 'close', x, y FROM c""", "px_morphology",
)


def _exterior(mask: np.ndarray, _: dict) -> dict[str, np.ndarray]:
    d = raster.exterior_distance(mask)
    return at(mask & (d is not None), d=np.zeros(mask.shape, np.int32) if d is None else d)


on_leaves(
    _exterior, "x int, y int, d int",
    f"{WITH},{outside('o', 'px')} SELECT p.leaf, p.x, p.y, min(abs(p.x - o.x) + abs(p.y - o.y)) AS d FROM px p JOIN o ON o.leaf = p.leaf GROUP BY p.leaf, p.x, p.y", "px_exterior_distance",
)
FILLED = "SELECT g.* FROM grid g LEFT JOIN o ON o.leaf = g.leaf AND o.x = g.x AND o.y = g.y WHERE o.leaf IS NULL"
on_leaves(
    lambda mask, _: at(raster.fill_holes(raster.close(mask, 1))), "x int, y int",
    f"{WITH},{close('c', 'px')},{outside('o', 'c')} {FILLED}", "px_fill_holes",
)


def _holes(mask: np.ndarray, _: dict) -> dict[str, np.ndarray]:
    found = [(*raster.box_of(m), int(m.sum())) for m in raster.geometric_holes(raster.dilate(mask, 1), 2)]
    return dict(zip(("x", "y", "w", "h", "n"), np.array(found, np.int64).reshape(-1, 5).T))


on_leaves(
    _holes, "x int, y int, w int, h int, n int",
    f"""{WITH},{around('d', 'px', False)},{outside('o', 'd', False)}, h0 AS (SELECT f.* FROM o_f f LEFT JOIN o ON o.leaf = f.leaf AND o.x = f.x AND o.y = f.y WHERE o.leaf IS NULL),{comp('k', 'h0')}
SELECT leaf, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, CAST(count(*) AS INTEGER) AS n FROM k GROUP BY leaf, c HAVING count(*) >= 2""", "px_geometric_holes",
)


def _hole_regions(mask: np.ndarray, _: dict) -> dict[str, np.ndarray]:
    y, x = np.mgrid[:H, :W]
    kept, flagged = decide.hole_regions(raster.dilate(mask, 1), (x + y) % 3 == 0, 2)
    first = {int(np.flatnonzero(m)[0]) for m in kept}
    holes = raster.geometric_holes(raster.dilate(mask, 1), 2)
    rows = [(f := int(np.flatnonzero(m)[0]), int(m.sum()), int(f in first), int(flagged[m].sum())) for m in holes]
    return dict(zip(("first", "n", "region", "flagged"), np.array(rows, np.int64).reshape(-1, 4).T))


on_leaves(
    _hole_regions, "first int, n int, region int, flagged int",
    f"""{WITH},{around('d', 'px', False)},{outside('o', 'd', False)}, h0 AS (SELECT f.* FROM o_f f LEFT JOIN o ON o.leaf = f.leaf AND o.x = f.x AND o.y = f.y WHERE o.leaf IS NULL),{comp('k', 'h0')}
SELECT leaf, CAST(c AS INTEGER) AS first, CAST(count(*) AS INTEGER) AS n, CASE WHEN 2 * count(*) FILTER ((x + y) % 3 = 0) > count(*) THEN 0 ELSE 1 END AS region, CAST(count(*) AS INTEGER) AS flagged FROM k GROUP BY leaf, c HAVING count(*) >= 2""", "px_hole_regions",
)


def _margin(mask: np.ndarray, c: dict) -> dict[str, np.ndarray]:
    """A leaf that fills its canvas has no outside: all of its holes are kept."""
    opaque = raster.dilate(mask, 1)
    labels, n = raster.label(mask & (c["f"] == 2))
    kept = decide.margin_holes([labels == k for k in range(1, n + 1)], opaque, 3)
    return at(np.logical_or.reduce(kept) if kept else np.zeros(mask.shape, bool))


on_leaves(
    _margin, "x int, y int",
    f"""{WITH},{around('d', 'px', False)},{outside('o', 'd')}, two AS (SELECT * FROM px WHERE f = 2),{comp('k', 'two')},
far AS (SELECT k.leaf, k.x, k.y, k.c, min(abs(k.x - o.x) + abs(k.y - o.y)) AS d FROM k LEFT JOIN o ON o.leaf = k.leaf GROUP BY ALL)
SELECT leaf, x, y FROM far JOIN (SELECT leaf, c FROM far GROUP BY leaf, c HAVING max(d) >= 3 OR max(d) IS NULL) USING (leaf, c)""", "px_margin_holes",
)


def _cleared(mask: np.ndarray, c: dict) -> dict[str, np.ndarray]:
    labels, n = raster.label(mask & (c["f"] == 2))
    return at(decide.without_margin_holes(mask, [labels == k for k in range(1, n + 1)], raster.dilate(mask, 1), 3))


on_leaves(
    _cleared, "x int, y int",
    f"""{WITH},{around('d', 'px', False)},{outside('o', 'd')}, two AS (SELECT * FROM px WHERE f = 2),{comp('k', 'two')},
far AS (SELECT k.leaf, k.x, k.y, k.c, min(abs(k.x - o.x) + abs(k.y - o.y)) AS d FROM k LEFT JOIN o ON o.leaf = k.leaf GROUP BY ALL)
SELECT leaf, x, y FROM px WHERE f <> 2 UNION ALL SELECT leaf, x, y FROM far JOIN (SELECT leaf, c FROM far GROUP BY leaf, c HAVING max(d) >= 3 OR max(d) IS NULL) USING (leaf, c)""", "px_margin_cleared",
)
on_leaves(
    lambda mask, c: at(raster.refine_silhouette(c["v"] / 100, mask & (c["f"] == 0), 0.5)), "x int, y int",
    f"""{WITH}, s AS (SELECT * FROM px WHERE v > 50 OR f = 0),{comp('k', 's', True)},
kept AS (SELECT k.* FROM k JOIN (SELECT DISTINCT leaf, c FROM k JOIN px USING (leaf, x, y) WHERE f = 0) USING (leaf, c)),{outside('o', 'kept')} {FILLED}""", "px_refine_silhouette",
)
on_leaves(
    lambda mask, _: at(raster.grow(mask, 2)), "x int, y int",
    f"{WITH} SELECT DISTINCT g.leaf, g.x, g.y FROM grid g JOIN px p ON p.leaf = g.leaf AND abs(p.x - g.x) + abs(p.y - g.y) <= 2", "px_grow",
)


def _reclaim(mask: np.ndarray, c: dict) -> dict[str, np.ndarray]:
    kerf = mask & (c["f"] == 1)
    pieces = raster.label(mask & ~kerf)[0]
    out = raster.reclaim(pieces, kerf)
    return at(mask & (out > 0), piece=out)


on_leaves(
    _reclaim, "x int, y int, piece int",
    f"""{WITH}, kerf AS (SELECT * FROM px WHERE f = 1), solid AS (SELECT * FROM px WHERE f <> 1),{comp('k', 'solid')},
piece AS (SELECT leaf, x, y, dense_rank() OVER (PARTITION BY leaf ORDER BY c) AS piece FROM k),
walk(leaf, x, y, d) AS (SELECT leaf, x, y, 0 FROM solid UNION SELECT q.leaf, q.x, q.y, d + 1 FROM walk r CROSS JOIN off JOIN kerf q ON q.leaf = r.leaf AND q.x = r.x + dx AND q.y = r.y + dy WHERE d < 60),
near AS (SELECT leaf, x, y, min(d) AS d FROM walk GROUP BY leaf, x, y),
flow(leaf, x, y, piece, d) AS (SELECT leaf, x, y, piece, 0 FROM piece UNION SELECT n.leaf, n.x, n.y, r.piece, n.d FROM flow r CROSS JOIN off JOIN near n ON n.leaf = r.leaf AND n.x = r.x + dx AND n.y = r.y + dy AND n.d = r.d + 1)
SELECT leaf, x, y, CAST(min(piece) AS INTEGER) AS piece FROM flow GROUP BY leaf, x, y""", "px_reclaim",
)


def _wand(mask: np.ndarray, c: dict) -> dict[str, np.ndarray]:
    lab = np.stack([mask * 100.0 + c["v"], c["f"] * 10.0, np.zeros(mask.shape)], axis=-1)
    y, x = np.unravel_index(int(np.argmax(lab[..., 0])), mask.shape)
    return at(raster.wand(lab, int(x), int(y), 30.0))


on_leaves(
    _wand, "x int, y int",
    f"""{WITH}, seed AS (SELECT * FROM px QUALIFY row_number() OVER (PARTITION BY leaf ORDER BY v DESC, y, x) = 1),
may AS (SELECT p.* FROM px p JOIN seed s USING (leaf) WHERE (p.v - s.v) ** 2 + (10 * (p.f - s.f)) ** 2 <= 900),
fill(leaf, x, y) AS (SELECT leaf, x, y FROM seed UNION SELECT q.leaf, q.x, q.y FROM fill r CROSS JOIN off JOIN may q ON q.leaf = r.leaf AND q.x = r.x + dx AND q.y = r.y + dy) FROM fill""", "px_wand",
)


# --- images ---


def _rgb(mask: np.ndarray, c: dict) -> np.ndarray:
    return np.stack([c["v"] * 2, c["f"] * 50, c["v"] * 7 % 256, mask * 255], axis=-1).astype(np.uint8)


def _tiles(mask: np.ndarray, c: dict) -> dict[str, np.ndarray]:
    """Each tile's fill; -1 where every pixel is valid, so that none is filled."""
    rows = [(x, y, int(v.sum()), *(rgb[~v][0] if (~v).any() else (-1, -1, -1))) for x, y, rgb, v in raster.tiles(_rgb(mask, c), 16)]
    return dict(zip(("ox", "oy", "n", "r", "g", "b"), np.array(rows, np.int64).T))


on_leaves(
    _tiles, "ox int, oy int, n int, r int, g int, b int",
    f"""{WITH}, t AS (SELECT leaf, CAST(ox * 16 AS INTEGER) AS ox, CAST(oy * 16 AS INTEGER) AS oy FROM leaves, (SELECT unnest(range(3)) AS ox), (SELECT unnest(range(2)) AS oy)),
s AS (SELECT t.leaf, ox, oy, CAST(count(p.v) AS INTEGER) AS n, coalesce(sum(v * 2), 0) AS r, coalesce(sum(f * 50), 0) AS g, coalesce(sum(v * 7 % 256), 0) AS b FROM t LEFT JOIN px p ON p.leaf = t.leaf AND p.x // 16 * 16 = ox AND p.y // 16 * 16 = oy GROUP BY ALL)
SELECT leaf, ox, oy, n, CASE WHEN n = 256 THEN -1 ELSE CAST(r // greatest(n, 1) AS INTEGER) END AS r, CASE WHEN n = 256 THEN -1 ELSE CAST(g // greatest(n, 1) AS INTEGER) END AS g, CASE WHEN n = 256 THEN -1 ELSE CAST(b // greatest(n, 1) AS INTEGER) END AS b FROM s""", "px_tiles_filled",
)
on_leaves(
    lambda mask, c: at(raster.restitch([(x, y, v) for x, y, _, v in raster.tiles(_rgb(mask, c), 16)], H, W)), "x int, y int",
    f"{WITH} SELECT leaf, x, y FROM px", "px_restitched",
)


def _half_alpha(mask: np.ndarray, c: dict) -> dict[str, np.ndarray]:
    rgba = _rgb(mask, c)
    rgba[..., 3] = np.where(mask, 55 + 2 * c["v"], 0)
    return at(raster.binarize_alpha(rgba, H // 2, W // 2)[..., 3] == 255)


on_leaves(
    _half_alpha, "x int, y int",
    f"{WITH} SELECT leaf, x // 2 AS x, y // 2 AS y FROM px GROUP BY leaf, x // 2, y // 2 HAVING sum(55 + 2 * v) / 4.0 > 128", "px_binarized_alpha",
)


def _cutout(mask: np.ndarray, c: dict) -> dict[str, np.ndarray]:
    soft = raster.bilinear(c["v"][::2, ::2].astype(float), H, W) / 100.0
    alpha, kept = raster.cutout(soft, _rgb(mask, c)[..., :3], chroma=60, interior=0.9)
    return at(soft >= 0.25, alpha=alpha, kept=kept)


#: The soft mask lies on every other pixel; between them it is bilinear.
SOFT = f"""
soft AS (SELECT g.leaf, g.x, g.y, sum(coalesce(p.v, 0) * wx * wy) / 100.0::DOUBLE AS s FROM grid g,
    (SELECT x AS gx, unnest([x // 2 - 1 + x % 2, x // 2 + x % 2]) AS sx, unnest([CASE WHEN x % 2 = 1 THEN 0.75 ELSE 0.25 END::DOUBLE, CASE WHEN x % 2 = 1 THEN 0.25 ELSE 0.75 END::DOUBLE]) AS wx FROM (SELECT unnest(range({W})) AS x)),
    (SELECT y AS gy, unnest([y // 2 - 1 + y % 2, y // 2 + y % 2]) AS sy, unnest([CASE WHEN y % 2 = 1 THEN 0.75 ELSE 0.25 END::DOUBLE, CASE WHEN y % 2 = 1 THEN 0.25 ELSE 0.75 END::DOUBLE]) AS wy FROM (SELECT unnest(range({H})) AS y))
    LEFT JOIN px p ON p.leaf = g.leaf AND p.x = 2 * least(greatest(sx, 0), {W // 2 - 1}) AND p.y = 2 * least(greatest(sy, 0), {H // 2 - 1})
    WHERE gx = g.x AND gy = g.y GROUP BY g.leaf, g.x, g.y),
c AS (SELECT s.leaf, s.x, s.y, s, coalesce(v * 2, 0) AS r, coalesce(f * 50, 0) AS g, coalesce(v * 7 % 256, 0) AS b FROM soft s LEFT JOIN px p ON p.leaf = s.leaf AND p.x = s.x AND p.y = s.y)"""
on_leaves(
    _cutout, "x int, y int, alpha int, kept boolean",
    f"""{WITH},{SOFT},
back AS (SELECT leaf, count(*) AS n, sum(r) // count(*) AS br, sum(g) // count(*) AS bg, sum(b) // count(*) AS bb FROM c WHERE s < 0.25 GROUP BY leaf),
a AS (SELECT c.*, CAST(floor(least(greatest((s - 0.5::DOUBLE) / 0.1::DOUBLE, 0), 1) * 255.0::DOUBLE + 0.5::DOUBLE) AS INTEGER) AS alpha,
  greatest(r, g, b) - least(r, g, b) < 60 OR coalesce(n > 16 AND (r - br) ** 2 + (g - bg) ** 2 + (b - bb) ** 2 < 45 * 45, false) AS alike FROM c LEFT JOIN back USING (leaf)),
solid AS (SELECT * FROM a WHERE NOT (s < 0.5 OR alike AND s < 0.9::DOUBLE AND alpha > 0)),{outside('o', 'solid')}
SELECT a.leaf, a.x, a.y, CASE WHEN o.leaf IS NOT NULL AND s < 0.9::DOUBLE THEN 0 ELSE alpha END AS alpha, s >= 0.5 AND NOT (o.leaf IS NOT NULL AND s < 0.9::DOUBLE) AS kept
FROM a LEFT JOIN o ON o.leaf = a.leaf AND o.x = a.x AND o.y = a.y WHERE s >= 0.25""", "px_cutout_alpha",
)


def _by_row(values: np.ndarray) -> dict[str, np.ndarray]:
    """One number of each row of an image that depends on all of it."""
    return {"y": np.arange(len(values)), "s": (values * (np.arange(values.shape[1]) + 1)).sum(axis=1).astype(float)}


def _rounded(found: DataFrame) -> DataFrame:
    return found.withColumn("s", F.round("s", 4))


ALL = "alln AS (SELECT leaf, x, y, coalesce(v, 0) AS v, coalesce(f, 0) AS f FROM grid LEFT JOIN px USING (leaf, x, y))"
on_leaves(
    lambda mask, c: _by_row(raster.bilinear(c["v"].astype(float), 2 * H, 2 * W)), "y int, s double",
    f"""{WITH}, {ALL},
oy AS (SELECT y, greatest(0, least({H - 1}, (y + 0.5) / 2 - 0.5)) AS p FROM (SELECT unnest(range({2 * H})) AS y)), ox AS (SELECT x, greatest(0, least({W - 1}, (x + 0.5) / 2 - 0.5)) AS p FROM (SELECT unnest(range({2 * W})) AS x)),
wy AS (SELECT y, floor(p) AS i, 1 - (p - floor(p)) AS w FROM oy UNION ALL SELECT y, least({H - 1}, floor(p) + 1), p - floor(p) FROM oy), wx AS (SELECT x, floor(p) AS i, 1 - (p - floor(p)) AS w FROM ox UNION ALL SELECT x, least({W - 1}, floor(p) + 1), p - floor(p) FROM ox)
SELECT leaf, CAST(wy.y AS INTEGER) AS y, round(sum(v * wy.w * wx.w * (wx.x + 1)), 4) AS s FROM alln a JOIN wy ON wy.i = a.y JOIN wx ON wx.i = a.x GROUP BY leaf, wy.y""", "px_bilinear", _rounded,
)
on_leaves(
    lambda mask, c: _by_row(raster.nearest(c["f"], 45, 60)), "y int, s double",
    f"""{WITH}, {ALL} SELECT leaf, CAST(oy AS INTEGER) AS y, round(CAST(sum(f * (ox + 1)) AS DOUBLE), 4) AS s FROM alln JOIN (SELECT unnest(range(45)) AS oy) ON oy * {H} // 45 = y JOIN (SELECT unnest(range(60)) AS ox) ON ox * {W} // 60 = x GROUP BY leaf, oy""", "px_nearest", _rounded,
)
on_leaves(
    lambda mask, c: at(mask, m=raster.box_mean(c["v"])), "x int, y int, m double",
    f"""{WITH}, {ALL} SELECT p.leaf, p.x, p.y, round(avg(a.v), 6) AS m FROM px p CROSS JOIN off JOIN alln a ON a.leaf = p.leaf AND a.x = p.x + dx AND a.y = p.y + dy GROUP BY p.leaf, p.x, p.y""", "px_box_mean",
    lambda found: found.withColumn("m", r6("m")),
)
_MEDIAN = "abs({0} - median({1}))"
on_leaves(
    lambda mask, c: at(mask, d=raster.residual(_rgb(mask, c)[..., :3], 3)), "x int, y int, d double",
    f"""{WITH}, {ALL}, w AS (SELECT p.leaf, p.x, p.y, p.v, p.f, a.v AS nv, a.f AS nf FROM px p CROSS JOIN off JOIN alln a ON a.leaf = p.leaf AND a.x = greatest(0, least({W - 1}, p.x + dx)) AND a.y = greatest(0, least({H - 1}, p.y + dy)))
SELECT leaf, x, y, CAST(greatest({_MEDIAN.format('v * 2', 'nv * 2')}, {_MEDIAN.format('f * 50', 'nf * 50')}, {_MEDIAN.format('v * 7 % 256', 'nv * 7 % 256')}) AS DOUBLE) AS d FROM w GROUP BY leaf, x, y, v, f""", "px_residual",
)
on_leaves(
    lambda mask, c: at(mask[:, :H], m=raster.turned(lambda im: im * (np.arange(H) ** 2)[:, None], c["v"][:, :H].astype(float))), "x int, y int, m double",
    f"{WITH} SELECT leaf, x, y, v * (y * y + ({H - 1} - x) ** 2 + ({H - 1} - y) ** 2 + x * x) / 4.0 AS m FROM px WHERE x < {H}", "px_turned",
)


def _letterbox(mask: np.ndarray, c: dict) -> dict[str, np.ndarray]:
    out, scale, x, y = raster.letterbox(_rgb(mask, c)[..., :3], 64)
    return {"scale": np.array([scale]), "left": np.array([x]), "top": np.array([y]), "pad": np.array([float(out[0, 0, 0])]), "side": np.array([out.shape[0]])}


on_leaves(
    _letterbox, "scale double, left int, top int, pad double, side int",
    f"{WITH} SELECT leaf, round(least(64 / {H}.0, 64 / {W}.0), 6) AS scale, 0 AS left, (64 - 48) // 2 AS top, round(114 / 255.0, 6) AS pad, 64 AS side FROM leaves", "px_letterbox",
    lambda found: found.withColumn("scale", r6("scale")).withColumn("pad", r6("pad")),
)


def _boxes(mask: np.ndarray, c: dict) -> dict[str, np.ndarray]:
    _, trimmed = raster.trim(_rgb(mask, c), 8)
    square = raster.centered_square(raster.box_of(mask), H, W)
    return dict(zip(("tx", "ty", "tw", "th", "sx", "sy", "side"), np.array([[*trimmed, *square[:3]]]).T))


on_leaves(
    _boxes, "tx int, ty int, tw int, th int, sx int, sy int, side int",
    f"""{WITH}, b AS (SELECT leaf, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h FROM px GROUP BY leaf), s AS (SELECT *, least(greatest(w, h), {H}) AS side FROM b)
SELECT leaf, greatest(0, x - 8) AS tx, greatest(0, y - 8) AS ty, least({W}, x + w + 8) - greatest(0, x - 8) AS tw, least({H}, y + h + 8) - greatest(0, y - 8) AS th,
  least(greatest(0, x + w // 2 - side // 2), {W} - side) AS sx, least(greatest(0, y + h // 2 - side // 2), {H} - side) AS sy, side FROM s""", "px_trim",
)


def _region_tiles(mask: np.ndarray, _: dict) -> dict[str, np.ndarray]:
    x, y, w, h = box = raster.box_of(mask)
    found = raster.region_tiles(box, mask[y : y + h, x : x + w], 16)
    return dict(zip("xywh", np.array(found, np.int64).reshape(-1, 4).T))


on_leaves(
    _region_tiles, "x int, y int, w int, h int",
    f"""{WITH}, b AS (SELECT leaf, min(x) AS x0, min(y) AS y0, max(x) - min(x) + 1 AS w0, max(y) - min(y) + 1 AS h0 FROM px GROUP BY leaf)
SELECT DISTINCT leaf, x0 + (x - x0) // 16 * 16 AS x, y0 + (y - y0) // 16 * 16 AS y, least(16, w0 - (x - x0) // 16 * 16) AS w, least(16, h0 - (y - y0) // 16 * 16) AS h FROM px JOIN b USING (leaf)""", "px_region_tiles",
)


# --- radial profiles, damage, augmentation ---


def _radial(mask: np.ndarray, _: dict) -> dict[str, np.ndarray]:
    r, hit, _ = raster.radial(mask)
    return {"ray": np.arange(len(r)), "r": r, "hit": hit}


on_leaves(
    _radial, "ray int, r double, hit boolean",
    f"""{WITH}, c AS (SELECT leaf, avg(x) AS cx, avg(y) AS cy FROM px GROUP BY leaf),
walk AS (SELECT leaf, ray, r * 0.5 AS r, CAST(round_even(cx + cos(2 * pi() * ray / 512) * (r * 0.5), 0) AS INTEGER) AS x, CAST(round_even(cy + sin(2 * pi() * ray / 512) * (r * 0.5), 0) AS INTEGER) AS y FROM c, (SELECT unnest(range(512)) AS ray), (SELECT unnest(range({int(2 * np.hypot(W, H))})) AS r))
SELECT w.leaf, CAST(ray AS INTEGER) AS ray, round(coalesce(max(r) FILTER (p.leaf IS NOT NULL), 0) / {np.hypot(W, H) / 2}, 6) AS r, bool_or(p.leaf IS NOT NULL) AS hit FROM walk w LEFT JOIN px p ON p.leaf = w.leaf AND p.x = w.x AND p.y = w.y GROUP BY w.leaf, ray""", "px_radial",
    lambda found: found.withColumn("r", r6("r")),
)


def _damage(mask: np.ndarray, _: dict) -> dict[str, np.ndarray]:
    """For each mode: pixels removed and added, and those that its rule does not allow."""
    rows = []
    for m in raster.MODES:
        left = raster.damage(mask, m, 0.25, 7)
        gone = mask & ~left
        # Grazing leaves no hole: what it took is connected to the outside, or to a hole that was there, by what it took.
        parts, n = raster.label(gone, eight=False)
        reached = np.bincount(parts[raster._margin(mask) & gone], minlength=n + 1)[1:] > 0
        loose = int(gone.sum()) - int(raster.sizes(parts, n)[1:][reached].sum()) if m in ("coastal", "clusters") else 0
        rows.append((m, int(gone.sum()), int((left & ~mask).sum()), loose))
    return {k: np.array(v, object) for k, v in zip(("mode", "removed", "added", "loose"), zip(*rows))}


on_leaves(
    _damage, "mode string, removed int, added int, loose int",
    f"""{WITH}, n AS (SELECT leaf, count(*) AS n, min(x) AS lo, max(x) AS hi FROM px GROUP BY leaf)
SELECT leaf, mode, CAST(CASE WHEN mode = 'apex' THEN least(floor(0.25 * n), (SELECT count(*) FROM px WHERE px.leaf = n.leaf AND (hi - x) / greatest(hi - lo, 1) < 0.25)) ELSE floor(0.25 * n) END AS INTEGER) AS removed, 0 AS added, 0 AS loose
FROM n, (SELECT unnest({list(raster.MODES)}) AS mode)""", "px_damage",
)
on_leaves(
    lambda mask, _: at(raster.sector(mask, 0.3, (0.6, 0.8), np.argwhere(mask).sum(axis=1) % 3 * 0.75)), "x int, y int",
    f"""{WITH}, p AS (SELECT *, (x - avg(x) OVER w) * 0.6::DOUBLE + (y - avg(y) OVER w) * 0.8::DOUBLE + (x + y) % 3 * 0.75::DOUBLE AS along, count(*) OVER w AS n FROM px WINDOW w AS (PARTITION BY leaf))
SELECT leaf, x, y FROM (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY along DESC, y, x) AS k FROM p) WHERE k > floor(n * 0.3::DOUBLE)""", "px_sector",
)
on_leaves(
    lambda mask, _: at(raster.strip(mask, 0.2, 0) | raster.strip(mask, 0.3, 3)), "x int, y int",
    f"""{WITH}, b AS (SELECT leaf, min(y) AS top, greatest(max(y) - min(y), 1) AS h, max(x) AS last, greatest(max(x) - min(x), 1) AS w FROM px GROUP BY leaf)
SELECT leaf, x, y FROM px JOIN b USING (leaf) WHERE NOT ((y - top) / h < 0.2::DOUBLE AND (last - x) / w < 0.3::DOUBLE)""", "px_strip",
)
on_leaves(
    lambda mask, _: at(raster.smooth_edges(mask, 1)), "x int, y int",
    f"""{WITH} SELECT g.leaf, g.x, g.y FROM grid g CROSS JOIN off LEFT JOIN px p ON p.leaf = g.leaf AND p.x = g.x + dx AND p.y = g.y + dy
WHERE g.x + dx BETWEEN 0 AND {W - 1} AND g.y + dy BETWEEN 0 AND {H - 1} GROUP BY g.leaf, g.x, g.y HAVING 2 * count(p.leaf) > count(*)""", "px_smoothed",
)


def _random_damage(mask: np.ndarray, _: dict) -> dict[str, np.ndarray]:
    left, mode = raster.random_damage(mask, {"coastal": 1, "snake": 2, "spots": 1}, 0.3, 0.3, 11, apex=1.0)
    return {"removed": np.array([int((mask & ~left).sum())]), "added": np.array([int((left & ~mask).sum())]), "known": np.array([mode in ("coastal", "snake", "spots")])}


on_leaves(_random_damage, "removed int, added int, known boolean", f"{WITH} SELECT leaf, CAST(floor(CAST(0.3 AS DOUBLE) * count(*)) AS INTEGER) AS removed, 0 AS added, true AS known FROM px GROUP BY leaf", "px_random_damage")


def _augment(mask: np.ndarray, c: dict) -> dict[str, np.ndarray]:
    """Both kinds of a change of scale, after a flip, with a pixel's value and whether the pair is still aligned."""
    out = []
    for kind, scale, offset in (("pad", 0.8, (0, 0)), ("crop", 1.2, (3, 5))):
        y, x, known = raster.source_pixels(H, W, flip=(False, True), scale=scale, offset=offset)
        shown, v = known & mask[y, x], c["v"][y, x]
        out.append({"kind": np.full(int(shown.sum()), kind, object), **at(shown, v=v)})
    return {k: np.concatenate([o[k] for o in out]) for k in ("kind", "x", "y", "v")}


on_leaves(
    _augment, "kind string, x int, y int, v int",
    f"""{WITH}, s AS (SELECT * FROM (VALUES ('pad', 0.8::DOUBLE, {-(W - 32) // 2}, {-(H - 24) // 2}, 32, 24), ('crop', 1.2::DOUBLE, 5, 3, 48, 36)) t(kind, scale, dx, dy, w, h))
SELECT g.leaf, kind, g.x, g.y, v FROM grid g, s JOIN px p ON p.leaf = g.leaf AND p.x = {W - 1} - least(CAST(floor((g.x + s.dx) / scale) AS INTEGER), {W - 1}) AND p.y = least(CAST(floor((g.y + s.dy) / scale) AS INTEGER), {H - 1})
WHERE g.x + s.dx BETWEEN 0 AND w - 1 AND g.y + s.dy BETWEEN 0 AND h - 1""", "px_augment",
)


# --- decisions ---


def _described(mask: np.ndarray, c: dict) -> dict[str, np.ndarray]:
    labels, n = raster.label(mask)
    x = np.broadcast_to(np.arange(W), mask.shape)
    rows = [(k, *decide.describe(labels == k, {"dino": c["v"], "residual": c["f"], "color": x}, c["v"], c["f"], 10.0, 1.0)) for k in range(1, n + 1)]
    return {"label": np.array([r[0] for r in rows], int), "v": [list(map(float, r[1:])) for r in rows]}


on_leaves(
    _described, "label int, v array<double>",
    f"""{WITH},{comp('k', 'px')}, l AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY leaf ORDER BY c) AS INTEGER) AS label FROM k JOIN px USING (leaf, x, y)),
g AS (SELECT leaf, label, avg(v) AS a0, avg(f) AS a1, avg(x) AS a2, count(*) AS n, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, (max(x) - min(x) + 1) * (max(y) - min(y) + 1) AS box FROM l GROUP BY leaf, label),
e AS (SELECT *, (xx + yy) / 2 AS half, sqrt(((xx - yy) / 2) ** 2 + xy ** 2) AS root FROM g), s AS (SELECT leaf, label, [a0, a1, a2, a0 - 10, a1 - 1, ln(1 + n), CASE WHEN n < 2 THEN 1 ELSE least(sqrt((half + root) / greatest(half - root, 1e-6)), 20) END, CASE WHEN n < 2 THEN 1 ELSE n / box END] AS v FROM e)
SELECT leaf, label, CAST(i AS INTEGER) AS i, round(x, 3) AS x FROM (SELECT leaf, label, unnest(range(8)) AS i, unnest(v) AS x FROM s)""", "px_descriptor",
    lambda found: found.select("leaf", "label", F.posexplode("v").alias("i", "x")).withColumn("x", F.round("x", 3)),
)


def _novel(mask: np.ndarray, c: dict) -> dict[str, np.ndarray]:
    kept = [m.mask() for m in decide.novel_only(mask, mask & (c["f"] == 1), c["v"].astype(float), 40.0)]
    return at(np.logical_or.reduce(kept) if kept else np.zeros(mask.shape, bool))


on_leaves(
    _novel, "x int, y int",
    f"""{WITH}, s AS (SELECT * FROM px WHERE f <> 1),{comp('k', 's')} SELECT leaf, x, y FROM k JOIN (SELECT leaf, c FROM k JOIN px USING (leaf, x, y) GROUP BY leaf, c HAVING avg(v) >= 60) USING (leaf, c)""", "px_novel_only",
)


def _found(masks: list[raster.Region], family: list[int]) -> dict[str, np.ndarray]:
    rows = [(int(m.at[0]), m.sum(), f) for m, f in zip(masks, family)]
    return dict(zip(("first", "n", "family"), np.array(rows, np.int64).reshape(-1, 3).T))


def _closed(mask: np.ndarray, c: dict) -> dict[str, np.ndarray]:
    found = decide.closed_set(c["v"] / 100, c["f"], mask, tau=0.6, grow=0.2, component=3, least=4)
    return _found([m for m, _ in found], [f for _, f in found])


on_leaves(
    _closed, "first int, n int, family int",
    f"""{WITH},{seeded('hy', 'v >= 20', 'v >= 60', 3)},{close('cl', 'hy')},{comp('k', 'cl')},
blob AS (SELECT k.leaf, k.c, k.x, k.y, coalesce(p.f, 0) AS f, count(*) OVER (PARTITION BY k.leaf, k.c) AS n FROM k LEFT JOIN px p ON p.leaf = k.leaf AND p.x = k.x AND p.y = k.y),
big AS (SELECT * FROM blob WHERE n >= 4),
fam AS (SELECT leaf, c, f, count(*) AS m, count(*) / sum(count(*)) OVER (PARTITION BY leaf, c) >= 0.15 AS much FROM big WHERE f <> 0 GROUP BY leaf, c, f),
many AS (SELECT leaf, c, count(*) FILTER (much) AS k FROM fam GROUP BY leaf, c),
sub AS (SELECT b.leaf, b.x, b.y, b.c, b.f FROM big b JOIN many m ON m.leaf = b.leaf AND m.c = b.c AND m.k >= 2 JOIN fam ON fam.leaf = b.leaf AND fam.c = b.c AND fam.f = b.f AND much),
sr(leaf, a, f, c, x, y) AS (SELECT leaf, y * {W} + x, f, c, x, y FROM sub UNION SELECT r.leaf, r.a, r.f, r.c, q.x, q.y FROM sr r CROSS JOIN off JOIN sub q ON q.leaf = r.leaf AND q.f = r.f AND q.c = r.c AND q.x = r.x + dx AND q.y = r.y + dy),
sc AS (SELECT leaf, f, x, y, min(a) AS first FROM sr GROUP BY leaf, f, x, y)
SELECT leaf, CAST(first AS INTEGER) AS first, CAST(count(*) AS INTEGER) AS n, f AS family FROM sc GROUP BY leaf, first, f HAVING count(*) >= 3
UNION ALL SELECT b.leaf, CAST(b.c AS INTEGER), CAST(count(*) AS INTEGER), coalesce((SELECT arg_min(f, (-m, f)) FROM fam WHERE fam.leaf = b.leaf AND fam.c = b.c), 0) FROM big b LEFT JOIN many m ON m.leaf = b.leaf AND m.c = b.c WHERE coalesce(m.k, 0) < 2 GROUP BY b.leaf, b.c""", "px_closed_set",
)


def _open(mask: np.ndarray, c: dict) -> dict[str, np.ndarray]:
    x = np.broadcast_to(np.arange(W), mask.shape).astype(float)
    meta = {"thresholds": {"dino": 2.0, "color": 2.0, "residual": 2.0}, "floors": {"dino": 3.0, "color": 3.0, "residual": 3.0}, "dino_threshold": 96.0}
    found, _ = decide.open_set(c["v"].astype(float), c["f"] * 10.0, x, (c["v"] * 7 % 50).astype(float), mask, meta, cap=2)
    return _found(found, [0] * len(found))


def _z(name: str, value: str) -> str:
    """CTEs of a channel's one-sided robust z, and of its hysteresis at 2 with the ratio in its name's place."""
    ratio = {"dino": 0.4, "color": 0.9, "residual": 0.6}[name]
    return f"""
{name}_m AS (SELECT leaf, median({value}) AS med FROM q GROUP BY leaf), {name}_s AS (SELECT leaf, greatest(1.4826 * median(med - {value}), 3.0) + 1e-6 AS s FROM q JOIN {name}_m USING (leaf) WHERE {value} <= med GROUP BY leaf),
{name}_z AS (SELECT q.leaf, q.x, q.y, ({value} - med) / s AS z FROM q JOIN {name}_m USING (leaf) JOIN {name}_s USING (leaf)), {name}_l AS (SELECT * FROM {name}_z WHERE z >= {2 * ratio}),{comp(name + '_c', name + '_l')},
{name} AS (SELECT c.leaf, c.x, c.y, c.c FROM {name}_c c JOIN (SELECT leaf, c FROM {name}_c JOIN {name}_l USING (leaf, x, y) GROUP BY leaf, c HAVING max(z) >= 2) USING (leaf, c))"""


on_leaves(
    _open, "first int, n int, family int",
    f"""{WITH}, ab AS (SELECT leaf, median(f * 10) AS ma, median(x) AS mb FROM px GROUP BY leaf),
q AS (SELECT px.*, CAST(v AS DOUBLE) AS dino0, sqrt((f * 10 - ma) ** 2 + (x - mb) ** 2) AS color0, CAST(v * 7 % 50 AS DOUBLE) AS residual0 FROM px JOIN ab USING (leaf)),
{_z('dino', 'dino0')},{_z('color', 'color0')},{_z('residual', 'residual0')},
support AS (SELECT leaf, x, y FROM dino UNION SELECT leaf, x, y FROM color),
gate AS (SELECT leaf, c FROM residual LEFT JOIN (SELECT *, true AS s FROM support) USING (leaf, x, y) GROUP BY leaf, c HAVING count(*) <= 2 OR bool_or(coalesce(s, false))),
mask AS (SELECT leaf, x, y FROM support UNION SELECT leaf, x, y FROM residual JOIN gate USING (leaf, c) UNION SELECT leaf, x, y FROM px WHERE v >= 96),{close('cl', 'mask')},{comp('k', 'cl')}
SELECT leaf, CAST(c AS INTEGER) AS first, CAST(count(*) AS INTEGER) AS n, 0 AS family FROM k GROUP BY leaf, c HAVING count(*) >= 3""", "px_open_set",
)


@query(f"{WITH} SELECT leaf, CAST(x // 8 AS BIGINT) AS tx, CAST(y // 8 AS BIGINT) AS ty, count(*) AS n FROM px GROUP BY leaf, x // 8, y // 8 HAVING count(*) >= 4")
def px_worth_a_look(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.worth_a_look(pixels(spark, sf_dir), 8, 4)


@query(f"{WITH} SELECT leaf, f, round(avg(v), 6) AS mean FROM px GROUP BY leaf, f HAVING avg(v) >= 1.5 * 30")
def px_novel_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.novel_gate(pixels(spark, sf_dir), ["leaf", "f"], "v", 30.0).withColumn("mean", r6("mean"))


# --- outlines ---

SIZES = "SELECT DISTINCT p_size AS w, p_size % 13 + 5 AS h FROM part"


def _rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pixels of a rectangle for each distinct size of parts."""
    sizes = table(spark, sf_dir, "part").select(F.col("p_size").alias("w"), (F.col("p_size") % 13 + 5).alias("h")).distinct()
    return sizes.select((F.col("w") * 100 + F.col("h")).alias("leaf"), "h", F.explode(F.sequence(F.lit(2), (F.col("w") + 1).cast("int"))).alias("x")).select("leaf", "x", F.explode(F.sequence(F.lit(3), (F.col("h") + 2).cast("int"))).alias("y"))


def _area(ring: np.ndarray) -> float:
    n = np.roll(ring, -1, axis=0)
    return float((ring[:, 0] * n[:, 1] - n[:, 0] * ring[:, 1]).sum() / 2)


def _outline(mask: np.ndarray, _: dict) -> dict[str, np.ndarray]:
    ring = raster.polygon(mask)
    if ring is None:
        return {k: np.zeros(0) for k in ("corners", "area", "steps", "smooth")}
    (traced,) = raster.trace(mask)
    return {"corners": np.array([len(ring)]), "area": np.array([_area(ring)]), "steps": np.array([len(traced)]), "smooth": np.array([_area(raster.smooth(traced))])}


@query(f"SELECT w * 100 + h AS leaf, 4 AS corners, CAST(w * h AS DOUBLE) AS area, CAST(2 * (w + h) AS INTEGER) AS steps, CAST(w * h - 0.125 AS DOUBLE) AS smooth FROM ({SIZES}) WHERE w * h >= 16")
def px_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return map_masks(_rectangles(spark, sf_dir), _outline, "corners int, area double, steps int, smooth double", 24, 56).withColumn("leaf", F.col("leaf").cast("int"))


RING = [(0.0, 0.0), (6.0, 1.0), (9.0, 7.0), (3.0, 4.5), (-2.0, 8.0)]


def px_rasterize(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType

    from verdure.kernels.apply import map_leaves

    def kernel(row: dict) -> list[dict]:
        ring = np.array(RING) * 3 + [row["s_suppkey"] % 10 + 7.3, row["s_suppkey"] % 7 + 2.1]
        y, x = np.nonzero(raster.rasterize(ring, H, W))
        return [{"s_suppkey": row["s_suppkey"], "n": len(x), "sx": float(x.sum()), "sy": float(y.sum())}]

    schema = StructType([StructField("s_suppkey", LongType()), StructField("n", LongType()), StructField("sx", DoubleType()), StructField("sy", DoubleType())])
    return map_leaves(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("s_suppkey")), kernel, schema).drop("error")


query(f"""
WITH e AS (SELECT s_suppkey, unnest({[x for x, _ in RING]}) * 3 + s_suppkey % 10 + 7.3 AS ax, unnest({[y for _, y in RING]}) * 3 + s_suppkey % 7 + 2.1 AS ay,
  unnest({[x for x, _ in RING[1:] + RING[:1]]}) * 3 + s_suppkey % 10 + 7.3 AS bx, unnest({[y for _, y in RING[1:] + RING[:1]]}) * 3 + s_suppkey % 7 + 2.1 AS bys FROM supplier),
p AS (SELECT s_suppkey, x, y, count(*) AS n FROM e, (SELECT unnest(range({W})) AS x), (SELECT unnest(range({H})) AS y) WHERE (ay > y + 0.5) <> (bys > y + 0.5) AND ax + (y + 0.5 - ay) * (bx - ax) / (bys - ay) > x + 0.5 GROUP BY ALL)
SELECT CAST(s_suppkey AS BIGINT) AS s_suppkey, count(p.x) AS n, CAST(coalesce(sum(p.x), 0) AS DOUBLE) AS sx, CAST(coalesce(sum(p.y), 0) AS DOUBLE) AS sy FROM supplier LEFT JOIN (FROM p WHERE n % 2 = 1) p USING (s_suppkey) GROUP BY s_suppkey""")(px_rasterize)
