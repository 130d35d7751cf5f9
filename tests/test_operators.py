import numpy as np
import pytest
from pyspark.sql import functions as F

from verdure.functions import scalars
from verdure.operators import cluster, evaluation, geometry, head, neighbors, regions, sampling, state, stats


def test_knn_ties(spark):
    bank = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [5.0, 5.0])], "row_id long, v array<float>")
    q = spark.createDataFrame([(0, [0.0, 0.0]), (1, [5.0, 5.0])], "q_id long, v array<float>")
    one = {r.q_id: r.score for r in neighbors.knn_mean(q, bank, 1).collect()}
    assert one == {0: 0.0, 1: 0.0}
    assert {r.q_id: r.score for r in neighbors.knn_mean(q, bank, 2).collect()}[0] == 0.5
    twice = bank.union(spark.createDataFrame([(4, [0.0, 0.0])], bank.schema))
    assert {r.q_id: r.score for r in neighbors.knn_mean(q, twice, 2).collect()}[0] == 0.0
    assert {r.q_id: r.score for r in neighbors.knn_mean(q, twice, 2, "distinct").collect()}[0] == 0.5


def test_knn_in_blocks_equals_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    bank = spark.createDataFrame(rows, "row_id long, v array<double>")
    q = bank.withColumnRenamed("row_id", "q_id").where("q_id < 9")
    for ties in ("rows", "distinct"):
        want = {r.q_id: r.score for r in neighbors.knn_mean(q, bank, 3, ties).collect()}
        monkeypatch.setattr(neighbors, "BROADCAST", 0)
        monkeypatch.setattr(neighbors, "BLOCK", 16)
        got = {r.q_id: r.score for r in neighbors.knn_mean(q, bank, 3, ties).collect()}
        monkeypatch.undo()
        assert got == pytest.approx(want)


def test_dbscan_two_blobs_any_partitioning(spark):
    rows = [(i, [0.05 * (i % 30) + 10.0 * (i // 30), 0.0]) for i in range(60)] + [(99, [50.0, 50.0])]
    p = spark.createDataFrame(rows, "point_id long, v array<double>")
    first = {r.point_id: r.label for r in cluster.dbscan(p, 0.5, 5).collect()}
    assert first[0] == 0 and first[59] == 1 and first[99] == -1
    assert {r.point_id: r.label for r in cluster.dbscan(p.repartition(7).orderBy(F.desc("point_id")), 0.5, 5).collect()} == first


def test_cuts(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(size=(10, 4)), rng.normal(size=(2, 4)) + [[90, 0, 0, 0], [0, 90, 0, 0]]])
    merges = cluster.linkage(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "point_id long, v array<double>")).cache()
    label = {r.point: r.label for r in cluster.cut_k(merges, 12, 3, 2).collect()}
    assert {label[i] for i in range(10)} == {0} and label[10] == label[11] == -1
    assert 3 in [r.k for r in cluster.suggest_k(merges, 12).collect()] or 2 in [r.k for r in cluster.suggest_k(merges, 12).collect()]
    whole = {r.point: r.label for r in cluster.adaptive_cut(merges, 12, 1e9).collect()}
    assert set(whole.values()) == {0} and len(whole) == 12
    forest = {r.point: r.label for r in cluster.adaptive_cut(merges.where("step < 3"), 12, 1e9).collect()}
    assert len(forest) == 12 and len(set(forest.values())) == 9


@pytest.mark.parametrize("listed", [10**6, 0])
def test_linkage_in_rounds(spark, monkeypatch, listed):
    """More points than one task takes, with copies, ties and a null, give the merges of one task."""
    from verdure.operators import linkage

    for name, value in {"ONE_TASK": 12, "NEAREST": 4, "MORE": 4, "LISTED": listed, "TILE": 30, "TILES": 3, "CELLS": 200, "EXACT": 20}.items():
        monkeypatch.setattr(linkage, name, value)
    v = np.round(np.random.default_rng(6).normal(size=(90, 2)), 1)
    v[60:75] = v[:15]
    rows = [(3 * i, x.tolist()) for i, x in enumerate(v)] + [(1, None)]
    got = [(r.i, r.j, r.dist) for r in sorted(cluster.linkage(spark.createDataFrame(rows, "point_id long, v array<double>")).collect())]
    assert got == cluster.complete_linkage(v) and len(got) == 89


@pytest.mark.parametrize("single,bound", [(1_024, 20), (4, 0), (1_024, 10**6)])
def test_nearest_clusters_are_found_from_means(monkeypatch, single, bound):
    """The lists are those of all distances, while few pairs of points are measured; with any way to narrow them."""
    from verdure.operators import linkage

    monkeypatch.setattr(linkage, "SINGLE", single)
    monkeypatch.setattr(linkage, "BOUND", bound)
    monkeypatch.setattr(linkage, "CELLS", 20_000)
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 12, 300)
    v = (np.repeat(rng.normal(size=(300, 16)), sizes, axis=0) + 0.2 * rng.normal(size=(sizes.sum(), 16)) + 50).astype(np.float32)
    at = np.cumsum(sizes) - sizes
    d = np.sqrt(((v[:, None].astype(float) - v) ** 2).sum(2))
    want = np.maximum.reduceat(np.maximum.reduceat(d, at, axis=0), at, axis=1)
    np.fill_diagonal(want, np.inf)
    measured, exact = [], linkage._exact
    monkeypatch.setattr(linkage, "_exact", lambda x, i, y, j: measured.append(int((x.sizes[i] * y.sizes[j]).sum())) or exact(x, i, y, j))
    every = linkage._Clusters(np.arange(300, dtype=np.int32), sizes, v)
    every.scaled(v.mean(axis=0), 3.0)
    near = linkage._Nearest(every, 4)
    for lo in range(0, 300, 60):
        piece = linkage._Clusters(every.ids[lo : lo + 60], sizes[lo : lo + 60], v[at[lo] : at[lo + 59] + sizes[lo + 59]])
        piece.scaled(every.base, every.scale)
        near.meet(piece)
    assert (near.b == np.argsort(want, axis=1)[:, :4]).all() and np.allclose(near.d, np.sort(want, axis=1)[:, :4])
    assert sum(measured) < 0.15 * len(v) ** 2, sum(measured) / len(v) ** 2
    found = {(int(a), int(b)): float(x) for a, bs, ds in linkage._measured(every, every) for i, b_, d_ in zip(a, bs, ds) for a, b, x in zip([i] * len(b_), b_, d_)}
    assert len(found) == 300 * 299 // 2 and all(x == np.float32(want[k]) for k, x in found.items())


def test_upsert_and_retract(spark):
    rows = [(f"region_{x}", "f") for x in ("46.png", "46_1.png", "463.png")]
    labels = spark.createDataFrame(rows, "crop string, family string")
    new = spark.createDataFrame([("region_46.png", "g")], labels.schema)
    assert sorted((r.crop, r.family) for r in state.upsert_labels(labels, new).collect()) == [("region_46.png", "g"), ("region_463.png", "f")]
    assert sorted(r.crop for r in state.retract_labels(labels, new).collect()) == ["region_463.png", "region_46_1.png"]
    negatives = spark.createDataFrame([("tile_3_hardneg_1.png", "rejected"), ("tile_3_hardneg_2.png", "rejected"), ("region_4_x0.png", "f"), ("region_4_x1.png", "f")], labels.schema)
    gone = negatives.where("crop in ('tile_3_hardneg_1.png', 'region_4_x0.png')")
    assert sorted(r.crop for r in state.retract_labels(negatives, gone).collect()) == ["region_4_x1.png", "tile_3_hardneg_2.png"]


def test_dendrogram_against_a_replay(spark):
    import numpy as np

    v = np.random.default_rng(4).normal(size=(40, 3))
    merges = cluster.linkage(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "point_id long, v array<double>")).cache()
    node, want = list(range(40)), {}
    for r in sorted(merges.collect()):
        want[r.step + 40] = (node[r.i], node[r.j])
        node[r.i] = r.step + 40
    assert {r.id: (r.left, r.right) for r in cluster.dendrogram(merges, 40).collect()} == want


def test_counted_median(spark):
    import statistics

    from verdure.operators import stats

    rows = [("a", x) for x in (3.0, 1.0, 2.0, 2.0)] + [("b", 5.0), ("b", None), ("c", None), ("d", 1.0), ("d", 4.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: r.m for r in stats.counted_median(df, ["k"], "v", "m").collect()}
    assert got == {k: statistics.median([x for j, x in rows if j == k and x is not None]) for k in "abd"}
    assert {r.k: r.med for r in stats.robust_scale(df, ["k"], "v").collect()} == {**got, "c": None}


def test_totals_without_noise(spark):
    rows = spark.createDataFrame([(1, -1, 4.0), (1, 0, 2.0), (1, 0, 3.0), (2, -1, 1.0)], "leaf int, label int, area double")
    leaves = spark.createDataFrame([(1, 10), (2, 10), (3, 0)], "leaf int, leaf_px int")
    got = {r.leaf: r for r in regions.wide_export(rows, leaves, [(0, "f")], noise=-1).collect()}
    assert [(got[k].total_n, got[k].total_area, got[k].f_n, got[k].f_mean) for k in (1, 2, 3)] == [(2, 5.0, 2, 2.5), (0, 0.0, 0, None), (0, 0.0, 0, None)]


def test_undo_log(spark):
    rows = [(1, "a", "paint", None, "x"), (2, "a", "paint", None, "y"), (3, "a", "undo", 2, None), (4, "b", "paint", None, "z")]
    got = state.fold_edits(spark.createDataFrame(rows, "seq int, key string, kind string, undoes int, after string"), "key", "seq")
    assert {r.key: r.after for r in got.collect()} == {"a": "x", "b": "z"}


def test_water_fill():
    assert sampling.water_fill({"a": 2, "b": 100, "c": 100}, 52) == {"a": 2, "b": 25, "c": 25}
    assert sum(sampling.water_fill({1: 5, 2: 1}, 100).values()) == 6


def test_fnv_and_text(spark):
    def fnv(s):
        h = 0xCBF29CE484222325
        for b in s.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h

    names = ["", "a", "leaf_01.png", "é/ß.tif", "x" * 300]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [int(r[0]) for r in df.select(scalars.fnv1a(F.col("n"))).collect()] == [fnv(n) for n in names]
    cases = [("Run pipeline", "rp", 2 * 1 + 3 + 3), ("abc", "ab", 1 + 3 + 1 + 4), ("abc", "x", None), ("abc", "", None)]
    got = spark.createDataFrame([(a, b) for a, b, _ in cases], "t string, q string").select(scalars.fuzzy_score(F.col("t"), F.col("q")).alias("s")).collect()
    assert [r.s for r in got] == [8 * 100 - 12, 9 * 100 - 3, None, 0]
    slug = spark.createDataFrame([("a, b-c",), ("--",), (None,)], "n string").select(scalars.slug(F.col("n")).alias("s")).collect()
    assert [r.s for r in slug] == ["a_b_c", "family", "family"]


def test_metrics_on_empty_zone(spark):
    df = spark.createDataFrame([(1, True, False)], "s int, p boolean, t boolean")
    m = evaluation.confusion(df, ["s"], F.col("p"), F.col("t"), F.lit(False)).first()
    assert (m.iou, m.dice, m.precision, m.recall, m.pixel_acc) == (0, 0, 0, 0, 0)
    with pytest.raises(Exception, match="no valid rows"):
        evaluation.false_positive_rate(df, F.col("p"), F.lit(False)).collect()


def test_robust_z_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), ("b", None)], "k string, v double")
    got = stats.robust_z(df, ["k"], "v", 0.1).collect()
    assert len(got) == 4 and sorted(r.z for r in got if r.v is None) == [0.0, 0.0]


def test_touching_and_tiles(spark):
    runs = spark.createDataFrame([(1, 1, 0, 0, 3), (1, 2, 1, 4, 5), (1, 3, 3, 0, 9), (2, 4, 1, 4, 5)], "leaf int, region int, y int, x0 int, x1 int")
    assert [(r.a, r.b) for r in geometry.touching(runs, ["leaf"], "region").collect()] == [(1, 2)]
    t = geometry.tiles(spark.createDataFrame([(1, 3, 3)], "leaf int, w int, h int"), 2).collect()
    assert sorted((r.ox, r.oy) for r in t) == [(0, 0), (0, 2), (2, 0), (2, 2)]


def test_retrain_learns_and_freezes(spark):
    rng = np.random.default_rng(4)
    rows = [(c, 1.0, (rng.normal(size=2) + [6 * c, 0]).tolist()) for c in (0, 1) for _ in range(40)]
    df = spark.createDataFrame(rows, "class int, weight double, x array<double>").coalesce(2).cache()
    start = np.zeros((3, 3))
    start[2] = (9, 9, 9)
    w, losses = head.retrain(df, [0, 1, 2], start, crops=80)
    assert losses[-1] < losses[0] and (w[2] == 9).all()
    w2, _ = head.retrain(df, [0, 1], np.zeros((2, 3)), crops=80)
    x = np.array([r[2] for r in rows])
    assert ((x @ w2[:, :2].T + w2[:, 2]).argmax(1) == [r[0] for r in rows]).mean() > 0.97


def test_wide_export_of_empty_leaf(spark):
    leaves = spark.createDataFrame([(1, 10), (2, 10)], "leaf int, leaf_px int")
    found = spark.createDataFrame([(1, -1, 4.0), (1, 0, 2.0)], "leaf int, label int, area double")
    got = {r.leaf: r for r in regions.wide_export(found, leaves, [(-1, "noise"), (0, "a_b")], noise=-1).collect()}
    assert got[1].total_n == 1 and got[1].noise_area == 4.0 and got[2].total_n == 0 and got[2].a_b_mean is None


def test_next_unreviewed_in_a_large_table(spark, tmp_path):
    from verdure.plans import catalog

    def first(name, keys):
        spark.createDataFrame(keys, "o_orderkey long, o_orderstatus string").write.parquet(f"{tmp_path}/{name}/orders.parquet")
        return [r.o_orderkey for r in catalog.unreviewed_next(spark, f"{tmp_path}/{name}").collect()]

    assert first("on", [(3, "O"), (700, "P"), (703, "O"), (15_701, "O"), (45_700, "O")]) == [703]
    assert first("around", [(3, "O"), (5, "O"), (699, "O"), (700, "F")]) == [3]


def test_elbow_of_vectors_of_any_scale(spark, tmp_path, monkeypatch):
    from verdure.plans import catalog

    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    far = e.withColumn("embedding", F.transform("embedding", lambda x: (x * 16).cast("float")))
    far.write.parquet(f"{tmp_path}/embeddings.parquet")
    want = catalog.eps_elbow(spark, "/root/testdata/sf0.001").first().eps
    assert catalog.eps_elbow(spark, str(tmp_path)).first().eps == pytest.approx(16 * want, abs=1e-5)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(50, 3)) * 40
    v[7] = v[3]
    monkeypatch.setattr(neighbors, "BLOCK", 16)
    got = {r.point_id: r.d for r in neighbors.kth_distance(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "point_id long, v array<double>"), 5).collect()}
    every = np.sort(np.sqrt(((v[:, None] - v) ** 2).sum(2)), axis=1)
    assert len(got) == 50 and all(got[i] == pytest.approx(every[i][5]) for i in range(50))


def test_registered_heads_are_trained_to_the_end(spark, tmp_path):
    from verdure.plans import catalog

    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    far = e.withColumn("embedding", F.transform("embedding", lambda x: (x * 16).cast("float")))
    far.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = spark.read.parquet(f"{tmp_path}/embeddings.parquet").select(F.col("label").alias("class"), F.lit(1.0).alias("weight"), F.col("embedding").cast("array<double>").alias("x"))
    _, losses = head.retrain(rows, list(range(10)), np.zeros((10, 65)), iterations=2_000)
    assert 11 < len(losses) < 2_000 and losses[10] > losses[-1] * (1 + 1e-6)
    assert catalog.ml_head_retrain(spark, str(tmp_path)).first().loss == pytest.approx(losses[-1], rel=1e-7)
    assert len(catalog.domain_projection(spark, "/root/testdata/sf0.001").first().v) == 64


def test_principal_components(spark):
    from verdure.operators import stats

    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 5)) * [5, 1, 3, 0.1, 2] @ np.linalg.qr(rng.normal(size=(5, 5)))[0] + 7
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    values, directions, mean = stats.principal(df, "v", 2)
    c = np.cov(x.T, bias=True)
    assert np.allclose(values, np.sort(np.linalg.eigvalsh(c))[::-1][:2]) and np.allclose(mean, x.mean(0))
    assert np.allclose(np.array(directions) @ np.array(directions).T, np.eye(2)) and np.allclose(c @ np.array(directions).T, np.array(directions).T * values)
    got = {r.id: r.projected for r in stats.project(df, "v", directions, mean).collect()}
    assert np.allclose([got[i] for i in range(300)], (x - x.mean(0)) @ np.array(directions).T)


def test_numbered_groups(spark):
    import random

    from verdure.operators.ranking import numbered

    rng = random.Random(2)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), rng.randint(0, 50), i) for i in range(800)]
    df = spark.createDataFrame(rows, "k string, v int, id int").repartition(5)
    want = {}
    for k in {r[0] for r in rows}:
        for i, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2]))):
            want[r[2]] = i
    got = numbered(df, ["k"], [F.desc("v"), F.col("id")])
    assert got.columns == ["k", "v", "id", "_i"] and {r.id: r._i for r in got.collect()} == want
    assert sorted(r._i for r in numbered(df, [], [F.col("id")]).collect()) == list(range(800))
    assert numbered(df.limit(0), ["k"], [F.col("id")]).collect() == []


def test_eps_pairs_by_strips(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK", 40)
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(150, 3)) * [8, 1, 1], np.zeros((60, 3)), [[0.5, 0, 0], [1.0, 0, 0]]])
    for eps in (0.5, 1.3, 100.0):
        pairs = neighbors.eps_pairs(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "point_id long, v array<double>"), eps).collect()
        d2 = ((x[:, None] - x[None]) ** 2).sum(2)
        want = {(i, j) for i, j in zip(*np.nonzero(d2 <= eps * eps))}
        assert len(pairs) == len(want) and {(r.a, r.b) for r in pairs} == want


def test_smallest_hit_joins_places_and_boxes_once(spark):
    """Points at one place and equal boxes make no pairs of rows: their join would have 4 million."""
    points = spark.range(2000).selectExpr("id as point", "cast(id % 3 * 10 as int) as px", "5 as py")
    boxes = spark.range(2000).selectExpr("id + 7 as region", "cast(id % 2 * 10 as int) as x", "0 as y", "12 as w", "cast(40 - id % 2 as int) as h")
    found = regions.smallest_hit(points, boxes, "point", "region", 8)
    got = {(r.px, r.region) for r in found.join(points, "point").select("px", "region").distinct().collect()}
    assert got == {(0, 7), (10, 8), (20, 8)} and found.count() == 2000
    # Boxes, places and hits are aggregated each.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 3


def test_touch_components_without_pairs(spark, monkeypatch):
    """Equal to components of all touching pairs, also for regions of several runs; a stack of 3,000 runs on one place makes no pairs."""
    from verdure.operators.graph import components

    rng = np.random.default_rng(4)
    rows = [(int(leaf), int(r), int(y), int(x), int(x + n)) for leaf, r, y, x, n in zip(rng.integers(0, 3, 250), rng.integers(0, 120, 250), rng.integers(0, 12, 250), rng.integers(0, 60, 250), rng.integers(0, 4, 250))]
    runs = spark.createDataFrame([(r % 3, r, y, a, b) for _, r, y, a, b in rows], "leaf int, region int, y int, x0 int, x1 int")
    nodes, pairs = runs.selectExpr("region as node"), geometry.touching(runs, ["leaf"], "region")
    want = {r.node: r.component for r in components(nodes, pairs).collect()}
    monkeypatch.setattr(geometry, "touching", None)
    assert {r.node: r.component for r in geometry.touch_components(runs, ["leaf"], "region").collect()} == want and len(set(want.values())) > 5
    stack = spark.range(5, 3005).selectExpr("1 as leaf", "id as region", "id % 2 as y", "id % 3 as x0", "id % 3 + 1 as x1")
    assert {(r.component) for r in geometry.touch_components(stack, ["leaf"], "region").collect()} == {5}


def test_group_values_go_to_every_task(spark):
    """A few classes' medians or counts are broadcast, whatever the session's threshold: else one task gets a class."""
    from verdure.plans import catalog, rows

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for q in (catalog.upper_median_atypicality, rows.least_typical_first, catalog.stratified_stride_sample):
            if q is rows.least_typical_first:
                # Its join goes into a table on the way to the places: what that table's rows are dealt by is seen before.
                seen = []
                kept = rows._placed
                rows._placed = lambda df, columns, order: seen.append(df) or kept(df, columns, order)
                try:
                    q(spark, "/root/testdata/sf0.001")
                finally:
                    rows._placed = kept
                found = seen[0]
            else:
                found = q(spark, "/root/testdata/sf0.001")
            plan = found._jdf.queryExecution().executedPlan().toString()
            on_label = [line for line in plan.splitlines() if "Join" in line and "l_returnflag" in line]
            assert on_label and "BroadcastHashJoin" in on_label[0], plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    empty = sampling.stratified_stride(spark.range(9).selectExpr("id", "id % 2 as k"), "k", ["id"], {})
    assert empty.count() == 0
