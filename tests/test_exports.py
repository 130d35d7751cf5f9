import numpy as np
from pyspark.sql import functions as F

from verdure.kernels.apply import map_masks
from verdure.operators import evaluation
from verdure.sources import exports, files, images


def tables(spark):
    leaves = spark.createDataFrame([(0, "d/photo.one.jpg", 100, 20, 50), (1, "d/photo.one.jpg", 0, 5, 0), (2, "d/b.jpg", 10, 0, 5)], "leaf int, leaf_src string, leaf_px int, recon_area long, recon_whole long")
    for c in exports.MORPHOLOGY:
        leaves = leaves.withColumn(c, F.lit(None).cast("double"))
    regions = spark.createDataFrame([(0, 0, 0, 10), (0, 1, -1, 5), (1, 2, 0, 4), (7, 3, 9, 1)], "leaf int, region int, cluster_id int, area_px int")
    for c in "xywh":
        regions = regions.withColumn(f"bbox_{c}", F.lit(1))
    return regions, leaves, spark.createDataFrame([(0, 'spots, "big"')], "cluster_id int, name string")


def test_long_table(spark):
    out = exports.long_table(*tables(spark))
    assert len(out.columns) == 31 and out.columns[:5] == ["leaf", "image", "leaf_in_image", "leaf_file", "leaf_src"]
    got = {r.region: r for r in out.collect()}
    assert (got[0].image, got[0].leaf_in_image, got[0].leaf_file, got[0].family, got[0].pct_leaf, got[0].recon_pct, got[0].lost_tissue_pct, got[0].crop_file) == ("photo.one", 1, "photo.one_leaf00", 'spots, "big"', 10.0, 20.0, 40.0, "0_0.png")
    assert (got[1].family, got[2].leaf_in_image, got[2].leaf_file, got[2].pct_leaf, got[2].recon_pct) == ("Cluster -1", 2, "photo.one_leaf01", 400.0, None)
    assert (got[3].image, got[3].pct_leaf, got[3].lost_tissue_pct) == (None, 100.0, None)


def test_wide_table(spark):
    regions, leaves, _ = tables(spark)
    rejected = spark.createDataFrame([(2,)], "leaf int")
    out = exports.wide_table(regions, leaves, rejected, [(3, "z"), (0, "spots")])
    assert len(out.columns) == 24 + 8 and out.columns[24:28] == ["spots_count", "spots_area_px", "spots_avg_area_px", "spots_pct_leaf"]
    got = {r.leaf: r for r in out.collect()}
    assert set(got) == {0, 1} and (got[0].n_anomalies, got[0].anomaly_area_px, got[0].spots_avg_area_px, got[0].z_count, got[0].z_avg_area_px) == (1, 10, 10.0, 0, None)
    assert (got[1].leaf_area_px, got[1].anomaly_pct_leaf, got[1].lost_tissue_pct) == (1, 400.0, None)


def test_copies_and_stamps(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "sub" / "a.png").write_bytes(b"a")
    items = spark.createDataFrame([(f"{tmp_path}/in/sub/a.png",), (f"{tmp_path}/in/none.png",)], "path string")
    items = items.select("path", exports.destination(F.col("path"), f"{tmp_path}/in", F.lit("good")).alias("target"))
    got = {r.target: r.error for r in exports.copy_files(items, f"{tmp_path}/out").collect()}
    assert got["good/sub/a.png"] is None and got["good/none.png"] and (tmp_path / "out/good/sub/a.png").read_bytes() == b"a"
    exports.copy_files(items.where("path like '%a.png'"), f"{tmp_path}/out2", move=True).collect()
    assert not (tmp_path / "in/sub/a.png").exists() and (tmp_path / "out2/good/sub/a.png").exists()
    px = np.arange(4 * 5 * 4, dtype=np.uint8).reshape(4, 5, 4)
    cut = exports.stamp(px, -1, 2, 3)
    assert (cut[:2, 1:] == px[2:, :2]).all() and not cut[2].any() and not cut[:, 0].any()
    assert not exports.stamp(px, 50, 0, 3).any()


def test_sessions_archives_and_backups(spark, tmp_path):
    root = f"{tmp_path}/s"
    assert exports.sessions(spark, root).collect() == [] and exports.archive(spark, f"{root}/log.csv") is None
    exports.save_session(spark, root, "/x/in/", {"a.png": "good"}, 4)
    exports.save_session(spark, root, "/y", {})
    assert exports.sessions(spark, root, "/x/in").collect() == [("/x/in/", 4, "a.png", "good")]
    assert sorted((r.source_folder, r.name) for r in exports.sessions(spark, root).collect()) == [("/x/in/", "a.png"), ("/y", None)]
    exports.put_text(spark, f"{root}/h.json", "1", backup=True)
    exports.put_text(spark, f"{root}/h.json", "2", backup=True)
    assert (tmp_path / "s/h.json").read_text() == "2" and (tmp_path / "s/h.json.bak").read_text() == "1"


def test_base_set_errors(spark, tmp_path):
    good = exports.dump_bytes([0, 2], [(0, 1.0, np.array([1.0, 2.0])), (2, 0.5, np.array([3.0, 4.0]))])
    (tmp_path / "a.bin").write_bytes(good)
    assert [(r["class"], r.weight, r.v, r.error) for r in exports.base_set(spark, f"{tmp_path}/a.bin").collect()] == [(0, 1.0, [1.0, 2.0], None), (2, 0.5, [3.0, 4.0], None)]
    (tmp_path / "b.bin").write_bytes(good[:-1])
    assert "match" in exports.base_set(spark, f"{tmp_path}/b.bin").first().error
    (tmp_path / "c.bin").write_bytes(b"xx")
    assert exports.base_set(spark, f"{tmp_path}/c.bin").first().error == "not a base set"


def test_dataset_keeps_what_is_recorded(spark, tmp_path):
    rows = [("d/b.png", True, 10, 10, b"x", []), ("d/a.png", True, 10, 20, b"y", [(3, [(0.0, 0.0), (10.0, 0.0), (10.0, 20.0)])]), ("d/c.png", False, 1, 1, b"z", [])]
    scenes = spark.createDataFrame(rows, "src string, reviewed boolean, w int, h int, content binary, instances array<struct<class:int,ring:array<struct<x:double,y:double>>>>")
    recorded = spark.createDataFrame([("d/b.png", 7, "val")], "src string, index long, split string")
    plan, summary = exports.export_dataset(scenes, recorded, f"file://{tmp_path}/set")
    got = {r.src: (r["index"], r.split, r.label) for r in plan.collect()}
    assert got["d/b.png"] == (7, "val", "labels/val/real_000007.txt") and got["d/a.png"][0] == 8
    assert summary.collect() == [(2, 1, 0)] and (tmp_path / "set/data.yaml").exists()
    lines = files.polygons(spark, f"file://{tmp_path}/set/labels/*/*.txt").collect()
    assert [(r["class"], r.ring[2].x, r.ring[2].y) for r in lines] == [(3, 1.0, 1.0)]
    (tmp_path / "set/data.yaml").write_text("own")
    exports.export_dataset(scenes, recorded, f"file://{tmp_path}/set")
    assert (tmp_path / "set/data.yaml").read_text() == "own"


def test_paint():
    px = np.full((2, 2, 4), 100, np.uint8)
    out = exports.paint(px, np.array([[True, False], [False, False]]), (200, 0, 100))
    assert out[0, 0].tolist() == [160, 40, 100, 255] and out[1, 1].tolist() == [100] * 4
    assert images.decode(images.encode(out)).tolist() == out.tolist()


def test_silhouette_report_edges(spark):
    rows = [(1, x, 0, 0.9 if x < 6 else 0.1, int(x < 3), int(x < 6)) for x in range(8)] + [(2, 0, 0, 0.9, 1, 0)]
    px = spark.createDataFrame(rows, "leaf int, x int, y int, prob double, visible int, truth int")
    counts = map_masks(px, lambda mask, c: evaluation.silhouette_counts(mask, c), evaluation.SILHOUETTE, 4, 8)
    report = evaluation.silhouette_report(counts, F.lit(6.0)).collect()
    # The second sample has no true area and is skipped; the first is predicted exactly.
    assert len(report) == 31 and all((r.n, r.lost_mae, r.iou, r.dice, r.head_mae) == (1, 0.0, 1.0, 1.0, 0.0) for r in report if r.tau > 0.11)
    best = evaluation.best_report(evaluation.silhouette_report(counts)).collect()
    assert [r.k for r in best] == [0]
