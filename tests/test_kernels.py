import numpy as np
import pytest

from verdure.kernels import decide, raster
from verdure.operators.cluster import complete_linkage


def test_tiles_and_restitch():
    rgba = np.zeros((3, 3, 4), np.uint8)
    rgba[...] = (10, 20, 30, 255)
    rgba[2, 2, 3] = 0
    tiles = raster.tiles(rgba, 2)
    assert [t[:2] for t in tiles] == [(0, 0), (2, 0), (0, 2), (2, 2)]
    assert tiles[0][3].all() and not tiles[3][3].any()
    flags = [(x, y, np.zeros((2, 2), bool)) for x, y, _, _ in tiles]
    flags[0][2][1, 1] = True
    out = raster.restitch(flags, 3, 3)
    assert out.sum() == 1 and out[1, 1]


def test_channels():
    rgb = np.zeros((64, 64, 3), np.uint8)
    rgb[...] = (60, 140, 70)
    rgb[32, 32] = 255
    r = raster.residual(rgb, 9)
    assert r[32, 32] > 50 and r[50, 50] < 5


@pytest.mark.parametrize("eight", [True, False])
def test_components_match_flood_fill(eight):
    rng = np.random.default_rng(3)
    for _ in range(20):
        mask = rng.random((9, 11)) < 0.45
        labels, n = raster.label(mask, eight)
        seen, count = np.zeros(mask.shape, bool), 0
        for y, x in np.argwhere(mask):
            if seen[y, x]:
                continue
            count += 1
            todo, part = [(y, x)], []
            seen[y, x] = True
            while todo:
                a, b = todo.pop()
                part.append((a, b))
                for i in range(max(0, a - 1), min(9, a + 2)):
                    for j in range(max(0, b - 1), min(11, b + 2)):
                        if mask[i, j] and not seen[i, j] and (eight or i == a or j == b):
                            seen[i, j] = True
                            todo.append((i, j))
            assert len({labels[p] for p in part}) == 1 and (labels == labels[y, x]).sum() == len(part)
        assert n == count


def test_morphology():
    m = np.zeros((7, 7), bool)
    m[3, 3] = True
    assert raster.dilate(m, 1).sum() == 9 and raster.erode(raster.dilate(m, 1), 1).sum() == 1
    assert raster.erode(np.ones((4, 4), bool), 2).all()
    ring = raster.dilate(m, 2) & ~raster.dilate(m, 1)
    assert raster.fill_holes(ring).sum() == 25
    assert len(raster.geometric_holes(ring, 4)) == 1
    d = raster.exterior_distance(raster.dilate(m, 2))
    assert d[3, 3] == 3 and d[0, 0] == 0
    assert raster.exterior_distance(np.ones((3, 3), bool)) is None


def test_hysteresis_and_gate():
    v = np.array([[0.9, 0.5, 0.0, 0.5, 0.5]])
    assert raster.hysteresis(v, 0.8, 0.4).tolist() == [[True, True, False, False, False]]
    gate = raster.scale_gate(v >= 0.5, np.zeros(v.shape, bool), 1)
    assert not gate.any() and raster.scale_gate(v >= 0.5, v >= 0.8, 1).sum() == 2


def test_polygons():
    ring = np.array([[1, 1], [5, 1], [5, 4], [1, 4]], float)
    mask = raster.rasterize(ring, 6, 7)
    assert mask.sum() == 12
    back = raster.polygon(mask, least=4)
    assert raster.rasterize(back, 6, 7).sum() == 12
    assert raster.polygon(np.zeros((4, 4), bool)) is None


def test_damage_takes_no_more_than_asked():
    mask = np.zeros((40, 40), bool)
    mask[5:35, 8:32] = True
    for mode in raster.MODES:
        out = raster.damage(mask, mode, 0.2, 7)
        assert not (out & ~mask).any() and 0 < (mask & ~out).sum() <= 0.2 * mask.sum()
        assert (out == raster.damage(mask, mode, 0.2, 7)).all()
    a, b = raster.augment([mask, mask], 5)
    assert (a == b).all()


def test_radial_round_trip():
    y, x = np.mgrid[:64, :64]
    disc = np.hypot(y - 30, x - 33) < 20
    r, hit, centre = raster.radial(disc)
    assert hit.all()
    back = raster.fill_radial(r, centre, 64, 64)
    assert (back & disc).sum() / (back | disc).sum() > 0.93


def test_closed_set_splits_and_breaks_ties():
    prob, family = np.full((4, 8), 0.95), np.ones((4, 8), int)
    family[:, 4:] = 2
    ok = np.ones((4, 8), bool)
    assert sorted(f for _, f in decide.closed_set(prob, family, ok, least=4)) == [1, 2]
    assert decide.closed_set(prob, np.ones((4, 8), int), ok, least=4)[0][1] == 1
    assert decide.closed_set(prob * 0.5, family, ok) == []


def test_closed_set_keeps_a_small_second_family():
    prob, family = np.full((7, 7), 0.95), np.ones((7, 7), int)
    family[:3, :3] = 2
    found = decide.closed_set(prob, family, np.ones((7, 7), bool))
    assert sorted((f, int(m.sum())) for m, f in found) == [(1, 40), (2, 9)]
    family[:3, :3] = 0  # no family: no share, and no region of its own
    assert [(f, int(m.sum())) for m, f in decide.closed_set(prob, family, np.ones((7, 7), bool))] == [(1, 49)]
    prob[:, 3] = 0.1
    assert [int(m.sum()) for m, _ in decide.closed_set(prob, np.ones((7, 7), int), np.ones((7, 7), bool), least=1)] == [49]
    assert len(decide.closed_set(prob, np.ones((7, 7), int), np.ones((7, 7), bool), close=0, least=22)) == 0


def test_open_set_floor_adds_pixels():
    rng = np.random.default_rng(1)
    distance, zero = rng.random((20, 20)), np.zeros((20, 20))
    distance[5:9, 5:9] = 9.0
    valid = np.ones((20, 20), bool)
    meta = {"thresholds": {}, "floors": {}, "dino_threshold": 5.0}
    found, z = decide.open_set(distance, zero, zero, zero, valid, meta)
    assert [int(m.sum()) for m in found] == [16] and set(z) == {"dino", "color", "residual"}
    assert decide.open_set(distance, zero, zero, zero, valid, meta, use_floor=False)[0] == []
    seeded = {"thresholds": {"dino": 4.0}, "floors": {}, "dino_threshold": 99.0}
    assert [int(m.sum()) for m in decide.open_set(distance, zero, zero, zero, valid, seeded)[0]] == [16]
    valid[5:9, 5:7] = False
    assert [int(m.sum()) for m in decide.open_set(distance, zero, zero, zero, valid, meta, close=0)[0]] == [8]


def test_residual_needs_support_or_smallness():
    zero = np.zeros((20, 20))
    residual = np.random.default_rng(2).random((20, 20)) * 0.1
    residual[2:8, 2:8] = 50.0
    meta = {"thresholds": {"residual": 5.0}, "floors": {}, "dino_threshold": 9.0}
    valid = np.ones((20, 20), bool)
    assert len(decide.open_set(zero, zero, zero, residual, valid, meta, cap=36)[0]) == 1
    assert decide.open_set(zero, zero, zero, residual, valid, meta, cap=35)[0] == []


def test_robust_z_is_one_sided():
    v = np.array([1.0, 2, 3, 4, 100])
    z = decide.robust_z(v, np.ones(5, bool))
    assert z[2] == 0 and z[4] > 50


def naive_linkage(v):
    groups, out = {i: [i] for i in range(len(v))}, []
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    while len(groups) > 1:
        h, i, j = min((max(d[a, b] for a in groups[i] for b in groups[j]), i, j) for i in groups for j in groups if i < j)
        groups[i] += groups.pop(j)
        out.append(h)
    return out


@pytest.mark.parametrize("n", [2, 3, 5, 13, 40])
def test_linkage_matches_naive(n):
    v = np.random.default_rng(n).normal(size=(n, 5))
    got = complete_linkage(v)
    assert np.allclose([m[2] for m in got], naive_linkage(v), atol=1e-3)
    assert all(i < j for i, j, _ in got) and len({j for _, j, _ in got}) == n - 1


@pytest.mark.parametrize("name", ["px_margin_cleared", "px_margin_holes", "px_tiles_filled"])
def test_full_canvas_equals_sql(spark, tmp_path, name):
    """One leaf with every pixel of its canvas laid, so that it has no outside and whole tiles, and one with few."""
    import duckdb

    from verdure.plans import catalog, pixels  # noqa: F401

    rows = [(30 * k + y * 13 % 30, 1, float(x)) for k in range(0, 6, 5) for y in range(30) for x in range(40)] + [(60_000 + k, 2, 3.0 * k) for k in range(9)]
    spark.createDataFrame(rows, "p_partkey long, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    db = duckdb.connect()
    db.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    want = db.execute(catalog.ORACLE_SQL[name]).df()
    got = catalog.QUERIES[name](spark, str(tmp_path)).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))
    if name == "px_tiles_filled":
        assert (want.n == 256).any() and (got[got.n == 256].r == -1).all()
