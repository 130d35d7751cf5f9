"""Neighbours by cells: exact against all pairs, and far fewer comparisons where the vectors have structure."""

import numpy as np
import pytest

from verdure.operators import cluster, neighbors, pivots


def points(spark, x):
    return spark.createDataFrame([(i, None if v is None else [float(c) for c in v]) for i, v in enumerate(x)], "point_id long, v array<double>").repartition(4)


def clustered(n, groups, dim=16, seed=1, spread=0.02):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(groups, dim))[rng.integers(0, groups, n)] + rng.normal(size=(n, dim)) * spread


def all_pairs(x, eps):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    return {(i, j): d[i, j] for i, j in zip(*np.nonzero(d <= eps))}


def kinds():
    rng = np.random.default_rng(2)
    twice = rng.normal(size=(60, 3))
    return {
        "clustered": (clustered(500, 25), 0.2), "spheres": (rng.normal(size=(300, 8)), 2.5), "copies": (np.concatenate([twice, twice, np.zeros((150, 3)), twice[:5] + 1e-9]), 0.5),
        "one": (np.ones((1, 4)), 1.0), "large": (clustered(200, 10) * 1e6, 2e5), "line": (np.arange(300.0)[:, None], 1.0),
    }


@pytest.mark.parametrize("kind,cells", [*((k, 7) for k in sorted(kinds())), ("clustered", 1), ("copies", 64)])
def test_pairs_within_a_radius(spark, monkeypatch, kind, cells):
    x, eps = kinds()[kind]
    monkeypatch.setattr(neighbors, "BLOCK", 48)
    monkeypatch.setattr(pivots, "choose", lambda sample, *a: sample[:cells])
    got = neighbors.eps_pairs(points(spark, x), eps).collect()
    want = all_pairs(x, eps)
    assert len(got) == len(want) and {(r.a, r.b): r.d for r in got} == pytest.approx(want, abs=1e-9 * abs(x).max())


@pytest.mark.parametrize("kind,ties", [*((k, "rows") for k in sorted(kinds())), ("clustered", "distinct"), ("copies", "distinct")])
def test_k_nearest(spark, monkeypatch, kind, ties):
    x, _ = kinds()[kind]
    monkeypatch.setattr(neighbors, "BLOCK", 48)
    monkeypatch.setattr(pivots, "choose", lambda sample, *a: sample[:20])
    p = points(spark, x).withColumnRenamed("point_id", "id")
    got = {r.id: r.near for r in neighbors.k_nearest(p.where("id % 3 = 0"), p, 5, ties).collect()}
    assert sorted(got) == list(range(0, len(x), 3))
    for i, near in got.items():
        d = np.sort(np.sqrt(((x - x[i]) ** 2).sum(1)))
        d = np.unique(np.round(d, 9)) if ties == "distinct" else d
        assert near == pytest.approx(list(d[:5]), abs=1e-9 + 1e-15 * abs(x).max())


def test_broken_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    x = [[0.0, 0.0], [1.0, 0.0], None, [nan, 0.0], [inf, 0.0], [0.0, 1.0]]
    assert {(r.a, r.b) for r in neighbors.eps_pairs(points(spark, x), 1.0).collect()} == {(0, 0), (1, 1), (5, 5), (0, 1), (1, 0), (0, 5), (5, 0)}
    assert {r.point_id: r.d for r in neighbors.kth_distance(points(spark, x), 1).collect()} == {0: 1.0, 1: 1.0, 5: 1.0}
    assert neighbors.kth_distance(points(spark, x), 3).collect() == [] == neighbors.eps_pairs(points(spark, []), 1.0).collect()
    assert {r.label for r in cluster.dbscan(points(spark, x), 1.0, 9).collect()} == {-1}


def compared(spark, f, x):
    met = spark.sparkContext.accumulator(0)
    f(points(spark, x), met).count()
    return met.value


def test_structure_leaves_under_a_tenth_of_the_pairs(spark):
    """On clustered vectors; and four times the vectors cost less than eight times as much: below the power 1.5."""
    pairs = lambda p, met: neighbors.eps_pairs(p, 0.2, met)
    nearest = lambda p, met: neighbors.k_nearest(p.withColumnRenamed("point_id", "id"), p.withColumnRenamed("point_id", "id"), 5, others=True, compared=met)
    for f in (pairs, nearest):
        small, large = (compared(spark, f, clustered(n, n // 25, 32)) for n in (2_000, 8_000))
        assert 0 < large < 0.1 * 8_000**2, large / 8_000**2
        assert large < 8 * small, (small, large)


def test_vectors_without_structure_meet_in_one_cell():
    x = np.random.default_rng(3).normal(size=(2_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    assert len(pivots.choose(x, 50_000, np.full(2_000, 1.15), 2048)) == 1


def test_blocks_send_no_pairs(spark, monkeypatch):
    """Degrees and clusters leave blocks as counts, forests and labels: rows out are at most two for each row of a block, not pairs."""
    from verdure.operators import cluster

    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(60, 3)) * 0.1, rng.normal(size=(60, 3)) * 0.1 + 4, rng.normal(size=(40, 3)) * 3])
    ids = rng.permutation(len(x)).astype(np.int64) * 2**55 - 2**61
    p = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "point_id long, v array<double>")
    near = np.sqrt(((x[:, None] - x) ** 2).sum(2)) <= 0.9
    kept = neighbors.eps_fold
    sent = []

    def watched(points, eps, fold, schema, compared=None):
        out = kept(points, eps, fold, schema, compared)
        sent.append(out.count())
        return out

    monkeypatch.setattr(cluster, "eps_fold", watched)
    assert {r.point_id: r.degree for r in cluster.eps_degrees(p, 0.9).collect()} == dict(zip(ids.tolist(), near.sum(1).tolist()))
    got = {r.point_id: r.label for r in cluster.dbscan(p, 0.9, 5).collect()}
    core = near.sum(1) >= 5
    low = np.where(core, ids, np.iinfo(np.int64).max)
    for _ in ids:
        low = np.where(core, np.where(near & core, low, np.iinfo(np.int64).max).min(1), low)
    label = {c: k for k, c in enumerate(sorted(set(low[core].tolist())))}
    seen = np.where(near & core, low, np.iinfo(np.int64).max).min(1)
    assert got == {i: label[c] if c in label else -1 for i, c in zip(ids.tolist(), seen.tolist())} and -1 in got.values()
    assert max(sent) <= 2 * len(x) * 4 < near.sum()


@pytest.mark.parametrize("known", [1, 25, 10_000])
def test_dbscan_asks_only_for_what_the_sample_leaves_open(spark, monkeypatch, known):
    """Right with a sample of any size; on one dense cluster almost no point meets all others."""
    from verdure.operators import cluster

    monkeypatch.setattr(cluster, "KNOWN", known)
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(70, 3)) * 0.3, rng.normal(size=(50, 3)) * 0.3 + 2.2, rng.normal(size=(60, 3)) * 2, rng.normal(size=(20, 3)) * 0.1 - 6])
    ids = rng.permutation(len(x)).astype(np.int64) * 7 - 300
    near = np.sqrt(((x[:, None] - x) ** 2).sum(2)) <= 0.7
    core = near.sum(1) >= 4
    low = np.where(core, ids, np.iinfo(np.int64).max)
    for _ in ids:
        low = np.where(core, np.where(near & core, low, np.iinfo(np.int64).max).min(1), low)
    label = {c: k for k, c in enumerate(sorted(set(low[core].tolist())))}
    seen = np.where(near & core, low, np.iinfo(np.int64).max).min(1)
    want = {i: label[c] if c in label else -1 for i, c in zip(ids.tolist(), seen.tolist())} | {10**6: -1}
    assert len(label) > 2 and -1 in want.values() and (near & core).any(1)[~core].any()
    p = spark.createDataFrame([*((int(i), v.tolist()) for i, v in zip(ids, x)), (10**6, None)], "point_id long, v array<double>")
    assert {r.point_id: r.label for r in cluster.dbscan(p, 0.7, 4).collect()} == want
    if known == 25:
        twice = p.union(p.where("point_id > 300"))
        assert [r.label for r in cluster.dbscan(twice, 1e9, 4).collect()].count(-1) == 2
        kept, asked = cluster.eps_fold, []

        def watched(points, eps, fold, schema, compared=None, asking=None):
            asked.append((points if asking is None else asking).count())
            return kept(points, eps, fold, schema, compared, asking)

        monkeypatch.setattr(cluster, "eps_fold", watched)
        dense = rng.uniform(size=(400, 3))
        assert {r.label for r in cluster.dbscan(points(spark, dense), 0.8, 4).collect()} == {0}
        assert sum(asked) < 20, asked


def test_rows_go_to_as_many_blocks_however_many_there_are():
    for n in (100_000, 400_000, 700_000):
        assert -(-n // neighbors._rows(n)) <= neighbors.SIDES
    assert neighbors._rows(2_000) == neighbors.BLOCK and neighbors._rows(10**9) == neighbors.MOST_ROWS
