import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdure.llm.lloyd import assign, clusters


def brute(rows, k, rounds, dim):
    """The rows that the query should return, by plain Lloyd rounds in whole numbers."""
    kept = [(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) and abs(x) <= 1 << 17 for x in v)]
    little = lambda v: b"".join(x.to_bytes(4, "little", signed=True) for x in v)
    seeds = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), little(v), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, _, v in seeds]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for r in range(rounds + 1):
        best = [min((far(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
        if r < rounds:
            for j in range(len(centroids)):
                own = [v for (_, v), (_, b) in zip(kept, best) if b == j]
                if own:
                    centroids[j] = tuple(sum(x) // len(own) for x in zip(*own))
    total = [sum(d for d, b in best if b == j) for j in range(len(centroids))]
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, b, d, total[b], sum(total), name[b]) for (i, _), (d, b) in zip(kept, best)]


def same(got, want):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)


@pytest.mark.parametrize("n,k,rounds,spread", [(300, 8, 10, 0.3), (300, 8, 2, 1.0), (80, 5, 30, 0.0), (6, 8, 10, 1.0)])
def test_equals_plain_rounds(spark, n, k, rounds, spread):
    rng = random.Random(n + k)
    f32 = lambda x: float(np.float32(x))
    middle = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(k)]
    rows = [(i, [f32(x + rng.gauss(0, spread)) for x in middle[rng.randrange(k)]]) for i in range(n)]
    same(clusters(frame(spark, rows), k=k, rounds=rounds, dim=4).collect(), brute(rows, k, rounds, 4))


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.0, 0.0]), (1, [0.0, 0.0]), (1, [4.0, 4.0]), (2, [4.0, 4.0]), (3, None), (4, []), (5, [1.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [-inf, 1.0]),
        (10, [1.0, 2.0, 3.0]), (None, [4.0, 3.5]), (11, [-0.0001, 0.0001]), (12, [1e30, 0.0]), (13, [131072.0, -131072.0]), (14, [2.0, 2.0]), (15, [2.0, 2.0]),
    ]
    same(clusters(frame(spark, rows), k=4, rounds=10, dim=2).collect(), brute(rows, 4, 10, 2))


def test_clashing_names_empty_and_nameless(spark):
    df = frame(spark, [(i, [float(i), 1.0]) for i in range(9)]).select("*", *[F.lit("x").alias(c) for c in ("owner", "v", "kind", "distance", "cluster", "sums")])
    assert len(clusters(df, dim=2).collect()) == 9
    assert clusters(frame(spark, [(1, [1.0])]), dim=2).collect() == [] == clusters(frame(spark, []), dim=2).collect()
    assert [tuple(r) for r in clusters(frame(spark, [(None, [1.0, 1.0])]), dim=2).collect()] == [(None,) * 6]


def test_fewer_comparisons_give_the_same_owners():
    """Ties included: owners after some centroids moved are those of a comparison with all."""
    rng = np.random.default_rng(4)
    for _ in range(200):
        v, old = rng.integers(-3, 4, (60, 2)), rng.integers(-3, 4, (5, 2))
        d = ((v[:, None] - old[None]) ** 2).sum(2)
        owner, new, changed = d.argmin(1), old.copy(), rng.random(5) < 0.5
        new[changed] += rng.integers(-2, 3, (int(changed.sum()), 2))
        e = ((v[:, None] - new[None]) ** 2).sum(2)
        best, far = assign(v, owner, d.min(1), new, changed)
        assert (best == e.argmin(1)).all() and (far == e.min(1)).all()
