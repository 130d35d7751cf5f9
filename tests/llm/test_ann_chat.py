import numpy as np
import pytest
from pyspark.sql import functions as F

from verdure.llm.ann import nearest, rotation, scan_lists
from verdure.llm.chat import maximal_conversations, prefix_hashes


def exact(rows, q, k=10):
    out = {}
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for i, v in ok:
        if i % q == 0:
            d = sorted((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in ok if j != i)[:k]
            out[i] = d
    return out


def test_scan_is_exact_without_tests():
    rng = np.random.default_rng(1)
    v, q = rng.normal(size=(500, 16)), rng.normal(size=(5, 16))
    ids = np.arange(500)
    found = scan_lists(q, [np.array([0])] * 5, v, ids, np.zeros(500, int), np.full(5, -1), 10, rotation(16), width=4, z=1e9)
    for i, (d, got) in enumerate(found):
        want = np.argsort(((v - q[i]) ** 2).sum(1), kind="stable")[:10]
        assert got.tolist() == want.tolist()


def test_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=32).tolist()) for i in range(1500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = nearest(df, F.col("vec_id") % 50 == 0).collect()
    want = exact(rows, 50)
    hits = sum(len({j for _, j in want[q]} & {r.vec_id for r in got if r.query_id == q}) for q in want)
    assert hits / (10 * len(want)) >= 0.9
    vectors = {i: np.array(v, float) for i, v in rows}
    for r in got[:100]:
        assert r.score == pytest.approx(float(np.sqrt(((vectors[r.query_id] - vectors[r.vec_id]) ** 2).sum())), abs=1e-12)
    for q in want:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)


def test_recall_with_most_lists_left_out(spark, monkeypatch):
    """20,000 rows in 200 lists: a good part of the lists is left out, and nine of ten neighbours are still found."""
    from verdure.llm import ann

    probed, real = [], ann.probes_for
    monkeypatch.setattr(ann, "probes_for", lambda *a: probed.append((real(*a), len(a[1]))) or probed[-1][0])
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(60, 24))
    x = centre[rng.integers(0, 60, 20_000)] + rng.normal(size=(20_000, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), F.col("vec_id") % 200 == 0).collect()
    hits = 0
    for q in range(0, 20_000, 200):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hits += len(set(np.argsort(d, kind="stable")[:10].tolist()) & {r.vec_id for r in got if r.query_id == q})
    assert hits / 1000 >= 0.9
    assert probed[0][1] == 200 and probed[0][0] <= 100


def test_probes_are_counted_on_true_neighbours():
    import pyarrow as pa

    from verdure.llm import ann

    rng = np.random.default_rng(8)
    x, c = rng.normal(size=(300, 5)), rng.normal(size=(12, 5))
    run = ann.true_neighbours(x[:4], np.arange(4), c, 6)
    batches = [pa.RecordBatch.from_pydict({"vec_id": pa.array(np.arange(lo, lo + 100)), "v": pa.array(x[lo : lo + 100].tolist())}) for lo in (0, 100, 200)]
    (out,) = run(iter(batches))
    for j in range(4):
        d = ((x - x[j]) ** 2).sum(axis=1)
        d[j] = np.inf
        want = np.argsort(d)[:6]
        here = out.column("judge").to_numpy() == j
        assert np.allclose(np.sort(out.column("d").to_numpy()[here]), d[want])
        assert sorted(out.column("list").to_numpy()[here]) == sorted(ann.lists_of(x[want], c))
    assert (ann.lists_of(x, c) == ((x[:, None] - c) ** 2).sum(-1).argmin(1)).all()


def test_ann_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (10, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (100, [0.0, 2.0])]
    df = spark.createDataFrame([(*r, 1, True, [7], 3, [4], 5) for r in rows], "vec_id long, embedding array<double>, label int, is_query boolean, v array<int>, list int, probed array<int>, task int")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nearest(df, F.col("vec_id") % 100 == 0).collect())
    s2, s5 = 2**0.5, 5**0.5
    assert got == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 3, s2), (0, 4, 100, s5), (100, 1, 3, 1.0), (100, 2, 0, s5), (100, 3, 1, s5), (100, 4, 2, s5)]
    assert nearest(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []


def test_hot_vector(spark):
    rows = [(i, [1.0, 2.0]) for i in range(6000)] + [(i, [float(i), 1.0]) for i in range(6000, 6050)]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5), F.col("vec_id") % 3000 == 0).collect()
    assert sorted(r.vec_id for r in got if r.query_id == 3000) == list(range(10))


def test_conversations(spark):
    def turns(c, *texts):
        return [(c, k, "user" if k % 2 == 0 else "assistant", t, "x", 1) for k, t in enumerate(texts)]

    rows = turns(1, "a", "b") + turns(2, "a", "b", "c") + turns(3, "a", "b", "c") + turns(4, "a", "x") + turns(5, "a") + turns(6, None, "b") + turns(7, "", "b") + turns(8, "a", "b") + [(None, 0, "user", "q", "x", 1)]
    rows += [(9, 0, "user", "t", "x", 1), (9, 0, "user", "s", "x", 1), (9, None, None, "first", "x", 1), (9, 0, "user", "t", "x", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, whole string, n_turns int").repartition(3)
    got = {r.conv_id: r for r in maximal_conversations(df).collect()}
    assert {k: (r.n_turns, r.n_copies) for k, r in got.items()} == {2: (3, 2), 4: (2, 1), 6: (2, 1), 7: (2, 1), 9: (4, 1)}
    assert got[9].rendered == "<|im_start|>unknown\nfirst<|im_end|>\n<|im_start|>user\ns<|im_end|>\n" + "<|im_start|>user\nt<|im_end|>\n" * 2
    assert maximal_conversations(df.limit(0)).collect() == []


def test_prefix_hashes():
    a, b = prefix_hashes([("u", "x"), ("a", "y")]), prefix_hashes([("u", "x"), ("a", "z")])
    assert a[0] == b[0] and a[1] != b[1] and prefix_hashes([("u", None)]) != prefix_hashes([("u", "")])
