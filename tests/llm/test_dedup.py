import random
import re

import pytest

from verdure.llm.components import components
from verdure.llm.dedup import near_duplicates
from verdure.llm.store import Store


def brute(rows, width, similarity):
    """doc_id -> (set size, smallest reachable id)."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.setdefault(i, []).append(frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset())
    flat = [(i, s) for i, v in sets.items() for s in v if i is not None]
    up = {i: i for i, _ in flat}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(flat):
        for j, t in flat[:a]:
            if s and t and 100 * len(s & t) >= similarity * len(s | t):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in flat}, sets


def check(df, rows, width, similarity):
    want, sets = brute(rows, width, similarity)
    got = df.collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept is None
            continue
        assert r.component_id == want[r.doc_id], r
        assert r.kept == (r.doc_id == r.component_id)
        assert r.n_shingles in {len(s) for s in sets[r.doc_id]}


@pytest.mark.parametrize("width,similarity", [(3, 85), (5, 80)])
def test_edge_cases(edge, edge_rows, width, similarity):
    check(near_duplicates(edge, width=width, similarity=similarity), [r[:2] for r in edge_rows], width, similarity)


def test_empty(empty):
    assert near_duplicates(empty).collect() == []


def test_drifting_group_of_near_copies(spark):
    """One large group in which most pairs are not linked: components need links that no pivot sees."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(120)]
    rows = []
    for i in range(500):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = word()
        rows.append((1000 - i, " ".join(w)))
    rows += [(2000 + i, " ".join(word() for _ in range(40))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    check(near_duplicates(df, width=3, similarity=85), rows, 3, 85)


def test_ids_that_repeat_with_other_texts(spark):
    from tests.llm.conftest import prose

    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    rows = [(5, a), (5, b), (5, b + " x"), (6, b), (7, c), (8, c), (8, a), (9, a + " y"), (10, b + " z")]
    got = sorted((r.doc_id, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, similarity=85).collect())
    assert got == [(5, 5), (5, 5), (5, 5), (6, 5), (7, 7), (8, 5), (8, 7), (9, 5), (10, 5)]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 50)] + [(7, 7)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.component for r in components(df, Store(spark, "t"), "c").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + k: 100 for k in range(50)}}
    assert components(df.where("u < 0"), Store(spark, "t"), "c").collect() == []


def drifting(n, seed=3, size=120, changes=9):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base, rows = [word() for _ in range(size)], []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, changes)):
            w[rng.randrange(len(w))] = word()
        rows.append((i, " ".join(w)))
    return rows


def test_rounds_of_pivots_outside_the_largest_component(spark, monkeypatch):
    from verdure.llm import dedup

    monkeypatch.setattr(dedup, "BLOCK", 16)
    rows = drifting(250, 5, 100, 5)
    check(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), width=3, similarity=85), rows, 3, 85)


def test_rows_of_a_drifting_group_stay_in_proportion(spark, monkeypatch):
    """What goes to the block step grows with a group's members, not with their pairs, and stays exact."""
    from verdure.llm import dedup

    shipped = []

    def spread(placed, mixed, f=dedup.spread):
        shipped.append(f(placed, mixed).count())
        return f(placed, mixed)

    monkeypatch.setattr(dedup, "spread", spread)
    for n in (500, 1000):
        rows = drifting(n)
        check(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), width=3, similarity=85), rows, 3, 85)
    assert 0 < shipped[1] <= 2.8 * shipped[0], shipped


def test_spread_meets_every_pair_across_components_once(spark, monkeypatch):
    from pyspark.sql import functions as F

    from verdure.llm import dedup

    monkeypatch.setattr(dedup, "BLOCK", 4)
    placed = spark.createDataFrame([(1, i, 10, 0 if i < 11 else 100 + i % 3) for i in range(25)], "bucket long, rep long, n_shingles long, component long")
    mixed = placed.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"), F.sum(F.expr("int(component <> 0)")).alias("outer"), F.lit(140).alias("outer_shingles")).withColumn("largest", F.lit(0).cast("long"))
    rows = dedup.spread(placed, mixed).collect()
    assert len(rows) == 25 * 4 + 14 * 7
    met = []
    for a in rows:
        for b in rows:
            if a.asks and not b.asks and (a.i, a.j) == (b.i, b.j) and a.component != b.component and (not b.outside or b.rep > a.rep):
                met.append((min(a.rep, b.rep), max(a.rep, b.rep)))
    part = {r.rep: r.component for r in placed.collect()}
    assert sorted(met) == [(x, y) for x in range(25) for y in range(x + 1, 25) if part[x] != part[y]]
