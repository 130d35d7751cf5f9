import itertools
import math
import random
import re

import numpy as np
import pytest

from verdure.llm import overlaps
from verdure.llm.overlaps import boundary, jaccard_components, least_overlap, light_cost, subset_sizes


def brute(rows, width, similarity):
    """(doc_id, set size, smallest reachable id) for each row; null ids take no part."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations([k for k, (i, _) in enumerate(rows) if i is not None], 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= similarity * (len(sets[a]) + len(sets[b]) - common):
            up[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, len(s), None if i is None else least[find(k)]) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=repr)


def check(spark, rows, width=5, similarity=80, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, jaccard_components(df, width=width, similarity=similarity, **more).collect()), key=repr) == brute(rows, width, similarity)


def test_edge_cases(edge, edge_rows):
    got = sorted(map(tuple, jaccard_components(edge).collect()), key=repr)
    assert got == brute([r[:2] for r in edge_rows], 5, 80)


def test_empty(empty):
    assert jaccard_components(empty).collect() == []


def family(rng, size, n, changes):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(size)]
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, changes)):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
        yield " ".join(w)


@pytest.mark.parametrize("width,similarity", [(1, 80), (3, 85)])
def test_light_and_heavy_sets_and_drifting_groups(spark, width, similarity):
    """Sets of 4 to 120 shingles, most pairs of a large group not linked, copies among them."""
    rng = random.Random(width * 100 + similarity)
    texts = [t for size in (4, 6, 9, 12, 16, 20, 25, 120) for t in family(rng, size, 25, 1 + size // 6)]
    texts += list(family(rng, 120, 120, 9)) + [rng.choice(texts) for _ in range(40)]
    # Documents of few words from a small vocabulary: many links by chance, and many near misses.
    texts += [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 14))) for _ in range(150)]
    rng.shuffle(texts)
    check(spark, list(enumerate(texts)), width, similarity)


def test_a_passage_in_every_document_and_blocks_of_few_documents(spark):
    rng = random.Random(7)
    common = " ".join(family(rng, 60, 1, 0))
    rows = [(i, f"{common} {t}" if i % 3 else t) for i, t in enumerate([*family(rng, 20, 40, 6), *[next(family(rng, rng.randint(5, 60), 1, 0)) for _ in range(80)]])]
    rows += [(500 + i, rows[5][1]) for i in range(60)]
    check(spark, rows, block=700)
    check(spark, rows, 1, block=150)


def test_ids_that_repeat_with_other_texts(spark):
    rng = random.Random(9)
    a, b = (next(family(rng, 60, 1, 0)) for _ in range(2))
    check(spark, [(5, a), (5, b), (6, b), (6, a + " x"), (3, b + " y"), (None, b), (5, b)])


def test_every_split_of_light_and_heavy_gives_the_same(spark, monkeypatch):
    rng = random.Random(11)
    texts = [t for size in (5, 8, 10, 13, 15) for t in family(rng, size, 14, 3)]
    for heavy in (8, 25):
        monkeypatch.setattr(overlaps, "boundary", lambda sizes, similarity, x=heavy: x)
        check(spark, list(enumerate(texts)), 1)


def test_subsets_that_linked_sets_share():
    for s in (60, 80, 85, 100):
        for a, b in itertools.product(range(1, 30), repeat=2):
            o = least_overlap(a, b, s)
            assert 100 * o >= s * (a + b - o) and not 100 * (o - 1) >= s * (a + b - o + 1)
            if 100 * min(a, b) >= s * max(a, b):
                assert o in subset_sizes(a, s, 30) and o in subset_sizes(b, s, 30)


def test_the_boundary_is_the_cheapest():
    assert light_cost(10, 10, 80) == sum(math.comb(10, c) for c in subset_sizes(10, 80, overlaps.LIGHT))
    assert boundary([(5, 10, 1000, 5), (10, 900, 200, 20)], 80) in (6, 7, 8, 9, 10)
    assert boundary([(5, 1000, 10, 5)], 80) <= 5
    assert boundary([], 80) == 1


def test_packed_numbers():
    x = np.sort(np.random.default_rng(1).integers(0, 1 << 54, 1000).astype(np.uint64))
    assert (overlaps._unpack(overlaps._pack(x), 1000) == x).all()


def test_long_texts(spark):
    rng = random.Random(2)
    long = next(family(rng, 40_000, 1, 0))
    check(spark, [(1, long), (2, long + " more"), (3, "x" * 300_000), (4, "x " * 100_000), (5, long[: len(long) // 2])], block=10_000)


def test_rows_grow_with_a_group_not_with_its_pairs(spark, monkeypatch):
    """A drifting group of near copies: list members and what is left for blocks grow in proportion."""
    held = []
    monkeypatch.setattr(overlaps, "spread", lambda placed, mixed, f=overlaps.spread: (held.append((placed.count(), f(placed, mixed).count())), f(placed, mixed))[1])
    for n in (200, 400):
        rng = random.Random(4)
        check(spark, list(enumerate(family(rng, 100, n, 6))))
    assert held[1][0] <= 3 * held[0][0] and held[1][1] <= 3 * held[0][1] + 100, held
