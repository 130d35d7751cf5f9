import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.tests_llm_data import labelled_rows
from verdure.llm import quality, scan, toxicity
from verdure.llm.labelled import training_rows
from verdure.llm.store import Store


def brute_segments(scores):
    """All maximal segments by the recursive definition: the best run, then left and right of it."""
    best = None
    for i in range(len(scores)):
        t = 0.0
        for j in range(i, len(scores)):
            t += scores[j]
            if t > 1e-12 and (best is None or t > best[0] + 1e-12):
                best = (t, i, j)
    if best is None:
        return []
    t, i, j = best
    return brute_segments(scores[:i]) + [(i, j, t)] + [(a + j + 1, b + j + 1, x) for a, b, x in brute_segments(scores[j + 1 :])]


def test_segments_are_all_maximal():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 25)
        scores = [rng.choice([1.3, 2.1, 0.7]) * (1 + rng.random()) if rng.random() < 0.35 else -0.9 * rng.random() for _ in range(n)]
        got = toxicity.segments(np.array(scores))
        want = brute_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([x for _, _, x in got], [x for _, _, x in want])


def test_segments_in_linear_time():
    import time

    for scores in (np.tile([1.0, -3.0], 200_000), np.tile([3.0, -1.0], 200_000), np.tile([1.0, -1.5, 2.0, -2.0], 100_000)):
        began = time.process_time()
        toxicity.segments(scores)
        assert time.process_time() - began < 3


def test_log_odds_against_the_definition():
    """Signed odds of the classes' smoothed distributions, each word's prior dealt out by its prefix."""
    own = np.array([11, 12, 13], np.uint64), np.array([21, 22, 23, 24, 25], np.uint64)
    parent = np.zeros(3, np.uint64), np.array([11, 11, 12, 13, 99], np.uint64)
    c1, c0 = (np.array([5.0, 0.0, 1.0]), np.array([9.0, 0.0, 0.0, 0.0, 3.0])), (np.array([1.0, 40.0, 6.0]), np.array([0.0, 2.0, 30.0, 0.0, 0.0]))
    base, prior = 1 / 7, 4.0
    keys, odds = toxicity.log_odds([(own[k], parent[k], c1[k], c0[k]) for k in (0, 1)], base, prior)
    got = dict(zip(keys.tolist(), odds.tolist()))
    assert keys.tolist() == sorted(keys.tolist())

    def smoothed(one, other, p):
        return np.log((one + prior * p) / base) - np.log((other + prior * (1 - p)) / (1 - base)), (one + prior * p) / (one + other + prior)

    prefix = {k: smoothed(a, b, base) for k, a, b in zip(own[0].tolist(), c1[0], c0[0])}
    for k, p, a, b in zip(own[1].tolist(), parent[1].tolist(), c1[1], c0[1]):
        want = smoothed(a, b, prefix[p][1] if p in prefix and p in got else base)[0]
        if k in got:
            assert got[k] == pytest.approx(want)
        else:
            assert abs(want - (prefix[p][0] if p in got else 0)) < toxicity.SAME + 1e-9
    assert got[21] > 2 and got[23] < -1 and 24 not in got and got[12] < 0 < got[11]


def test_extreme_value_law():
    """From segments with an exponential tail of known rate, the law of how many score high."""
    rng = np.random.default_rng(3)
    scores = rng.exponential(1 / 0.8, 50_000)
    lam, k = toxicity.extreme_value_law(scores, 1_000_000)
    assert lam == pytest.approx(0.8, rel=0.05)
    for x in (4.0, 6.0, 8.0):
        assert k * 1_000_000 * np.exp(-lam * x) == pytest.approx((scores >= x).sum(), rel=0.25)


@pytest.fixture(scope="module")
def data(spark):
    rows, labels = labelled_rows(900)
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache(), spark.createDataFrame(labels, "doc_id long, toxic int, quality int").cache()


def held_out_accuracy(scored, labels, label, threshold):
    rows = scored.join(labels, "doc_id").where("pmod(crc32(cast(doc_id as string)), 5) = 0").collect()
    return np.mean([(r.score >= threshold) == (r[label] == 1) for r in rows])


def test_toxicity(spark, data, edge, empty):
    docs, labels = data
    model = toxicity.fit(training_rows(docs, labels, "toxic", 5_000, Store(spark, "t")))
    assert held_out_accuracy(toxicity.score(docs, model), labels, "toxic", 0.5) > 0.95
    scored = toxicity.score(edge, model).collect()
    assert len(scored) == 16 and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.score(empty, model).collect() == []
    by_words = {r.n_words: r.score for r in scored}
    assert by_words[0] < 0.5
    clean = toxicity.without_toxic(edge, model)
    assert clean.columns == edge.columns and clean.count() == 16
    found = [r for r in toxicity.score(docs, model).collect() if r.passages]
    texts = dict(docs.collect())
    assert found and all("venom" in texts[r.doc_id].lower().encode()[p.start_byte : p.end_byte].decode(errors="ignore") for r in found[:20] for p in r.passages[:1])


def hand_set(words, odds=2.0):
    raw = np.frombuffer(" ".join(words).encode(), np.uint8)
    s = scan.Scan(raw, np.array([0, len(raw)]), punct=True)
    keys = np.unique(s.words ^ np.uint64(1))
    return toxicity.Model(keys, np.full(len(keys), odds), 0.8, 1.0, 0.01, 1.0, 0.0)


def passages(model, text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return [(p["first_word"], p["last_word"]) for p in toxicity.read(model, raw, np.array([0, len(raw)]))[3][0]]


def test_a_passage_that_comes_again_is_found_again():
    bad = ["vile", "rotten", "filthy", "wretch", "scum"]
    model, calm = hand_set(bad), [f"w{k}" for k in range(400)]
    once = " ".join([*bad, *calm])
    assert passages(model, once) == [(0, 4)]
    assert passages(model, f"{once} {' '.join(bad)}") == [(0, 4), (405, 409)]
    # A word that stood alone in harmless text before doesn't weaken the passage.
    assert passages(model, " ".join(["scum", *calm, *bad])) == [(401, 405)]


def test_a_repeated_word_makes_no_passage():
    model = hand_set(["dull"])
    assert passages(model, "dull " * 300) == [] == passages(model, " ".join(["dull", *["x"] * 9] * 60))


def test_repeats_within_reach():
    rng = np.random.default_rng(3)
    words, document = rng.integers(0, 5, 300).astype(np.uint64), np.sort(rng.integers(0, 3, 300))
    at = np.cumsum(rng.integers(1, 30, 300))
    want = [sum(words[j] == words[i] and document[j] == document[i] and at[j] >= at[i] - toxicity.NEAR for j in range(i)) for i in range(300)]
    assert toxicity.repeats(words, document, at).tolist() == want


def test_the_model_depends_on_no_order(spark, data):
    docs, labels = data
    fits = [toxicity.fit(training_rows(docs.repartition(n), labels, "toxic", 5_000, Store(spark, "t"))) for n in (2, 7)]
    assert (fits[0].keys == fits[1].keys).all() and np.allclose(fits[0].odds, fits[1].odds) and np.isclose(fits[0].lam, fits[1].lam) and np.isclose(fits[0].slope, fits[1].slope)


def test_toxicity_without_labels(spark, edge):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(training_rows(edge, none, "toxic", 100, Store(spark, "t")))
    assert {round(r.score, 6) for r in toxicity.score(edge, model).collect()} == {0.5}


def test_quality(spark, data, edge, empty):
    docs, labels = data
    model = quality.fit(training_rows(docs, labels, "quality", 5_000, Store(spark, "q")))
    assert held_out_accuracy(quality.score(docs, model), labels, "quality", 0.3) > 0.95
    scored = quality.score(edge, model).collect()
    assert len(scored) == 16 and all(0 <= r.score <= 1 for r in scored)
    assert quality.score(empty, model).collect() == []
    assert quality.of_quality(edge, model).columns == edge.columns
    none = quality.fit(training_rows(edge, spark.createDataFrame([], "doc_id long, quality int"), "quality", 100, Store(spark, "q")))
    assert {r.score for r in quality.score(edge, none).collect()} == {0.5}


def test_features_average_each_family(spark):
    """A document's score is the softmax of its averaged vectors, whatever else is in its block."""
    rng = np.random.default_rng(1)
    model = quality.Model(rng.normal(size=quality.FAMILIES << quality.BUCKET_BITS).astype(np.float32), 0.1)
    texts = ["a b a b", "", "the the the", "ünï x", "zz"]
    alone = [float(model.score(raw, at)[0]) for t in texts for _, _, raw, at in scan.blocks(pa.array([t]))]
    together = [float(x) for _, _, raw, at in scan.blocks(pa.array(texts)) for x in model.score(raw, at)]
    assert np.allclose(alone, together)


def test_features_against_brute_force():
    """Words, word bigrams and runs of 3 to 5 characters, counted one by one."""
    import re
    from collections import Counter

    texts = ["ünï ünï cödé ☃ 字字字 ab", "", "aa aa aa", "x", "The the  end.\n字", "ab"]
    ((_, _, raw, at),) = scan.blocks(pa.array(texts))
    bag_of: dict[int, dict] = {}
    for f, (bucket, offsets) in enumerate(quality.features(raw, at)):
        for d, t in enumerate(texts):
            w = re.findall(r"[^\x20\x09-\x0d]+", t)
            want = [(("again",) if k and w[k - 1] == x else (w[k - 1] if k else None, x)) for k, x in enumerate(w)] if f == 0 else w if f == 1 else [t[k : k + f + 1] for k in range(len(t) - f)]
            got = bucket[offsets[d] : offsets[d + 1]].tolist()
            assert len(got) == len(want) and all(b >> quality.BUCKET_BITS == f for b in got)
            for b, g in zip(got, want):
                assert bag_of.setdefault(f, {}).setdefault(g, b) == b
        assert len(set(bag_of[f].values())) == len(bag_of[f])
    assert Counter(len(v) for v in bag_of.values())


def test_bags_and_training_step():
    """A packed document gives the features' shares back, and the model's score is the softmax of the averaged vectors."""
    text = "one two two three ☃☃☃"
    (b,) = quality._bags([pa.RecordBatch.from_pydict({"doc_id": [1], "label": pa.array([1], pa.int32()), "text": [text]})])
    ids, share = quality.bag(b.column("n")[0].as_py(), b.column("ids")[0].as_buffer(), b.column("counts")[0].as_buffer())
    ((_, _, raw, at),) = scan.blocks(pa.array([text]))
    want = {}
    for bucket, _ in quality.features(raw, at):
        for x in bucket:
            want[int(x)] = want.get(int(x), 0) + 1 / (quality.FAMILIES * len(bucket))
    assert dict(zip(ids.tolist(), share.tolist())) == pytest.approx(want)
    model = quality._train([(1, b.column("n")[0].as_py(), b.column("ids")[0].as_buffer(), b.column("counts")[0].as_buffer())], 4, 3, 0.3, 1)
    total = sum(share[k] * float(model.weights[i]) for k, i in enumerate(ids)) + model.bias
    assert float(model.score(raw, at)[0]) == pytest.approx(1 / (1 + np.exp(-total)), rel=1e-5)
    assert float(model.score(raw, at)[0]) > 0.5
