"""Very long texts: hundreds of thousands of words, one word of a megabyte, a megabyte of white space, one word over and over."""

import numpy as np
import public_tokenizers
import pytest

from tests.llm.conftest import prose
from verdure.llm import lm, quality, toxicity
from verdure.llm.decontam import contaminated
from verdure.llm.dedup import near_duplicates
from verdure.llm.packing import pack
from verdure.llm.sharding import shard


@pytest.fixture(scope="module")
def long(spark):
    words = prose(11, 300_000)
    rows = [(1, words), (2, words + " tail"), (3, "x" * 1_000_000), (4, "a" + " \t\n" * 400_000 + "b"), (5, "word " * 300_000), (6, "short one")]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache()


def test_near_duplicates(long):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(long, width=3, similarity=85).collect()}
    assert got[1][0] > 299_000 and {i: c for i, (_, c) in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}
    assert got[3][0] == got[4][0] == got[5][0] == 1


def test_scores(spark, long):
    nothing = toxicity.Model(np.zeros(0, np.uint64), np.zeros(0), 0.8, 1.0, 0.01, 1.0, 0.0)
    rows = {r.doc_id: r for r in toxicity.score(long, nothing).collect()}
    assert rows[1].n_words == rows[5].n_words == 300_000 and rows[3].n_words == 1 and all(r.evidence == toxicity.NOTHING for r in rows.values())
    model = quality.Model(np.ones(quality.FAMILIES << quality.BUCKET_BITS, np.float32), 0.0)
    scores = {r.doc_id: r.score for r in quality.score(long, model).collect()}
    assert all(s == pytest.approx(scores[1], abs=1e-6) for s in scores.values())


def test_language_model(long):
    rows = {r.doc_id: r for r in lm.score(long).collect()}
    assert {i: r.n_tokens for i, r in rows.items()} == {1: 300_001, 2: 300_002, 3: 2, 4: 3, 5: 300_001, 6: 3}
    assert all(r.score < 0 for r in rows.values()) and rows[5].held_out and rows[5].n_known == 1 and rows[1].n_known == 300_001


def test_decontamination_packing_and_shards(spark, long):
    item = " ".join(prose(11, 300_000).split()[150_000:150_040])
    found = contaminated(long, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.similarity, r.first_word) for r in found) == [(1, 1.0, 150_000), (2, 1.0, 150_000)]
    pieces = pack(long, public_tokenizers.path("byte_bpe_50k.json")).groupBy("doc_id").agg({"length": "sum", "piece": "max"}).collect()
    assert {r.doc_id for r in pieces} == {1, 2, 3, 4, 5, 6}
    assert shard(long, 4).count() == 6
