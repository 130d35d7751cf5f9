"""Quality classifier: supervised subword embeddings, averaged per document.

Every word, every word bigram and every run of 3 to 5 characters of a text is hashed
to a learned vector; a document is the average of its vectors, each family of n-grams
weighing the same, and a softmax over two classes reads it. Training is stochastic
gradient descent in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdure.llm import scan
from verdure.llm.rows import filter_text

U = np.uint64
GRAMS = (3, 4, 5)
BUCKET_BITS = 17


def _bucket(h: np.ndarray, family: int) -> np.ndarray:
    """Buckets of the family's own part of the table."""
    return ((h >> U(64 - BUCKET_BITS)).astype(np.int32)) + np.int32(family << BUCKET_BITS)


def features(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, offsets by document) of each family of n-grams.

    Words keep their case. The second word of a bigram that repeats the first is read
    as such, so that repetition has one vector of its own.
    """
    s = scan.Scan(raw, at, lower=False)
    w, first = s.words, s.first
    before = np.zeros(len(w), U)
    if len(w):
        before[1:] = w[:-1]
        before[np.minimum(first[:-1][first[:-1] < len(w)], len(w) - 1)] = 0
    pair = np.where(before == w, U(0x5EED), scan.mix(before * U(3) + w))
    yield _bucket(scan.mix(pair), 0), first
    yield _bucket(w, 1), first
    # Where each character begins, in UTF-8, and the end of the last one.
    chars = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    from_ = np.searchsorted(chars, at)
    size = np.diff(from_)
    for k, n in enumerate(GRAMS):
        total = np.maximum(size - n + 1, 0)
        offsets = np.concatenate(([0], np.cumsum(total)))
        start = np.arange(offsets[-1]) + np.repeat(from_[:-1] - offsets[:-1], total)
        yield _bucket(s.hashes(chars[start], chars[start + n]), 2 + k), offsets


FAMILIES = 2 + len(GRAMS)


@dataclass
class Model:
    """The vectors projected on the softmax's difference of classes: averaging and output are linear."""

    weights: np.ndarray
    bias: float

    def score(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.zeros(len(at) - 1)
        for bucket, offsets in features(raw, at):
            total += scan.run_sums(self.weights[bucket], offsets) / np.maximum(np.diff(offsets), 1)
        return 1 / (1 + np.exp(-np.clip(total / FAMILIES + self.bias, -40, 40)))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct features of each document, as steps from one to the next, with their counts, both compressed."""
    for batch in batches:
        for i in range(batch.num_rows):
            for _, _, raw, at in scan.blocks(batch.column("text").slice(i, 1)):
                parts = [np.unique(bucket, return_counts=True) for bucket, _ in features(raw, at)]
                ids, counts = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, 1), batch.column("label").slice(i, 1), pa.array([len(ids)], pa.int64()), pa.array([scan.pack_numbers(np.diff(ids, prepend=0))], pa.binary()), pa.array([scan.pack_numbers(counts)], pa.binary())],
                    names=["doc_id", "label", "n", "ids", "counts"],
                )


def bag(n: int, ids: pa.Buffer, counts: pa.Buffer) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of a document and their shares of it; each family of n-grams that it has weighs the same."""
    i, c = np.cumsum(scan.unpack_numbers(ids, n).astype(np.int64)), scan.unpack_numbers(counts, n).astype(np.float64)
    family = i >> BUCKET_BITS
    return i, (c / (FAMILIES * np.maximum(np.bincount(family, c, FAMILIES), 1)[family])).astype(np.float32)


def _train(rows: list[tuple[int, int, pa.Buffer, pa.Buffer]], dim: int, epochs: int, rate: float, seed: int) -> Model:
    """SGD on the softmax's log loss, with AdaGrad's step for each bucket; one document a step."""
    rng = np.random.default_rng(seed)
    size = FAMILIES << BUCKET_BITS
    vectors = (rng.random((size, dim), np.float32) - np.float32(0.5)) * np.float32(2 / dim)
    out, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    out += rng.uniform(-0.1, 0.1, out.shape).astype(np.float32)
    past = np.full(size, 1e-6, np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(rows)):
            label, *packed = rows[i]
            ids, share = bag(*packed)
            v = vectors[ids]
            mean = share @ v
            logits = out @ mean + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1  # the gradient of the log loss
            back = p @ out
            g = share * np.float32(np.sqrt((back * back).sum()))
            past[ids] += g * g
            vectors[ids] = v - (step * share / np.sqrt(past[ids]))[:, None] * back[None, :]
            out -= step * 0.5 * np.outer(p, mean)
            bias -= step * 0.05 * p
    return Model((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(labelled: DataFrame, *, dim: int = 8, epochs: int = 5, rate: float = 0.3, seed: int = 1) -> Model:
    """Learns from ``labelled`` (doc_id, text, label 0/1), a table bounded in rows and bytes, over whole texts.

    Features are counted in parallel; one task, which holds those of the bounded rows in
    compressed form, trains. Null texts are empty. Without rows every score is one half.
    """
    bags = labelled.select("doc_id", "label", "text").mapInArrow(_bags, "doc_id long, label int, n long, ids binary, counts binary")

    def run(table: pa.Table) -> pa.Table:
        label = table.column("label").to_pylist()
        n = table.column("n").to_numpy()
        rows = [(y, int(k), i.as_buffer(), c.as_buffer()) for y, k, i, c in zip(label, n, table.column("ids"), table.column("counts"))]
        model = _train([rows[i] for i in np.lexsort((n, table.column("doc_id").to_numpy()))], dim, epochs, rate, seed)
        return pa.table({"weights": pa.array([model.weights.tobytes()], pa.binary()), "bias": [model.bias]})

    trained = bags.withColumn("task", F.col("label") * 0).groupBy("task").applyInArrow(run, "weights binary, bias double").collect()
    if not trained:
        return Model(np.zeros(FAMILIES << BUCKET_BITS, np.float32), 0.0)
    return Model(np.frombuffer(trained[0]["weights"], np.float32), trained[0]["bias"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of ``docs`` (doc_id, text): the probability of label 1.

    An empty or null text gets the score of the bias alone. Rows that repeat a doc_id
    each get a score; a null doc_id is kept; texts are read whole; further columns are
    not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # its size is fixed by the buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, at in scan.blocks(batch.column(1), 1 << 18):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(shared.value.score(raw, at))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, score double")


def of_quality(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose ``text`` scores at least the threshold, with all their columns.

    Null and empty texts have the score of the bias alone. Rows that repeat are judged
    each; texts are read whole; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(text: pa.Array) -> np.ndarray:
        parts = [shared.value.score(raw, at) >= threshold for _, _, raw, at in scan.blocks(text, 1 << 18)]
        return np.concatenate(parts) if parts else np.zeros(0, bool)

    return filter_text(docs, keep)
