"""Toxicity: token log-odds, maximum-scoring segments, extreme-value calibration.

Each token has signed log-odds between the word distributions of toxic and other
documents, with a chain of Dirichlet priors: the whole corpus, then the word's
prefixes of growing length, then the word. A linear scan over a document's
tokens finds all maximal-scoring segments of log-odds less a constant; their
scores are turned to significance by the extreme-value law that scores of
harmless documents follow, and a logistic calibration makes that a score.
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
from verdure.llm.store import Store

U = np.uint64
#: Lengths, in bytes, of the prefixes that stand behind a word.
PREFIXES = (3, 4, 5, 6, 7, 8)
#: -ln of the number of passages as good that a harmless text of the same length may have by chance.
SIGNIFICANT = 2.3
#: Words that a text counts as at least, and the evidence of a text without any segment.
SHORT, NOTHING = 50, -6.0
#: Tokens back to which a word's repeats count for less.
NEAR = 50
#: Log-odds nearer than this to those of the prefix behind are left to it.
SAME = 0.05


def levels(s: scan.Scan) -> list[np.ndarray]:
    """Hashes of each word's prefixes, shortest first, and of the word itself; 0 where a word is too short."""
    size = s.ends - s.starts
    out = []
    for k in PREFIXES:
        h = s.hashes(s.starts, np.minimum(s.starts + k, s.ends))
        out.append(np.where(size > k, h, U(0)))
    return [*out, s.words ^ U(1)]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments of a sequence of signed scores, in linear time: first token, last, score."""
    total = np.concatenate(([0.0], np.cumsum(scores)))
    up = np.concatenate(([False], scores > 0, [False]))
    first, last = np.flatnonzero(up[1:-1] & ~up[:-2]), np.flatnonzero(up[1:-1] & ~up[2:])
    # first token, last, total before, total after, place of the nearest entry that starts lower
    stack: list[tuple[int, int, float, float, int]] = []
    for a, b, left, right in zip(first.tolist(), last.tolist(), total[first].tolist(), total[last + 1].tolist()):
        j = len(stack) - 1
        while j >= 0 and stack[j][2] >= left:
            j = stack[j][4]
        while j >= 0 and stack[j][3] < right:
            a, left, under = stack[j][0], stack[j][2], stack[j][4]
            del stack[j:]
            j = under
        stack.append((a, b, left, right, j))
    return [(a, b, hi - lo) for a, b, lo, hi, _ in stack]


@dataclass
class Model:
    keys: np.ndarray
    odds: np.ndarray
    drift: float
    lam: float
    k: float
    slope: float
    offset: float

    def weights(self, s: scan.Scan) -> np.ndarray:
        """Log-odds of each token: those of the word, or else of its longest known prefix; 0 if neither is known."""
        out = np.zeros(len(s.starts), np.float64)
        if not len(self.keys) or not len(out):
            return out
        if not hasattr(self, "_known"):
            self._known = np.zeros(1 << 22, bool)
            self._known[(self.keys >> U(42)).astype(np.int64)] = True
        for h in levels(s):
            may = np.flatnonzero(self._known[(h >> U(42)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, h[may]), len(self.keys) - 1)
            hit = self.keys[at] == h[may]
            out[may[hit]] = self.odds[at[hit]]
        return out

    def worth(self, scores: np.ndarray, words: int) -> np.ndarray:
        """-ln of the number of segments that score as high in a harmless text of so many words."""
        return self.lam * np.asarray(scores, np.float64) - np.log(self.k * max(words, SHORT))

    def evidence(self, scores: np.ndarray, words: int) -> float:
        """The significant segments' worth together, or else that of the best segment."""
        worth = self.worth(scores, words)
        return float(max(worth[worth >= SIGNIFICANT].sum() or NOTHING, worth.max(initial=NOTHING)))

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.offset, -40, 40)))


def log_odds(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], base: float, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and signed log-odds; a level has (own, parent, toxic, other), parents are in the levels before.

    ``prior`` pseudo-counts are dealt to the two classes as the parent's odds have it, so that
    the odds are those of the classes' smoothed distributions: (c1 + prior * p) / N1 over
    (c0 + prior * (1 - p)) / N0, ``base`` being N1's share. A key that says no more than
    its parent is left out, but never one that has kept children to overrule.
    """
    known, share = np.zeros(0, U), np.zeros(0)
    base_odds = np.log(base / (1 - base))
    out_k, out_o = [], []
    for own, parent, c1, c0 in levels:
        p0 = np.full(len(own), base)
        if len(known) and len(own):
            at = np.minimum(np.searchsorted(known, parent), len(known) - 1)
            p0 = np.where(known[at] == parent, share[at], base)
        p = (c1 + prior * p0) / (c1 + c0 + prior)
        odds = np.log(p / (1 - p)) - base_odds
        tell = np.abs(odds - (np.log(p0 / (1 - p0)) - base_odds)) >= SAME
        # What is left out reads as its parent, and so do its own children.
        p = np.where(tell, p, p0)
        out_k.append(own[tell])
        out_o.append(odds[tell])
        known, first = np.unique(np.concatenate([own, known]), return_index=True)
        share = np.concatenate([p, share])[first]
    k, o = np.concatenate(out_k), np.concatenate(out_o)
    k, first = np.unique(k, return_index=True)
    return k, o[first]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class by word, with the word's prefixes."""
    for batch in batches:
        label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int64)
        for lo, hi, raw, at in scan.blocks(batch.column("text")):
            s = scan.Scan(raw, at, punct=True)
            *prefixes, own = levels(s)
            if not len(own):
                continue
            d = s.document()
            order = np.lexsort((d, own))
            new = np.ones(len(order), bool)
            new[1:] = (d[order][1:] != d[order][:-1]) | (own[order][1:] != own[order][:-1])
            order = order[new]
            key, first = np.unique(own[order], return_index=True)
            ones = np.add.reduceat(label[lo + d[order]], first)
            n = np.diff(np.append(first, len(order)))
            under = np.stack([p[order[first]] for p in prefixes], axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(key.view(np.int64)), pa.ListArray.from_arrays(pa.array(np.arange(len(key) + 1) * len(PREFIXES), pa.int32()), pa.array(under.reshape(-1))), pa.array(ones), pa.array(n - ones),
            ], names=["key", "prefixes", "toxic", "other"])


def _tables(learn: DataFrame) -> DataFrame:
    """(level, key, parent, toxic, other) of words by documents, and of prefixes by the words under them.

    A prefix counts each word once, shared between the classes as that word's documents
    are, so that one frequent word doesn't speak for all that begin like it.
    """
    words = learn.mapInArrow(_counts, "key long, prefixes array<long>, toxic long, other long").groupBy("key").agg(F.first("prefixes").alias("prefixes"), F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    share = F.col("toxic") / (F.col("toxic") + F.col("other"))
    under = words.select(F.posexplode("prefixes").alias("level", "key"), "prefixes", share.alias("share")).where("key <> 0")
    parent = F.when(F.col("level") > 0, F.get("prefixes", F.col("level") - 1)).otherwise(F.lit(0).cast("long"))
    by_prefix = under.select("level", "key", parent.alias("parent"), "share").groupBy("level", "key", "parent").agg(F.sum("share").alias("toxic"), F.sum(1 - F.col("share")).alias("other"))
    last = F.aggregate("prefixes", F.lit(0).cast("long"), lambda a, x: F.when(x != 0, x).otherwise(a))
    by_word = words.select(F.lit(len(PREFIXES)).alias("level"), "key", last.alias("parent"), F.col("toxic").cast("double"), F.col("other").cast("double"))
    return by_prefix.union(by_word)


def repeats(words: np.ndarray, document: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How often each token's word stood among the ``NEAR`` tokens before it in its document; ``at`` are the tokens' places."""
    order = np.lexsort((at, words, document))
    new = np.ones(len(order), bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (document[order][1:] != document[order][:-1])
    group = np.cumsum(new) - 1
    # Places of different groups lie farther apart than any two of one.
    place = group * (int(at.max(initial=0)) + NEAR + 2) + at[order]
    out = np.zeros(len(order), np.int64)
    out[order] = np.arange(len(order)) - np.searchsorted(place, place - NEAR)
    return out


def _scanned(model: Model, raw: np.ndarray, at: np.ndarray) -> tuple[scan.Scan, list[list[tuple[int, int, float]]]]:
    """Words and segments of each document. Every token counts; one whose word stood n times shortly before counts for an (n + 1)th, so that no repeated word makes a passage by itself."""
    s = scan.Scan(raw, at, punct=True)
    w = model.weights(s)
    up = np.flatnonzero(w > 0)
    w[up] /= 1.0 + repeats(s.words[up], s.document()[up], up)
    w -= model.drift
    return s, [segments(w[a:b]) if b > a else [] for a, b in zip(s.first[:-1], s.first[1:])]


def read(model: Model, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[dict]]]:
    """Words, best segment's score, evidence and significant passages of each document."""
    s, found = _scanned(model, raw, at)
    n = np.diff(s.first).astype(np.int64)
    evidence, best, spans = np.full(len(n), NOTHING), np.zeros(len(n)), [[] for _ in n]
    for d, segs in enumerate(found):
        if not segs:
            continue
        x = np.array([g[2] for g in segs])
        best[d], evidence[d] = x.max(), model.evidence(x, int(n[d]))
        worth, a = model.worth(x, int(n[d])), s.first[d]
        for k in np.flatnonzero(worth >= SIGNIFICANT):
            i, j, _ = segs[k]
            spans[d].append({"first_word": i, "last_word": j, "start_byte": int(s.starts[a + i] - at[d]), "end_byte": int(s.ends[a + j] - at[d]), "evidence": float(worth[k])})
    return n, best, evidence, spans


def without_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose ``text`` scores below the threshold, with all their columns.

    Null, empty and wordless texts score as texts without any segment. Rows that repeat
    are judged each; texts are read whole; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(text: pa.Array) -> np.ndarray:
        parts = [shared.value.score(read(shared.value, raw, at)[2]) < threshold for _, _, raw, at in scan.blocks(text)]
        return np.concatenate(parts) if parts else np.zeros(0, bool)

    return filter_text(docs, keep)


_SPANS = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("start_byte", pa.int64()), ("end_byte", pa.int64()), ("evidence", pa.float64())]))
_ADDED = "n_words long, best double, evidence double, score double, passages array<struct<first_word:long,last_word:long,start_byte:long,end_byte:long,evidence:double>>"


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset by Newton's method; evidence beyond 60 counts as 60."""
    z = np.stack([np.minimum(x, 60) / 10, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2), z.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / 10), float(w[1])


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with a key that near copies are likely to share: two minima of hashed shingles."""
    for batch in batches:
        keys = []
        for _, _, raw, at in scan.blocks(batch.column("text")):
            h, runs, _ = scan.shingle_sets(scan.Scan(raw, at), 3)
            least = np.zeros((len(at) - 1, 2), np.uint64)
            full = np.flatnonzero(np.diff(runs))
            if len(full):
                edges = np.append(runs[:-1][full], runs[-1])
                least[full, 0] = np.minimum.reduceat(h, edges[:-1])
                least[full, 1] = np.minimum.reduceat(scan.mix(h ^ U(0x77)), edges[:-1])
            keys.append(scan.mix(least[:, 0] * U(3) + least[:, 1]).view(np.int64))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))], names=[*batch.schema.names, "near"])


def _segments(shared):
    """Label, words and all segments' scores of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, at in scan.blocks(batch.column("text")):
                s, found = _scanned(shared.value, raw, at)
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(lo, hi - lo), pa.array(np.diff(s.first).astype(np.int64)), pa.array([[x for _, _, x in f] for f in found], pa.list_(pa.float64()))], names=["label", "n_words", "scores"])

    return run


def extreme_value_law(scores: np.ndarray, words: float) -> tuple[float, float]:
    """(lambda, k) such that harmless texts of so many words have k * words * exp(-lambda * x) segments that score x or more.

    From the upper tenth of their segments, an exponential tail.
    """
    if len(scores) < 20:
        return 1.0, 0.01
    s = np.sort(scores)[::-1]
    n = max(20, len(s) // 10)
    level = s[min(n, len(s) - 1)]
    lam = float(np.clip(1 / max((s[:n] - level).mean(), 0.2), 0.1, 5.0))
    return lam, float(np.clip(n * np.exp(lam * level) / max(words, 1), 1e-9, 1.0))


def fit(labelled: DataFrame, *, prior: float = 4.0, drift: float = 0.8) -> Model:
    """Learns from ``labelled`` (doc_id, text, label 0/1), a bounded table, over whole texts.

    Of near copies that of the smallest doc_id counts. Log-odds come from three fifths of the rest, the
    extreme-value law and the calibration from the others. ``drift`` is what a token of
    neither class costs, so that harmless text scores below zero. Null texts are empty.
    With one class only, or no rows, every score is that class's share.
    """
    spark = labelled.sparkSession
    keyed = labelled.select("doc_id", F.col("text").cast("string").alias("text"), F.col("label").cast("int").alias("label"))
    keyed = keyed.mapInArrow(_distinct, "doc_id long, text string, label int, near long").groupBy("near", "label").agg(F.min(F.struct("doc_id", "text"))["text"].alias("text"))
    # Kept once, so that counts, odds and calibration are of the same texts.
    store = Store(spark, "toxicity-fit")
    rows = store.save(keyed, "distinct", 0).withColumn("part", F.pmod(F.xxhash64("near", F.lit(6)), F.lit(5)))
    learn = rows.where("part > 1").select("label", "text")
    size = {r["label"]: r["count"] for r in learn.groupBy("label").count().collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    # Keys and counts of the bounded rows' words.
    table = _tables(learn).toArrow()
    level, key, parent, toxic, other = (table.column(c).to_numpy() for c in ("level", "key", "parent", "toxic", "other"))
    words = level == len(PREFIXES)
    total = float(toxic[words].sum()), float(other[words].sum())
    base = min(max((total[0] + 0.5) / (sum(total) + 1), 1e-4), 1 - 1e-4)
    keys, odds = log_odds([(key[here].view(U), parent[here].view(U), toxic[here], other[here]) for here in (level == k for k in range(len(PREFIXES) + 1))], base, prior)
    if not (n1 and n0):
        keys, odds = keys[:0], odds[:0]
    share = min(max((n1 + 0.5) / (n1 + n0 + 1), 1e-4), 1 - 1e-4)
    model = Model(keys, odds, drift, 1.0, 0.01, 0.0, float(np.log(share / (1 - share))))
    held = rows.where("part <= 1").select("label", "text").mapInArrow(_segments(spark.sparkContext.broadcast(model)), "label int, n_words long, scores array<double>").toArrow()
    label, n_words = held.column("label").to_numpy().astype(float), held.column("n_words").to_numpy()
    scores = [np.asarray(x.values) for x in held.column("scores")]
    calm = label == 0
    model.lam, model.k = extreme_value_law(np.concatenate([np.zeros(0), *[x for x, c in zip(scores, calm) if c]]), float(np.maximum(n_words[calm], 1).sum()))
    if n1 and n0 and calm.any() and not calm.all():
        model.slope, model.offset = _logistic(np.array([model.evidence(x, int(n)) for x, n in zip(scores, n_words)]), label)
        model.slope = max(model.slope, 0.0)
    store.drop("distinct")
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, n_words, best, evidence, score and passages for every row of ``docs`` (doc_id, text).

    Null, empty and wordless texts have no segment, best 0 and the score of that. Rows that
    repeat a doc_id are scored each; a null doc_id is kept; texts are read whole; further
    columns are not read; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, at in scan.blocks(batch.column(1)):
                words, best, evidence, spans = read(shared.value, raw, at)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(words), pa.array(best), pa.array(evidence), pa.array(shared.value.score(evidence)), pa.array(spans, _SPANS)],
                    names=["doc_id", "n_words", "best", "evidence", "score", "passages"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + _ADDED)
