"""Language-model scoring with a gated recurrent network.

Counts of all training words give every word a class: the most frequent words
are dealt to classes by rank, all others to tail classes by their first bytes.
The network predicts the class, then the word within its class: by a softmax
among frequent words, by smoothed counts in a tail class. It is trained by
truncated backpropagation in numpy, on every chunk of the corpus at once, and
the chunks' weights are averaged. Scoring carries the state across windows, so
that a document's log-likelihood covers all of its tokens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdure.llm import scan
from verdure.llm.store import Store

U = np.uint64
CLASSES, WORDS, TAILS, HIDDEN = 32, 32, 32, 24
TOP = CLASSES * WORDS
#: The hash that stands for the end of a document.
END = U(0xE0D)
WINDOW = 32
#: Parts of a chunk that are read side by side in training, at most.
WIDTH = 256
#: Chunks' weights that are averaged at once.
FAN = 32
Weights = dict[str, np.ndarray]

_CHUNK = "chunk long, doc_ids array<long>, held array<boolean>, sizes array<int>, tokens binary, words binary, tails binary, seen binary"


def _encode(docs_chunk: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a partition: its documents as numbers of its own dictionary, and the dictionary."""
    ids, held, sizes, hashes, tails, chunk = [], [], [], [], [], None
    for batch in docs_chunk:
        if not batch.num_rows:
            continue
        chunk = batch.column("chunk")[0].as_py()
        ids += batch.column("doc_id").to_pylist()
        held += batch.column("held").to_pylist()
        for _, _, raw, at in scan.blocks(batch.column("text")):
            s = scan.Scan(raw, at)
            n = np.diff(s.first)
            place = np.arange(len(s.starts)) + np.repeat(np.arange(len(n)), n)
            h, t = np.full(len(s.starts) + len(n), END, U), np.zeros(len(s.starts) + len(n), np.uint8)
            h[place] = s.words
            t[place] = (s.hashes(s.starts, np.minimum(s.starts + 3, s.ends)) % U(TAILS)).astype(np.uint8)
            hashes.append(h)
            tails.append(t)
            sizes.append(n + 1)
    if chunk is None:
        return
    n = np.concatenate(sizes).astype(np.int32)
    words, first, tokens = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    # The dictionary is in order of frequency, so that most tokens are small numbers.
    order = np.argsort(-np.bincount(tokens), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    tokens, words, first = place[tokens], words[order], first[order]
    learn = np.repeat(~np.array([bool(x) for x in held]), n)
    seen = np.bincount(tokens[learn], minlength=len(words))
    one = lambda x: pa.array([x], pa.binary())
    yield pa.RecordBatch.from_arrays([
        pa.array([chunk], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([[bool(x) for x in held]], pa.list_(pa.bool_())), pa.array([n.tolist()], pa.list_(pa.int32())),
        one(scan.pack_numbers(tokens)), one(words.tobytes()), one(np.concatenate(tails)[first].tobytes()), one(scan.pack_numbers(seen)),
    ], names=[f.split()[0] for f in _CHUNK.split(", ")])


def _dictionary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            words, tails = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("words", np.int64), ("tails", np.uint8)))
            seen = scan.unpack_numbers(batch.column("seen")[i].as_buffer(), len(words)).astype(np.int64)
            chunk = batch.column("chunk")[i].as_py()
            for lo in range(0, len(words), 100_000):
                part = slice(lo, lo + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words[part]), chunk)), pa.array(words[part]), pa.array(tails[part].astype(np.int32)), pa.array(seen[part])], names=["chunk", "word", "tail", "seen"])


def _sigmoid(x: np.ndarray) -> None:
    """In place."""
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x += np.float32(1)
    x *= np.float32(0.5)


def _logits(h: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(outputs, rows) less each row's largest: reductions over outputs then run along rows."""
    x = w.T @ h.T
    x += b[:, None]
    x -= x.max(axis=0)
    return x


def _picked(h: np.ndarray, w: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log-softmax of one output of each row."""
    x = _logits(h, w, b)
    out = x[at, np.arange(len(at))]
    np.exp(x, out=x)
    return out - np.log(x.sum(axis=0))


def _softmax(h: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(outputs, rows) of probabilities."""
    x = _logits(h, w, b)
    np.exp(x, out=x)
    x /= x.sum(axis=0)
    return x


def start(top_counts: np.ndarray, tail_mass: np.ndarray, seed: int = 1) -> Weights:
    """Weights whose biases give the unigram distribution from the first step on."""
    rng = np.random.default_rng(seed)
    small = lambda *shape: (rng.normal(size=shape) * 0.1).astype(np.float32)
    c = np.zeros(TOP)
    c[: len(top_counts)] = top_counts
    per = c.reshape(CLASSES, WORDS)
    inner = np.where(np.arange(TOP).reshape(CLASSES, WORDS) < len(top_counts), np.log(per + 0.5), -30.0)
    outer = np.log(np.concatenate([np.maximum(per.sum(axis=1), 1e-6), np.maximum(tail_mass, 1e-6)]))
    return {
        "x": small(TOP + TAILS, 3 * HIDDEN), "u": small(HIDDEN, 3 * HIDDEN), "b": np.concatenate([np.full(HIDDEN, -1.0), np.zeros(2 * HIDDEN)]).astype(np.float32),
        "c": small(HIDDEN, CLASSES + TAILS) * 0, "cb": outer.astype(np.float32), "w": small(CLASSES, HIDDEN, WORDS) * 0, "wb": inner.astype(np.float32),
    }


def step(p: Weights, h: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, tuple]:
    """One step of the gated unit: update, reset and candidate."""
    a = p["x"][symbols]
    a += p["b"]
    zr, n = a[:, : 2 * HIDDEN], a[:, 2 * HIDDEN :]
    zr += h @ p["u"][:, : 2 * HIDDEN]
    _sigmoid(zr)
    z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
    rh = r * h
    n += rh @ p["u"][:, 2 * HIDDEN :]
    np.tanh(n, out=n)
    new = n - h
    new *= z
    new += h
    return new, (h, z, r, rh, n)


def output(p: Weights, h: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Natural log-probability of each symbol's class, and of the word among a frequent class's words."""
    top = symbols < TOP
    cls = np.where(top, symbols // WORDS, CLASSES + symbols - TOP)
    out = _picked(h, p["c"], p["cb"], cls)
    here = np.flatnonzero(top)
    order = here[np.argsort(cls[here], kind="stable")]
    cut = np.searchsorted(cls[order], np.arange(CLASSES + 1))
    states, within = h[order], symbols[order] % WORDS
    for k in range(CLASSES):
        if cut[k] < cut[k + 1]:
            rows = slice(cut[k], cut[k + 1])
            out[order[rows]] += _picked(states[rows], p["w"][k], p["wb"][k], within[rows])
    return out


def gradients(p: Weights, h: np.ndarray, read: np.ndarray, want: np.ndarray) -> tuple[Weights, np.ndarray, float]:
    """Gradient of the mean loss over a window, by backpropagation to its start; the state at its end; the loss.

    ``read`` and ``want``: (steps, width) symbols that enter, and that are to be predicted.
    """
    steps, width = read.shape
    caches, states = [], []
    for k in range(steps):
        h, cache = step(p, h, read[k])
        caches.append(cache)
        states.append(h)
    hs, want = np.concatenate(states), want.reshape(-1)
    scale, every = h.dtype.type(1 / len(want)), np.arange(len(want))
    g = {k: np.zeros_like(x) for k, x in p.items()}
    top = want < TOP
    cls = np.where(top, want // WORDS, CLASSES + want - TOP)
    d = _softmax(hs, p["c"], p["cb"])
    loss = -float(np.log(np.maximum(d[cls, every], 1e-30)).sum())
    d[cls, every] -= 1
    d *= scale
    g["c"], g["cb"] = (d @ hs).T, d.sum(axis=1)
    dh_all = d.T @ p["c"].T
    here = np.flatnonzero(top)
    order = here[np.argsort(cls[here], kind="stable")]
    cut = np.searchsorted(cls[order], np.arange(CLASSES + 1))
    seen, within, back = hs[order], want[order] % WORDS, np.empty((len(order), HIDDEN), h.dtype)
    for k in range(CLASSES):
        if cut[k] < cut[k + 1]:
            rows = slice(cut[k], cut[k + 1])
            e = _softmax(seen[rows], p["w"][k], p["wb"][k])
            at = within[rows], np.arange(cut[k + 1] - cut[k])
            loss -= float(np.log(np.maximum(e[at], 1e-30)).sum())
            e[at] -= 1
            e *= scale
            g["w"][k], g["wb"][k] = (e @ seen[rows]).T, e.sum(axis=1)
            back[rows] = e.T @ p["w"][k].T
    dh_all[order] += back
    dh_all = dh_all.reshape(steps, width, HIDDEN)
    dh = np.zeros_like(h)
    gates = np.empty((steps, width, 3 * HIDDEN), h.dtype)
    u = p["u"]
    for k in range(steps - 1, -1, -1):
        h0, z, r, _, n = caches[k]
        dh = dh + dh_all[k]
        dn = dh * z * (1 - n * n)
        dz = dh * (n - h0) * z * (1 - z)
        drh = dn @ u[:, 2 * HIDDEN :].T
        dr = drh * h0 * r * (1 - r)
        gates[k] = np.concatenate([dz, dr, dn], axis=1)
        dh = dh * (1 - z) + drh * r + gates[k][:, : 2 * HIDDEN] @ u[:, : 2 * HIDDEN].T
    flat = gates.reshape(-1, 3 * HIDDEN)
    g["u"][:, : 2 * HIDDEN] = np.concatenate([c[0] for c in caches]).T @ flat[:, : 2 * HIDDEN]
    g["u"][:, 2 * HIDDEN :] = np.concatenate([c[3] for c in caches]).T @ flat[:, 2 * HIDDEN :]
    g["b"] = flat.sum(axis=0)
    symbols = read.reshape(-1)
    order = np.argsort(symbols, kind="stable")
    names, first = np.unique(symbols[order], return_index=True)
    g["x"][names] = np.add.reduceat(flat[order], first, axis=0)
    return g, h, loss * scale


def train(p: Weights, stream: np.ndarray, width: int, rate: float = 0.01) -> Weights:
    """Truncated backpropagation over ``stream`` cut into ``width`` parallel parts; Adam.

    Every token is predicted: a part's last step predicts the first token of the next, the last part's that of the stream.
    """
    p = {k: v.copy() for k, v in p.items()}
    if not len(stream):
        return p
    length = -(-len(stream) // width)
    grid = stream[(np.arange(length + 1)[:, None] + np.arange(width) * length) % len(stream)]
    m, v2 = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
    h = np.zeros((width, HIDDEN), np.float32)
    for t, lo in enumerate(range(0, length, WINDOW), 1):
        hi = min(lo + WINDOW, length)
        g, h, _ = gradients(p, h, grid[lo:hi], grid[lo + 1 : hi + 1])
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        clip = np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
        fix = rate * np.sqrt(1 - 0.99**t) / (1 - 0.9**t) * min(1.0, t / 20)
        for k in p:
            x = g[k] * clip
            m[k] += np.float32(0.1) * (x - m[k])
            v2[k] += np.float32(0.01) * (x * x - v2[k])
            p[k] -= np.float32(fix) * m[k] / (np.sqrt(v2[k]) + np.float32(1e-6))
    return p


def likelihoods(p: Weights, symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Natural log-probability that the network gives each document's symbols, state carried to its end.

    Documents are read side by side, longest first, so that those still running are a prefix.
    """
    at = np.concatenate(([0], np.cumsum(sizes)))
    order = np.argsort(-sizes, kind="stable")
    n, begin = sizes[order], at[:-1][order]
    out = np.zeros(len(sizes))
    h = np.zeros((len(sizes), HIDDEN), np.float32)
    held_h, held_s, held_d, held_n = [], [], [], 0

    def flush() -> None:
        nonlocal held_n
        if held_n:
            d = np.concatenate(held_d)
            np.add.at(out, order[d], output(p, np.concatenate(held_h), np.concatenate(held_s)))
            held_h.clear(), held_s.clear(), held_d.clear()
            held_n = 0

    end = int(symbols[at[1] - 1]) if len(sizes) else 0
    alive = np.searchsorted(-n, -np.arange(1, int(n.max(initial=0)) + 1), side="right")
    for t in range(int(n.max(initial=0))):
        b = alive[t]
        # A document starts as if another had just ended.
        before = symbols[begin[:b] + t - 1] if t else np.full(b, end)
        h, _ = step(p, h[:b], before)
        held_h.append(h)
        held_s.append(symbols[begin[:b] + t])
        held_d.append(np.arange(b))
        held_n += b
        if held_n >= 1 << 14:
            flush()
    flush()
    return out


@dataclass
class Vocabulary:
    """What all training tokens say: their number, their distinct words, the frequent ones, the mass of each tail class."""

    tokens: int
    distinct: int
    words: np.ndarray  # hashes of frequent words, sorted
    symbol: np.ndarray  # and their symbols
    counts: np.ndarray  # by symbol
    tail_mass: np.ndarray  # smoothed counts in each tail class; the unknown word is in the first

    @classmethod
    def of(cls, tokens: int, distinct: int, words: np.ndarray, tails: np.ndarray, counts: np.ndarray, mass: np.ndarray) -> Vocabulary:
        """From the frequent words, by rank, with their tail classes and counts, and each tail class's smoothed counts of all its words."""
        mass = mass - np.bincount(tails, counts + 0.5, TAILS)
        mass[0] += 0.5
        order = np.argsort(words)
        return cls(tokens, distinct, words[order], order.astype(np.int64), counts.astype(np.float64), np.maximum(mass, 1e-9))

    def tail(self, symbols: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Natural log-probability of each word within its tail class, by its count; 0 for a frequent word."""
        return np.where(symbols >= TOP, np.log((counts + 0.5) / self.tail_mass[np.maximum(symbols - TOP, 0)]), 0.0)

    def symbols(self, words: np.ndarray, tails: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
        out = TOP + tails.astype(np.int64)
        if counts is not None:
            out[counts == 0] = TOP
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            hit = self.words[at] == words
            out[hit] = self.symbol[at[hit]]
        return out


def _columns(batch: pa.RecordBatch, i: int) -> tuple:
    get = lambda c, t: np.frombuffer(batch.column(c)[i].as_buffer(), t)
    sizes = np.array(batch.column("sizes")[i].as_py(), np.int64)
    return np.array(batch.column("held")[i].as_py(), bool), sizes, scan.unpack_numbers(batch.column("tokens")[i].as_buffer(), int(sizes.sum())), get("words", np.uint64), get("tails", np.uint8)


def _mean(parts: list[tuple[float, bytes]]) -> tuple[float, np.ndarray]:
    """Tokens of all parts, and their weights' mean."""
    n, total = 0.0, None
    for tokens, w in parts:
        x = np.frombuffer(w, np.float32).astype(np.float64) * tokens
        n, total = n + tokens, x if total is None else total + x
    return n, (total / n).astype(np.float32)


def averaged(trained: DataFrame, store: Store, name: str) -> list[tuple[float, bytes]]:
    """At most FAN partial means of the chunks' weights; no task, and not the driver, reads more than FAN of them at once."""

    def mean(table: pa.Table) -> pa.Table:
        n, w = _mean([(n, w.as_buffer()) for n, w in zip(table.column("n").to_pylist(), table.column("w"))])
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "n": pa.array([n]), "w": pa.array([w.tobytes()], pa.binary())})

    level, width = 0, FAN
    while trained.count() > FAN:
        level += 1
        trained = store.save(trained.groupBy(F.expr(f"chunk div {width}")).applyInArrow(mean, "chunk long, n double, w binary"), f"{name}-{level}")
        width *= FAN
    parts = [(r["n"], bytes(r["w"])) for r in sorted(trained.collect())]
    store.drop(*[f"{name}-{k}" for k in range(1, level + 1)])
    return parts


def score(docs: DataFrame, held_out: str = "pmod(crc32(cast(doc_id as string)), 5) = 1", *, rounds: int = 2, chunk_bytes: int = 16_000_000) -> DataFrame:
    """Log10-probabilities of every whole text of ``docs`` (doc_id, text); rows with ``held_out`` teach nothing.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Tokens are
    words and one end; the base is the smoothed unigram of all training tokens. The score
    is a distribution over the same events: each known word, and one for all unknown ones.
    Counts and the network cover all training documents: of every chunk of the corpus,
    each of ``rounds`` rounds trains on a part, and the parts make up the chunk.

    A null or empty text is its end alone; texts of any length are read whole. Rows that
    repeat a doc_id are scored, and counted, each; a null doc_id is scored, not counted, and
    held out. Without training rows every word is unknown. An empty table gives no rows;
    further columns are not read.
    """
    spark = docs.sparkSession
    store = Store(spark, "lm")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long") + 8)).first()[0]
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    if not size:
        return spark.createDataFrame([], schema)
    chunks = int(max(1, size // min(chunk_bytes, max(size // 24, 1 << 18))))
    dealt = rows.withColumn("held", F.coalesce(F.expr(held_out), F.lit(True))).repartition(chunks, F.xxhash64("doc_id", F.crc32("text")))
    coded = store.save(dealt.withColumn("chunk", F.spark_partition_id().cast("long")).mapInArrow(_encode, _CHUNK), "chunks")

    entries = coded.select("chunk", "words", "tails", "seen").mapInArrow(_dictionary, "chunk long, word long, tail int, seen long")
    counts = store.save(entries.where("seen > 0").groupBy("word").agg(F.first("tail").alias("tail"), F.sum("seen").alias("c")), "counts")
    top = counts.orderBy(F.desc("c"), "word").limit(TOP).collect()
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    mass = np.zeros(TAILS)
    for r in counts.groupBy("tail").agg((F.sum("c") + 0.5 * F.count("*")).alias("m")).collect():
        mass[r["tail"]] = r["m"]
    known = Vocabulary.of(int(total), int(distinct), np.array([r["word"] for r in top], np.int64).view(U), np.array([r["tail"] for r in top], np.int64), np.array([r["c"] for r in top], np.int64), mass)

    weights = start(known.counts, known.tail_mass)
    names = list(weights)
    shapes = {k: v.shape for k, v in weights.items()}
    for turn in range(rounds if total else 0):

        def learn(batches: Iterator[pa.RecordBatch], p: Weights = weights, turn: int = turn) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    held, sizes, tokens, words, tails = _columns(batch, i)
                    symbols = known.symbols(words, tails)
                    at = np.concatenate(([0], np.cumsum(sizes)))
                    # The same order in every round, so that the rounds' parts cover the chunk.
                    rng = np.random.default_rng(batch.column("chunk")[i].as_py())
                    picked = rng.permutation(np.flatnonzero(~held))[turn::rounds]
                    if not len(picked):
                        continue
                    stream = symbols[np.concatenate([tokens[at[d] : at[d + 1]] for d in picked])]
                    new = train(p, stream, int(min(WIDTH, max(4, len(stream) // (100 * WINDOW)))))
                    yield pa.RecordBatch.from_arrays([batch.column("chunk").slice(i, 1), pa.array([float(len(stream))]), pa.array([b"".join(new[k].tobytes() for k in names)], pa.binary())], names=["chunk", "n", "w"])

        trained = store.save(coded.select("chunk", "held", "sizes", "tokens", "words", "tails").mapInArrow(learn, "chunk long, n double, w binary"), f"weights-{turn}")
        parts = averaged(trained, store, f"weights-{turn}")
        if parts:
            flat = _mean(parts)[1]
            cut = np.cumsum([0, *[int(np.prod(shapes[k])) for k in names]])
            weights = {k: flat[a:b].reshape(shapes[k]) for k, a, b in zip(names, cut, cut[1:])}
        store.drop(f"weights-{turn}")

    # Each chunk's dictionary gets the corpus's counts, packed in the dictionary's order.
    joined = entries.select("chunk", "word").join(counts.select("word", "c"), "word")

    def fold(table: pa.Table) -> pa.Table:
        word, c = table.column("word").to_numpy(), table.column("c").to_numpy()
        order = np.argsort(word.view(U))
        return pa.table({"chunk": table.column("chunk").slice(0, 1), "known": pa.array([word[order].tobytes()], pa.binary()), "c": pa.array([c[order].tobytes()], pa.binary())})

    folded = store.save(joined.groupBy("chunk").applyInArrow(fold, "chunk long, known binary, c binary"), "folded")

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                held, sizes, tokens, words, tails = _columns(batch, i)
                c = np.zeros(len(words), np.int64)
                if batch.column("known")[i].is_valid:
                    order = np.argsort(words)
                    at = np.searchsorted(words[order], np.frombuffer(batch.column("known")[i].as_buffer(), U))
                    c[order[at]] = np.frombuffer(batch.column("c")[i].as_buffer(), np.int64)
                at = np.concatenate(([0], np.cumsum(sizes)))
                base = np.log10((c + 0.5) / (known.tokens + 0.5 * (known.distinct + 1)))[tokens]
                symbols = known.symbols(words, tails, c)
                inner = known.tail(symbols, c)
                s = symbols[tokens]
                net = likelihoods(weights, s, sizes) + scan.run_sums(inner[tokens], at)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_ids")[i].values, pa.array(held), pa.array(sizes), pa.array(scan.run_sums((c > 0)[tokens], at).astype(np.int64)), pa.array(np.full(len(sizes), known.tokens)),
                    pa.array(np.add.reduceat(base, at[:-1])), pa.array(net / np.log(10)),
                ], names=[f.split()[0] for f in schema.split(", ")])

    return coded.join(folded, "chunk", "left").drop("seen").mapInArrow(evaluate, schema)
