"""Best-fit packing of tokenised documents: minimum bin slack.

A bin starts with the longest piece left and takes the fullest feasible
combination of the lengths still available, found by subset-sum dynamic
programming over bitsets; that combination is then removed, as often as the
counts allow. The search needs only how many pieces have each length, at most
``capacity`` numbers, so that the driver's work doesn't grow with the corpus.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdure.llm.store import Store

Pattern = tuple[tuple[tuple[int, int], ...], int]
#: White space that the fast engine isn't given: its pattern takes the square of a run's length, and its stack ends between 100,000 and 1,000,000 characters.
LONG_RUN = re.compile(r"\s{100}")


def fullest(counts: np.ndarray, room: int) -> list[tuple[int, int]]:
    """(length, uses) with the largest sum up to ``room``, longer lengths preferred; no length more often than counted."""
    reach, steps = 1, []
    everything = (1 << (room + 1)) - 1
    for length in range(min(room, len(counts) - 1), 0, -1):
        left, part = min(int(counts[length]), room // length), 1
        while left > 0:
            take = min(part, left)
            steps.append((reach, length, take))
            reach |= (reach << (take * length)) & everything
            left -= take
            part *= 2
        if reach >> room & 1:
            break
    at, uses = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            at -= take * length
            uses[length] = uses.get(length, 0) + take
    return sorted(uses.items(), reverse=True)


def minimum_bin_slack(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Bins as (combination, times); together they hold each length as often as counted."""
    counts = np.array(counts, np.int64)
    bins: list[Pattern] = []
    longest = capacity
    while True:
        while longest and not counts[longest]:
            longest -= 1
        if not longest:
            return bins
        counts[longest] -= 1
        uses = dict(fullest(counts, capacity - longest))
        counts[longest] += 1
        uses[longest] = uses.get(longest, 0) + 1
        times = min(int(counts[length]) // n for length, n in uses.items())
        for length, n in uses.items():
            counts[length] -= n * times
        bins.append((tuple(sorted(uses.items(), reverse=True)), times))


class Slots:
    """Where the k-th piece of a length goes: its sequence and its offset there."""

    def __init__(self, bins: list[Pattern], capacity: int):
        ranges: list[list[tuple[int, int, int, int]]] = [[] for _ in range(capacity + 1)]
        seen = np.zeros(capacity + 1, np.int64)
        sequence = 0
        for uses, times in bins:
            offset = 0
            for length, n in uses:
                ranges[length].append((int(seen[length]), n, sequence, offset))
                seen[length] += n * times
                offset += n * length
            sequence += times
        self.sequences = sequence
        self.ranges = [np.array(r, np.int64).reshape(-1, 4) for r in ranges]

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for length in np.unique(lengths):
            here = np.flatnonzero(lengths == length)
            ranges, rank = self.ranges[length], ranks[here]
            k = np.searchsorted(ranges[:, 0], rank, side="right") - 1
            within = rank - ranges[k, 0]
            sequence[here] = ranges[k, 2] + within // ranges[k, 1]
            offset[here] = ranges[k, 3] + within % ranges[k, 1] * length
        return sequence, offset


@lru_cache(maxsize=1)
def encoder(path: str):
    """text -> uint32 ids, as ``tokenizers`` gives them without added special tokens.

    A byte-level BPE whose ids follow its merges is run by the tiktoken engine, some
    five times as fast for the same ids. Texts with a special token's string or a very
    long run of white space, at which that engine's pattern gives up, and other
    tokenizers go through ``tokenizers`` itself.
    """
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)

    def plain(text: str) -> np.ndarray:
        return np.array(own.encode(text, add_special_tokens=False).ids, np.uint32)

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = [x["content"] for x in spec.get("added_tokens") or []]
    vocabulary, merges = spec["model"].get("vocab"), spec["model"].get("merges")
    if spec["model"].get("type") != "BPE" or "ByteLevel" not in json.dumps(spec.get("pre_tokenizer")) or spec.get("normalizer"):
        return plain
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
    if any(vocabulary[a + b] != 256 + i for i, (a, b) in enumerate(pairs)):
        return plain
    import tiktoken

    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in printable)}
    ranks = {bytes(alphabet[c] for c in token): i for token, i in vocabulary.items() if token not in special}
    # Fixed value: the pattern that byte-level pre-tokenizers split by.
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def quick(text: str) -> np.ndarray:
        if any(s in text for s in special) or LONG_RUN.search(text):
            return plain(text)
        return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), np.uint32)

    return quick


def _pieces(path: str, end: int, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                docs, rows, ids = batch.slice(lo, 512), [], []
                for doc_id, text in zip(docs.column(0).to_pylist(), docs.column(1)):
                    got = np.append(encode(text.as_py()) if text.is_valid else np.zeros(0, np.uint32), np.uint32(end)).astype("<u4")
                    stops = [*range(len(got), 0, -capacity), 0][::-1]
                    for piece, (a, b) in enumerate(zip(stops, stops[1:])):
                        data = got[a:b].tobytes()
                        rows.append((doc_id, piece, a, b - a, zlib.crc32(data)))
                        ids.append(data)
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                if keep_ids:
                    columns.append(pa.array(ids, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids])

    return run


def pack(docs: DataFrame, tokenizer: str, *, end: int = 2, capacity: int = 1024, keep_ids: bool = False) -> DataFrame:
    """Packs all rows of ``docs`` (doc_id, text) into few sequences of at most ``capacity`` tokens.

    One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset,
    and, with ``keep_ids``, its ids as little-endian unsigned 32-bit numbers. A null
    or empty text is its end token alone. Only documents longer than ``capacity`` are
    cut, from the end, so that the first piece is the shorter one. Texts of any length
    are read whole. Rows that repeat a doc_id are packed each; a null doc_id is kept. An
    empty table gives no rows. Further columns are not read.
    """
    store = Store(docs.sparkSession, "pack")
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    text = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = store.save(text.mapInArrow(_pieces(tokenizer, end, capacity, keep_ids), schema), "pieces")

    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[row["length"]] = row["count"]
    slots = Slots(minimum_bin_slack(counts, capacity), capacity)

    # Ranks within a length: within many small buckets first, then the buckets' counts are added up.
    buckets = int(min(4096, max(64, counts.sum() // 2000)))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("bucket", "length").count().select("bucket", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = dealt.withColumn("n", F.row_number().over(within) - 1).join(bases, ["bucket", "length"]).withColumn("rank", F.col("base") + F.col("n"))

    names = [f.name for f in T._parse_datatype_string(schema).fields]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = slots.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.select(*names, "rank").mapInArrow(place, schema + ", sequence_id long, offset long")
