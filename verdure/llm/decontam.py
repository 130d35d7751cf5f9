"""Benchmark decontamination by SimHash windows.

Every benchmark item has a 256-bit SimHash of its weighted shingles. Windows of
the item's number of words slide over each document. An index of several tables
holds the items' fingerprints by blocks of 16 bits, each under all values within
a few bits of its own: as not all blocks of two fingerprints within the radius
can differ in more, a window's 16 blocks look up every item within the radius.
An item that some table names for a window is measured by its whole
fingerprint, and verified by exact weighted-shingle similarity if that lies
within the radius.

Windows in which too few shingles occur in any item at all can be like none,
whatever the item, and get no fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from itertools import combinations
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdure.llm import scan
from verdure.llm.rows import filter_text

U = np.uint64
#: Items that are held at once, their tables taking 22 KB each; a larger benchmark is taken in blocks of so many.
ITEMS = 4096
#: Bits of a fingerprint and of its blocks.
BITS, BLOCK_BITS = 256, 16
#: Shingles whose signs are summed at once, and windows that are looked up at once.
RUN = 4096
_BITS = np.arange(64, dtype=U)
_SALT = scan.randoms(BITS // 64, 23)


def signs(hashes: np.ndarray) -> np.ndarray:
    """(n, BITS) of +1 and -1."""
    words = scan.mix(hashes[:, None] + _SALT)
    return ((((words[:, :, None] >> _BITS) & U(1)).astype(np.int32) << 1) - 1).reshape(len(hashes), BITS)


def pack_bits(sums: np.ndarray) -> np.ndarray:
    """(n, BITS / 64) words of the signs of (n, BITS) sums."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8")


def fingerprint(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(1, BITS / 64) words of the weighted shingles, a run at a time."""
    sums = np.zeros(BITS, np.int64)
    for lo in range(0, len(hashes), RUN):
        sums += (signs(hashes[lo : lo + RUN]) * counts[lo : lo + RUN, None]).sum(axis=0)
    return pack_bits(sums[None, :])


def window_fingerprints(shingles: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(n, BITS / 64) words of the windows, from running sums at their ends; a run of shingles is in memory at a time."""
    at, where = np.unique(np.concatenate((starts, ends)), return_inverse=True)
    held, sofar = np.zeros((len(at), BITS), np.int32), np.zeros(BITS, np.int32)
    for lo in range(int(at[0]), int(at[-1]) + 1, RUN):
        some = slice(*np.searchsorted(at, (lo, lo + RUN)))
        sums = np.zeros((min(RUN, len(shingles) - lo) + 1, BITS), np.int32)
        np.cumsum(signs(shingles[lo : lo + RUN]), axis=0, out=sums[1:])
        held[some] = sofar + sums[at[some] - lo]
        sofar = sofar + sums[-1]
    return pack_bits(held[where[len(starts) :]] - held[where[: len(starts)]])


def plain(raw: np.ndarray) -> np.ndarray:
    """The bytes with punctuation beyond ASCII blanked: U+00A0-00BF, U+2000-206F, U+3000-303F and full-width marks."""
    lead = np.flatnonzero((raw == 0xC2) | (raw == 0xE2) | (raw == 0xE3) | (raw == 0xEF))
    if not len(lead):
        return raw
    raw, x = raw.copy(), np.append(raw, np.zeros(2, np.uint8))
    a, b, c = x[lead], x[lead + 1], x[lead + 2]
    two = lead[(a == 0xC2) & (b >= 0xA0)]
    wide = (a == 0xEF) & (((b == 0xBC) & (((c >= 0x81) & (c <= 0x8F)) | ((c >= 0x9A) & (c <= 0xA0)) | (c >= 0xBB))) | ((b == 0xBD) & (((c >= 0x9B) & (c <= 0xA5)) | (c == 0x80))))
    three = lead[((a == 0xE2) & ((b == 0x80) | ((b == 0x81) & (c < 0xB0)))) | ((a == 0xE3) & (b == 0x80)) | wide]
    for k in range(2):
        raw[two + k] = 32
    for k in range(3):
        raw[three + k] = 32
    return raw


@dataclass
class Item:
    item_id: int
    keys: np.ndarray
    counts: np.ndarray
    total: int
    print: np.ndarray


class Index:
    """Items with their fingerprints in tables by block, and the shingles that any of them holds."""

    def __init__(self, items: list[tuple[int, str]], width: int, radius: int):
        self.radius, self.items = radius, []
        widths = []
        for item_id, text in items:
            for _, _, raw, at in scan.blocks(pc.utf8_lower(pa.array([text or ""]))):
                s = scan.Scan(plain(raw), at, punct=True)
                if not len(s.starts):
                    continue
                w = min(width, len(s.starts))
                h = scan.shingle_sets(s, w)[0]
                keys, counts = np.unique(h, return_counts=True)
                widths.append(w)
                self.items.append(Item(item_id, keys, counts, len(h), fingerprint(keys, counts)))
        self.width, self.total = np.array(widths, np.int64), np.array([i.total for i in self.items], np.int64)
        self.prints = np.concatenate([i.print for i in self.items]) if self.items else np.zeros((0, BITS // 64), U)
        #: By shingle width: the sorted shingles of all items, and the items' numbers of them.
        self.keys = {int(w): np.unique(np.concatenate([i.keys for i, v in zip(self.items, widths) if v == w])) for w in np.unique(self.width)}
        self.sizes = {int(w): np.unique(self.total[self.width == w]) for w in np.unique(self.width)}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "tables"}  # each process makes its own

    @cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """For each block, where the items of each of its values begin, and these items: those whose block differs in ``radius`` // blocks bits at most."""
        bits = self.radius // (BITS // BLOCK_BITS)
        near = np.array([sum(1 << b for b in some) for n in range(bits + 1) for some in combinations(range(BLOCK_BITS), n)], np.uint16)
        blocks = self.prints.view("<u2")
        starts, held = np.zeros((blocks.shape[1], (1 << BLOCK_BITS) + 1), np.int64), np.zeros((blocks.shape[1], len(blocks) * len(near)), np.uint16)
        of = np.repeat(np.arange(len(blocks), dtype=np.uint16), len(near))
        for j in range(blocks.shape[1]):
            values = (blocks[:, j, None] ^ near).reshape(-1)
            held[j] = of[np.argsort(values, kind="stable")]
            starts[j, 1:] = np.cumsum(np.bincount(values, minlength=1 << BLOCK_BITS))
        return starts, held

    def lookup(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item): every pair that a table names, once."""
        starts, held = self.tables
        found = []
        for j, value in enumerate(prints.view("<u2").T.astype(np.int64)):
            lo = starts[j, value]
            n = starts[j, value + 1] - lo
            at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append(np.repeat(np.arange(len(prints)), n) * len(self.items) + held[j, at])
        window, item = np.divmod(np.unique(np.concatenate(found)), max(1, len(self.items)))
        return window, item

    def windows(self, flagged: np.ndarray, w: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
        """Starts and sizes of a document's windows in which enough shingles occur in items; ``flagged`` has their running number."""
        m = len(flagged) - 1
        totals = self.sizes[w]
        starts, sizes = [], []
        for size in np.unique(np.minimum(totals[totals * similarity <= m], m)):
            # A window like some item shares so many shingles with it.
            least = 2 * size * similarity / (1 + similarity) - 1e-6
            at = np.flatnonzero(flagged[size:] - flagged[: m - size + 1] >= least)
            starts.append(at)
            sizes.append(np.full(len(at), size))
        return (np.concatenate(starts), np.concatenate(sizes)) if starts else (np.zeros(0, np.int64),) * 2

    def search(self, raw: np.ndarray, at: np.ndarray, similarity: float) -> list[tuple[int, int, float, int, int, int, int, int]]:
        """(document, item_id, similarity, distance, first word, words, first byte, last byte + 1): the best window of each pair."""
        s = scan.Scan(plain(raw), at, punct=True)
        best: dict[tuple[int, int], tuple] = {}
        for w, keys in self.keys.items():
            h, offsets, _ = scan.shingle_sets(s, w)
            if not len(h):
                continue
            may = np.zeros(1 << 16, bool)
            may[(keys >> U(48)).astype(np.int64)] = True
            hits = np.flatnonzero(may[(h >> U(48)).astype(np.int64)])
            hits = hits[keys[np.minimum(np.searchsorted(keys, h[hits]), len(keys) - 1)] == h[hits]]
            if not len(hits):
                continue
            flag = np.zeros(len(h) + 1, np.int64)
            flag[hits + 1] = 1
            np.cumsum(flag, out=flag)
            for d in np.flatnonzero(np.diff(flag[offsets])):
                a, b = int(offsets[d]), int(offsets[d + 1])
                starts, sizes = self.windows(flag[a : b + 1] - flag[a], w, similarity)
                order = np.argsort(starts, kind="stable")
                near: dict[int, list] = {}
                for lo in range(0, len(order), RUN):
                    some = order[lo : lo + RUN]
                    for item, start, far in self.near(h[a:b], starts[some], sizes[some], w):
                        near.setdefault(item, []).append((start, far))
                for k, found in near.items():
                    item = self.items[k]
                    row = self.verified(item, h[a:b], found, similarity)
                    if row:
                        alike, far, start, size = row
                        words, first_word = min(size + w - 1, int(s.first[d + 1] - s.first[d])), int(s.first[d]) + start
                        row = (alike, -far, -start, words, int(s.starts[first_word] - at[d]), int(s.ends[first_word + words - 1] - at[d]))
                        if (d, item.item_id) not in best or row > best[d, item.item_id]:
                            best[d, item.item_id] = row
        return [(int(d), item, alike, -far, -start, words, x, y) for (d, item), (alike, far, start, words, x, y) in sorted(best.items())]

    def near(self, shingles: np.ndarray, starts: np.ndarray, sizes: np.ndarray, w: int) -> Iterator[tuple[int, int, int]]:
        """(item, start, distance) of the windows within the radius of an item of their size."""
        prints = window_fingerprints(shingles, starts, starts + sizes)
        window, item = self.lookup(prints)
        fits = (self.width[item] == w) & (np.minimum(self.total[item], len(shingles)) == sizes[window])
        window, item = window[fits], item[fits]
        far = np.bitwise_count(prints[window] ^ self.prints[item]).sum(axis=1, dtype=np.int64)
        for k in np.flatnonzero(far <= self.radius):
            yield int(item[k]), int(starts[window[k]]), int(far[k])

    def verified(self, item: Item, shingles: np.ndarray, found: list[tuple[int, int]], similarity: float) -> tuple[float, int, int, int] | None:
        """(similarity, distance, start, size) of the best of an item's windows; None if none is similar enough.

        Windows are taken by how many of their shingles the item holds at all, which
        no similarity exceeds, so that most need no look.
        """
        start, far = np.array(found, np.int64).T
        size = min(item.total, len(shingles))
        ours = np.zeros(len(shingles) + 1, np.int64)
        np.cumsum(item.keys[np.minimum(np.searchsorted(item.keys, shingles), len(item.keys) - 1)] == shingles, out=ours[1:])
        most = np.minimum(ours[start + size] - ours[start], size)
        best = None
        for k in np.lexsort((start, far, -most)):
            bound = most[k] / (item.total + size - most[k])
            if bound < similarity or (best is not None and bound < best[0]):
                break
            got, counts = np.unique(shingles[start[k] : start[k] + size], return_counts=True)
            where = np.minimum(np.searchsorted(item.keys, got), len(item.keys) - 1)
            common = int(np.minimum(counts, item.counts[where])[item.keys[where] == got].sum())
            row = common / (item.total + size - common), -int(far[k]), -int(start[k])
            if row[0] >= similarity and (best is None or row > best):
                best = row
        return (best[0], -best[1], -best[2], size) if best else None


_FOUND = "doc_id long, item_id long, similarity double, hamming int, first_word long, n_words long, first_byte long, end_byte long"


def _indexes(benchmark: DataFrame, width: int, radius: int) -> Iterator[Index]:
    """One index for each block of items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    blocks = -(-items.count() // ITEMS)
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else items
        yield Index(sorted((r.item_id, r.text) for r in part.collect()), width, radius)


def contaminated(docs: DataFrame, benchmark: DataFrame, *, width: int = 5, similarity: float = 0.8, radius: int = 63) -> DataFrame:
    """The best window of each pair of a document and an item that it holds, over all ``docs`` (doc_id, text).

    Returns doc_id, item_id, similarity, hamming, first_word, n_words, first_byte, end_byte
    (bytes of the lower-cased text). A window has as many words as the item, or the whole
    text if that is shorter. The similarity is sum of minima over sum of maxima of the
    counts of ``width``-word shingles, in lower case and without punctuation; an item of
    fewer words is one shingle. Fingerprints of windows of similarity 0.8 differ in 39 of 256
    bits on average, with a deviation of 5.7; those within ``radius`` are all found. Null
    and wordless texts or items match nothing; rows that repeat a doc_id match each;
    texts of any length are read whole; further columns are not read; an empty table gives
    no rows. Long items and texts are held as shingles; fingerprints are summed in runs. A
    benchmark too large to hold is taken in blocks.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = docs.sparkSession.createDataFrame([], _FOUND)
    for index in _indexes(benchmark, width, radius):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, _, raw, at in scan.blocks(pc.utf8_lower(batch.column(1))):
                    found = index.search(raw, at, similarity)
                    if found:
                        ids = batch.column(0)
                        columns = [[ids[lo + f[0]].as_py() for f in found], *([f[k] for f in found] for k in range(1, 8))]
                        types = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), *[pa.int64()] * 4)
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "item_id", "similarity", "hamming", "first_word", "n_words", "first_byte", "end_byte"])

        out = out.union(rows.mapInArrow(run, _FOUND))
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, *, width: int = 5, similarity: float = 0.8, radius: int = 63) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item, with all their columns.

    Null and wordless texts hold none. Rows that repeat are judged each; an empty table
    gives no rows.
    """
    for index in _indexes(benchmark, width, radius):

        def keep(text: pa.Array, index: Index = index) -> np.ndarray:
            clean = np.ones(len(text), bool)
            for lo, _, raw, at in scan.blocks(pc.utf8_lower(text)):
                clean[[lo + f[0] for f in index.search(raw, at, similarity)]] = False
            return clean

        docs = filter_text(docs, keep)
    return docs
