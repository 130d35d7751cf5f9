"""Vectorised scanning of text columns, straight from Arrow buffers.

A word is a maximal run of bytes other than space and 0x09-0x0D. Hashes are
polynomial hashes modulo 2**64 over a table of random byte values, taken from
one prefix sum, so that any substring's hash costs two subtractions and a
multiplication; ``mix`` finishes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1
#: Bytes of text that are scanned at once; a longer document is scanned alone.
BLOCK = 1 << 18

U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finisher."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def randoms(n: int, seed: int) -> np.ndarray:
    """n fixed random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed * 0x51ED2701 & MASK))


_LETTERS = randoms(256, 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Everything in ASCII but letters and digits also ends a word here.
_PUNCT = np.array([not chr(i).isalnum() and i < 128 for i in range(256)])
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) <= n:
        size = max(n, BLOCK) + 2
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U)
    return _powers[0], _powers[1]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of documents of about ``size`` bytes: first, last + 1, bytes, offsets."""
    raw, at = buffers(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = min(lo + 1024, max(lo + 1, int(np.searchsorted(at, at[lo] + size, side="right")) - 1))
        yield lo, hi, raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


class Scan:
    """Words of a run of documents.

    starts, ends: byte positions of words; words: their hashes; first: index of
    each document's first word, with the number of words at the end.
    """

    def __init__(self, raw: np.ndarray, at: np.ndarray, lower: bool = True, punct: bool = False):
        n = len(raw)
        self.raw = raw = _LOWER[raw] if lower else raw
        self.at = at
        solid = ~(_PUNCT if punct else _SPACE)[raw]
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        before = np.empty(n, bool)
        if n:
            before[0], before[1:] = True, ~solid[:-1]
            before |= edge[:-1]
        self.starts = np.flatnonzero(solid & before)
        after = np.empty(n, bool)
        if n:
            after[-1], after[:-1] = True, ~solid[1:]
            after |= edge[1:]
        self.ends = np.flatnonzero(solid & after) + 1
        self.first = np.searchsorted(self.starts, at)
        self.up, self.down = powers(n)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(_LETTERS[raw] * self.up[:n], out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(U))

    @property
    def words(self) -> np.ndarray:
        return self.hashes(self.starts, self.ends)

    def document(self, of: np.ndarray | None = None) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.first))


def shingle_sets(scan: Scan, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of all documents with their multiplicity kept: hashes, offsets by document, first word.

    A document of fewer words than ``width`` has its whole sequence as one shingle; one without words has none.
    """
    words, first = scan.words, scan.first
    count = np.diff(first)
    total = np.where(count == 0, 0, np.maximum(count - width + 1, 1))
    at = np.concatenate(([0], np.cumsum(total)))
    start = np.repeat(first[:-1], total) + (np.arange(at[-1]) - np.repeat(at[:-1], total))
    left = np.repeat(np.minimum(count, width), total)
    out = np.zeros(len(start), U)
    turns = randoms(width + 1, 7)
    for k in range(width):
        here = left > k
        if here.all():
            out = mix(out + words[start + k] * (turns[k] | U(1)))
        else:
            out[here] = mix(out[here] + words[start[here] + k] * (turns[k] | U(1)))
    return out + left.astype(U), at, start


def distinct(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 54-bit shingle ids of each document, and offsets. At most 1024 documents."""
    document = np.repeat(np.arange(len(at) - 1, dtype=U), np.diff(at))
    h = np.sort((document << U(54)) | (hashes >> U(10)))
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    h = h[new]
    at = np.searchsorted(h, np.arange(len(at), dtype=U) << U(54)) if len(at) <= 1024 else np.append(np.searchsorted(h, np.arange(len(at) - 1, dtype=U) << U(54)), len(h))
    return h & U((1 << 54) - 1), at


def run_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of each run, empty ones included."""
    sums = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def binary_rows(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary column whose rows are the bytes of values[at[i]:at[i + 1]]."""
    values = np.ascontiguousarray(values)
    offsets = (np.asarray(at, np.int64) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values.view(np.uint8).reshape(-1))])


def pack_numbers(x: np.ndarray) -> bytes:
    """Numbers below 2**32, byte plane by byte plane, compressed: most are small."""
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack_numbers(data: pa.Buffer, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd"), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)
