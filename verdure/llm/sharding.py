"""Sharding by histogram sort.

Rows are ordered by a 62-bit key. Candidate boundaries are probed by counting
exactly the bytes and rows below each of them in every partition; the probes
are refined until every boundary meets its tolerance or can't be narrowed. Then
the rows are exchanged once, to ranges whose sizes are known by then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdure.llm.store import Store

TOP = 1 << 62


def _below(probes: np.ndarray):
    """Bytes and rows of each interval between probes, by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for batch in batches:
            at = np.searchsorted(probes, batch.column(0).to_numpy(), side="right")
            rows += np.bincount(at, minlength=len(rows))
            order = np.argsort(at, kind="stable")
            sums = np.concatenate(([0], np.cumsum(batch.column(1).to_numpy()[order])))
            cut = np.searchsorted(at[order], np.arange(len(rows) + 1))
            size += sums[cut[1:]] - sums[cut[:-1]]
        here = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(here), pa.array(size[here]), pa.array(rows[here])], names=["interval", "bytes", "rows"])

    return run


def histogram(keys: DataFrame, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows with a key below each probe, and of all rows at the end."""
    got = keys.select("key", "size").mapInArrow(_below(probes), "interval long, bytes long, rows long").groupBy("interval").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for r in got.collect():  # one row for each probe at most
        size[r["interval"]], rows[r["interval"]] = r["bytes"], r["rows"]
    return np.cumsum(size), np.cumsum(rows)


def splitters(keys: DataFrame, parts: int, tolerance: np.ndarray, probes: int = 15, most_rounds: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(boundaries, rows before each part): parts - 1 keys that split the bytes evenly.

    A boundary is accepted once the bytes below it are within its tolerance (bytes, as a
    share of all) of the target; else ``probes`` even steps and an interpolated one
    narrow its bracket, until that holds one row, of whose sides the nearer is taken.
    """
    n = parts - 1
    asked = np.array(sorted({TOP // (1024 + parts) * k for k in range(1, 1024 + parts)}), np.int64)
    lo, hi = np.zeros(n, np.int64), np.full(n, TOP, np.int64)
    best, gap, rows_below = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n, np.int64)
    for step in range(most_rounds):
        size, rows = histogram(keys, asked)
        total, all_rows = float(size[-1]), int(rows[-1])
        if step == 0:
            target = total * np.arange(1, n + 1) / parts
            under, over = np.zeros(n), np.full(n, total)
            rows_lo, rows_hi = np.zeros(n, np.int64), np.full(n, all_rows)
        # The nearest probes on both sides of each target.
        at = np.searchsorted(size[:-1], target, side="right")
        for side, ok in ((at - 1, at > 0), (at, at < len(asked))):
            k = np.clip(side, 0, len(asked) - 1)
            off = np.abs(size[k] - target)
            nearer = ok & (off < gap)
            best[nearer], gap[nearer], rows_below[nearer] = asked[k][nearer], off[nearer], rows[k][nearer]
        k = np.clip(at - 1, 0, len(asked) - 1)
        up = (at > 0) & (asked[k] > lo)
        lo[up], under[up], rows_lo[up] = asked[k][up], size[k][up], rows[k][up]
        k = np.clip(at, 0, len(asked) - 1)
        down = (at < len(asked)) & (asked[k] < hi)
        hi[down], over[down], rows_hi[down] = asked[k][down], size[k][down], rows[k][down]
        open_ = (gap > tolerance * total) & (hi - lo > 1) & (rows_hi - rows_lo > 1)
        if not open_.any():
            break
        width = (hi - lo)[open_].astype(np.float64)
        shares = [np.full(len(width), k / (probes + 1)) for k in range(1, probes + 1)]
        shares.append(((target - under) / np.maximum(over - under, 1))[open_])
        asked = np.unique(np.concatenate([np.clip(lo[open_] + (width * x).astype(np.int64), lo[open_] + 1, hi[open_] - 1) for x in shares]))
    order = np.argsort(best, kind="stable")
    return best[order], np.concatenate(([0], rows_below[order]))


def shard(docs: DataFrame, shards: int = 8, *, tolerance: float = 0.001) -> DataFrame:
    """Deals all rows of ``docs`` (doc_id, text) to shards of nearly equal bytes.

    Returns doc_id, size (UTF-8 bytes of the text and 1), text_crc32, law ("bytes"),
    shard, slot (place in the shard, gapless from 0) and grown_shard (null). Null texts
    have no bytes and the crc32 of nothing. The order is by a hash of the text, then of
    doc_id, then doc_id, so that equal texts lie together except where a boundary cuts a
    large group of them. Rows alike in all of it share a key and are never cut apart. An
    empty table gives no rows; further columns are not read.
    """
    store = Store(docs.sparkSession, "shard")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    high = F.shiftrightunsigned(F.xxhash64(text), 33)
    low = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("long"), F.lit(3)), 33)
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), (high * F.lit(1 << 31) + low).alias("key"))
    keys = store.save(keys, "keys")
    # Several ranges to a shard, so that no task numbers a whole shard.
    rows = keys.count()
    ranges = int(min(512, max(8, rows // 16_000)))
    parts = shards * ranges
    edge = np.arange(1, parts) % ranges == 0
    cuts, before = splitters(keys, parts, np.where(edge, tolerance / shards, 0.25 / parts))
    first = before[::ranges]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(cuts, batch.column("key").to_numpy(), side="right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array((at // ranges).astype(np.int32)), pa.array(before[at] - first[at // ranges])], names=[*batch.schema.names, "range", "shard", "before"])

    dealt = keys.mapInArrow(deal, "doc_id long, size long, text_crc32 long, key long, range int, shard int, before long")
    within = Window.partitionBy("range").orderBy("key", "doc_id", "size", "text_crc32")
    numbered = dealt.withColumn("slot", F.col("before") + F.row_number().over(within) - 1)
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
