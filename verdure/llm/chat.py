"""Chat formatting with cumulative-snapshot collapse.

A log often holds a conversation again and again, each time with more turns. A
rolling hash names every prefix of every conversation; those whose whole hash is
a shorter prefix of another one are dropped by an anti-join, copies keep their
smallest conv_id, and the maximal conversations are rendered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdure.llm.store import Store

START, END = "<|im_start|>", "<|im_end|>"


def prefix_hashes(turns: list[tuple[str | None, str | None]]) -> list[bytes]:
    """128-bit rolling hashes of the prefixes of 1, 2, ... turns; null differs from empty."""
    last, out = b"", []
    for role, text in turns:
        h = hashlib.blake2b(last, digest_size=16)
        for part in (role, text):
            data = b"" if part is None else part.encode()
            h.update(b"%d:" % (-1 if part is None else len(data)) + data)
        last = h.digest()
        out.append(last)
    return out


def render(turns: list[tuple[str | None, str | None]]) -> str:
    """The turns in order, each between its marks; null roles read as unknown, null texts as empty.

    Marks inside a text are parted by a zero-width space, so that no text can open or close a turn.
    """
    clean = lambda x: (x or "").replace("<|", "<​|")
    return "".join(f"{START}{clean(role) or 'unknown'}\n{clean(text)}{END}\n" for role, text in turns)


_HASHED = "conv_id long, n_turns int, whole binary, prefixes array<binary>"


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hashes = [prefix_hashes([(t["role"], t["text"]) for t in turns]) for turns in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array([len(h) for h in hashes], pa.int32()), pa.array([h[-1] for h in hashes], pa.binary()), pa.array([h[:-1] for h in hashes], pa.list_(pa.binary())),
        ], names=["conv_id", "n_turns", "whole", "prefixes"])


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = [render([(t["role"], t["text"]) for t in turns]) for turns in batch.column("turns").to_pylist()]
        rest = [c for c in batch.schema.names if c != "turns"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(text, pa.string())], names=[*rest, "rendered"])


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered) for each maximal conversation of ``turns`` (conv_id, turn, role, text).

    Turns are ordered by turn, then role, then text (ties and repeated rows are kept);
    a null turn comes first. A conversation whose turns begin a longer one is dropped;
    of equal ones the smallest conv_id stays, and n_copies counts them. Rows with a null
    conv_id belong to no conversation and are left out. An empty table gives no rows;
    further columns are not read. One conversation must fit in a task, as its text must.
    """
    store = Store(turns.sparkSession, "chat")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    whole = store.save(rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")), "conversations")
    hashed = store.save(whole.mapInArrow(_hash, _HASHED), "hashes")
    # Both sides are reduced to distinct hashes before they meet, so that a first turn or conversation seen very often is one row.
    kept = hashed.groupBy("whole").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"), F.first("n_turns").alias("n_turns"))
    longer = hashed.select(F.explode("prefixes").alias("whole")).distinct()
    maximal = kept.join(longer, "whole", "left_anti").select("conv_id", "n_turns", "n_copies")
    return maximal.join(whole, "conv_id").select("conv_id", "n_turns", "n_copies", "turns").mapInArrow(_render, "conv_id long, n_turns int, n_copies long, rendered string")
