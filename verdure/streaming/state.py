"""Streams of region and review rows."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from verdure.sources.buckets import Buckets, Commit, current, upsert


def read_stream(spark: SparkSession, folder: str, schema, per_trigger: int = 64, fmt: str = "parquet", glob: str | None = None) -> DataFrame:
    """New files of a folder, a bounded number at each trigger."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.format(fmt).load(folder)


def latest_generation(spark: SparkSession, path: str) -> DataFrame:
    """The state that the last committed batch left."""
    return current(spark, path)


def upsert_state(stream: DataFrame, path: str, checkpoint: str, keys: list[str], seq: list[str], bucket: Column | None = None, buckets: int = 64, commits: list[Commit] | None = None) -> StreamingQuery:
    """Keeps the latest row of each key below ``path``: a batch rewrites the buckets of its keys and no others.

    ``bucket`` is a number by key, by default a hash. Batches commit under their numbers, so that one that comes again after a restart
    changes nothing. What a batch replaces is removed. ``commits`` gets what each did.
    """

    def merge(batch: DataFrame, number: int) -> None:
        table = Buckets(batch.sparkSession, path, batch.schema, F.xxhash64(*keys) if bucket is None else bucket, buckets)
        done = upsert(table, batch, keys, seq, number)
        if commits is not None:
            commits.append(done)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Cancelled(Exception):
    """A run was asked to stop before its next batch."""


class BatchRun:
    """A run over a stream that can be cancelled between two batches and resumed from its checkpoint.

    Each batch is written below ``path`` under its number, a repeated one over itself.
    """

    def __init__(self, stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, after: Callable[[int], None] | None = None):
        self._stop = threading.Event()

        def write(batch: DataFrame, number: int) -> None:
            if self._stop.is_set():
                raise Cancelled(number)
            transform(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
            if after:
                after(number)

        self.query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def cancel(self) -> None:
        """No further batch begins; the one that is being written is finished."""
        self._stop.set()

    def wait(self) -> bool:
        """Whether the run came to its end; false if it was cancelled before."""
        try:
            self.query.awaitTermination()
            return True
        except StreamingQueryException:
            if self._stop.is_set() and "Cancelled" in str(self.query.exception()):
                return False
            raise


def append_regions(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Stateless incremental emit; clustering runs over the table afterwards."""
    return transform(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def with_state(stream: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Known state applied to rows as they arrive."""
    return stream.join(state, keys, "left")


def pace(progress: list[dict], total: int, least: int = 3) -> dict | None:
    """Rows a minute and minutes left from a query's progress reports; None while too few rows are done."""
    done = sum(p["numInputRows"] for p in progress)
    spent = sum(p["durationMs"].get("triggerExecution", 0) for p in progress) / 60_000
    if done < least or spent <= 0:
        return None
    return {"done": done, "per_minute": done / spent, "minutes_left": max(total - done, 0) * spent / done}
