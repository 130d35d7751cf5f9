"""Row numbers and running sums of large groups, without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdure.session import cut


def _new(column: pa.Array, last: pa.Scalar) -> np.ndarray:
    """Whether each value differs from the one before it; nulls are alike, and so are values that are no numbers."""
    before = pa.concat_arrays([pa.array([last.as_py()], column.type), column.slice(0, len(column) - 1)])
    null = pc.xor(column.is_null(), before.is_null())
    other = pc.fill_null(pc.not_equal(column, before), False)
    if pa.types.is_floating(column.type):
        other = pc.and_(other, pc.invert(pc.fill_null(pc.and_(pc.is_nan(column), pc.is_nan(before)), False)))
    return pc.or_(null, other).to_numpy(zero_copy_only=False)


def _sums(keys: list[int], whole: bool):
    """Running sums of the last column within runs of equal keys, the columns at ``keys``; and whether a row is in its partition's first run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried, first = None, 0, True
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            amount = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64 if whole else np.float64)
            new = np.zeros(n, bool)
            for i, k in enumerate(keys):
                new |= _new(batch.column(k), last[i] if last else batch.column(k)[0])
            sums = np.cumsum(amount)
            # What had been summed up before the run of each row began.
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            base = np.where(start > 0, sums[np.maximum(start, 1) - 1], 0)
            sums = sums - base + np.where(start < 0, carried, 0)
            own = first & (start < 0)
            first = first and not new.any()
            carried, last = sums[-1], [batch.column(k)[n - 1] for k in keys]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums), pa.array(np.broadcast_to(own, n))], names=[*batch.schema.names[:-1], "_s", "_r"])

    return run


def running_sum(df: DataFrame, keys: list[str], order: list[Column], amount: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``amount`` up to and with each row, in the order of its group.

    Rows are dealt by ranges of key and order, the one exchange; each range sums up its own
    rows in order, as they go to a table. Only the group in which a range begins can have
    rows in ranges before: what they sum up to is found from one row for each range, so that
    the number of shuffle partitions bounds what the driver holds. The order must tell rows
    apart. An empty table gives no rows.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by = [*map(F.col, keys), *order]
    dealt = df.withColumn("_a", amount).repartitionByRange(ranges, *by).sortWithinPartitions(*by)
    dealt = dealt.withColumn("_p", F.spark_partition_id()).select(*df.columns, "_p", "_a")
    whole = isinstance(dealt.schema["_a"].dataType, T.IntegralType)
    schema = T.StructType([*dealt.schema.fields[:-1], T.StructField("_s", T.LongType() if whole else T.DoubleType()), T.StructField("_r", T.BooleanType())])
    at = [df.columns.index(k) for k in keys]
    summed = cut(dealt.mapInArrow(_sums(at, whole), schema).withColumn("_i", F.monotonically_increasing_id()))
    # A range's first and last key, the sum of its first run, of its last, and whether these are one.
    key = F.struct(*keys) if keys else F.lit(True)
    ends = summed.groupBy("_p").agg(
        F.min_by(key, "_i").alias("head"), F.max_by(key, "_i").alias("tail"), F.max_by("_s", F.when(F.col("_r"), F.col("_i"))).alias("head_sum"), F.max_by("_s", "_i").alias("tail_sum"), F.every("_r").alias("one")
    )
    plain = lambda key: ["nan" if v != v else v for v in key] if keys else key
    zero = 0 if whole else 0.0
    bases, last, sofar = [], None, zero
    for e in sorted(ends.collect(), key=lambda e: e["_p"]):
        base = sofar if last == plain(e["head"]) else zero
        bases.append((e["_p"], base))
        last, sofar = plain(e["tail"]), (base + e["head_sum"] if e["one"] else e["tail_sum"])
    base = spark.createDataFrame(bases, T.StructType([T.StructField("_p", T.IntegerType()), T.StructField("_b", schema["_s"].dataType)]))
    out = summed.join(F.broadcast(base), "_p")
    return out.select(*df.columns, (F.col("_s") + F.when(F.col("_r"), F.col("_b")).otherwise(0)).alias(name))


def numbered(df: DataFrame, keys: list[str], order: list[Column], name: str = "_i") -> DataFrame:
    """``df`` with each row's place, from 0, in the order of its group."""
    return running_sum(df, keys, order, F.lit(1), name).withColumn(name, F.col(name) - 1)
