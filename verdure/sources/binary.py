"""Binary tables of vectors: a header, then rows of equal length, little-endian.

A table is one file or a folder of numbered parts, each of them whole, with a header of
its own. Files are read by ranges of bytes, a range to a task, so that none is held whole;
parts are written by the tasks that have their rows.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdure.operators.ranking import numbered
from verdure.session import cut

#: Bytes of a range, and rows of a part.
RANGE, PART = 16 << 20, 16_384
#: Rows that a reader gives at once.
BATCH = 4096


def _ranges(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(path, length, k): ranges of bytes of the files at a path; their contents are not read here."""
    found = spark.read.format("binaryFile").load(path).select("path", "length")
    return found.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("length") / size) - 1, F.lit(0).cast("long"))))).repartition("path", "k")


def _first_row(path: str) -> int:
    """A part's first row, by its name."""
    found = re.search(r"(\d{15})\.bin$", path)
    return int(found[1]) if found else 0


def _read(spark: SparkSession, path: str, header: Callable, kind: Callable, columns: Callable, schema: pa.Schema, ddl: str, size: int, mark: str = "") -> DataFrame:
    """Rows of all files by ranges.

    ``header(file, length)`` gives the body's place, its rows and their length in bytes and
    what ``kind`` makes their type of; a file that is none of these gives one row with its error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from verdure.sources.exports import file_system

        for batch in batches:
            for name, length, k in zip(*(c.to_pylist() for c in batch.columns)):
                system, place = file_system(name)
                with system.open_input_file(place) as file:
                    try:
                        start, n, width, about = header(file, length)
                    except ValueError as e:
                        if k == 0:
                            yield pa.RecordBatch.from_pylist([{"error": f"{mark}{e}"}], schema)
                        continue
                    # A row belongs to the range in which it begins.
                    at = lambda byte: min(n, max(0, -(-(byte - start) // width))) if width else (n if byte > start else 0)
                    lo, hi = (0 if k == 0 else at(k * size)), at((k + 1) * size)
                    for a in range(lo, hi, BATCH):
                        m = min(BATCH, hi - a)
                        rows = np.frombuffer(file.read_at(m * width, start + a * width), kind(about)) if width else np.zeros(m, kind(about))
                        ids = pa.array(np.arange(a, a + m) + _first_row(name))
                        yield pa.RecordBatch.from_arrays([ids, *columns(rows), pa.nulls(m, pa.string())], schema=schema)

    return _ranges(spark, path, size).mapInArrow(run, ddl)


def _vectors(v: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.reshape(-1)))


def bank(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(row_id, v, error) of a bank: counts of rows and components, then the components."""

    def header(file, length: int):
        if length < 8:
            raise ValueError("no header")
        n, d = struct.unpack("<II", file.read_at(8, 0))
        if length != 8 + 4 * n * d:
            raise ValueError("the body doesn't match the header")
        return 8, n, 4 * d, d

    schema = pa.schema([("row_id", pa.int64()), ("v", pa.list_(pa.float32())), ("error", pa.string())])
    return _read(spark, path, header, lambda d: np.dtype([("v", "<f4", (d,))]), lambda rows: [_vectors(rows["v"])], schema, "row_id long, v array<float>, error string", size, "ValueError: ")


def base_set(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(row_id, class, weight, v, error) of a training dump: its header, the classes, then class, weight and components of each row."""
    from verdure.sources.exports import MAGIC

    def header(file, length: int):
        word, n, d, k = struct.unpack("<IIII", file.read_at(16, 0)) if length >= 16 else (0, 0, 0, 0)
        if word != MAGIC:
            raise ValueError("not a base set")
        if length != 16 + 4 * k + n * (8 + 4 * d):
            raise ValueError("the body doesn't match the header")
        return 16 + 4 * k, n, 8 + 4 * d, d

    schema = pa.schema([("row_id", pa.int64()), ("class", pa.int32()), ("weight", pa.float32()), ("v", pa.list_(pa.float32())), ("error", pa.string())])
    kind = lambda d: np.dtype([("c", "<i4"), ("w", "<f4"), ("v", "<f4", (d,))])
    return _read(spark, path, header, kind, lambda rows: [pa.array(rows["c"]), pa.array(rows["w"]), _vectors(rows["v"])], schema, "row_id long, class int, weight float, v array<float>, error string", size)


def _parts(rows: DataFrame, order: list[str], body: Callable[[pa.Table, int], bytes], root: str, rows_of_part: int) -> int:
    """Writes numbered parts of the rows in their order; how many. No row passes through the driver."""
    from verdure.sources.exports import put_files

    dims = rows.where("v is not null").agg(F.min(F.size("v")), F.max(F.size("v"))).first()
    if dims[0] != dims[1]:
        raise ValueError(f"vectors of {dims[0]} to {dims[1]} components don't fit into one table")
    placed = numbered(rows.where("v is not null"), [], [F.col(c) for c in order], "_i").withColumn("_part", F.floor(F.col("_i") / rows_of_part))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("_i")
        return pa.table({"name": [f"{key[0].as_py() * rows_of_part:015d}.bin"], "content": pa.array([body(table, dims[0])], pa.binary())})

    written = cut(put_files(placed.groupBy("_part").applyInArrow(run, "name string, content binary"), root))
    bad = written.where("error is not null").first()
    if bad:
        raise OSError(f"{bad['name']}: {bad['error']}")
    return written.count()


def _flat(table: pa.Table, dim: int) -> np.ndarray:
    return table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<f4").reshape(-1, dim)


def write_bank(rows: DataFrame, order: list[str], root: str, rows_of_part: int = PART) -> int:
    """A bank of the vectors ``v`` in numbered parts below ``root``, in the order of some columns that tell rows apart."""

    def body(table: pa.Table, dim: int) -> bytes:
        v = _flat(table, dim)
        return struct.pack("<II", *v.shape) + v.tobytes()

    return _parts(rows.select(*order, F.col("v").cast("array<float>").alias("v")), order, body, root, rows_of_part)


def write_dump(rows: DataFrame, order: list[str], root: str, rows_of_part: int = PART) -> int:
    """A training dump of (class, weight, v) in numbered parts, each with all classes in its header."""
    from verdure.sources.exports import MAGIC

    classes = np.array(sorted(r[0] for r in rows.select("class").distinct().collect()), "<i4")

    def body(table: pa.Table, dim: int) -> bytes:
        out = np.zeros(table.num_rows, np.dtype([("c", "<i4"), ("w", "<f4"), ("v", "<f4", (dim,))]))
        out["c"], out["w"], out["v"] = table.column("class").to_numpy(), table.column("weight").to_numpy(), _flat(table, dim)
        return struct.pack("<IIII", MAGIC, len(out), dim, len(classes)) + classes.tobytes() + out.tobytes()

    return _parts(rows.select(*order, "class", "weight", F.col("v").cast("array<float>").alias("v")), order, body, root, rows_of_part)
