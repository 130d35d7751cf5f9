"""Shared intermediate tables that survive the loss of executors.

Every multi-step operator cuts its lineage by writing a Parquet table below the
folder in ``spark.checkpoint.dir``, which all executors and the driver share.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Narrow rows of a file that a step writes; more partitions than that need are merged before the write.
FILE_ROWS = 100_000
#: Rows of an Arrow batch.
BATCH_ROWS = 1_000


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is set and one machine runs all."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        local = tempfile.mkdtemp(prefix="verdure-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        folder = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """Fewer rows to an Arrow batch than Spark's default of 10,000, as rows hold whole texts; a session's own choice stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


class Store:
    """Tables of one operator run, in a folder of its own.

    Tables that a returned DataFrame reads must stay until it has been written or read;
    ``sweep`` removes all that were made since a mark.
    """

    made: list[Store] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        bound_batches(spark)
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.saved: set[str] = set()
        Store.made.append(self)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def save(self, df: DataFrame, table: str, rows: int | None = None) -> DataFrame:
        """The same rows, read from a table. ``rows``: their likely number, if they are narrow; a small table isn't dealt to many files."""
        if rows is not None:
            df = df.coalesce(1 + rows // FILE_ROWS)
        df.write.mode("overwrite").parquet(self.path(table))
        self.saved.add(table)
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        """Remove tables that no live result reads."""
        jvm = self.spark._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.path(table))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            self.saved.discard(table)


def sweep(mark: int, but: Store | None = None) -> None:
    """Removes the tables of the stores made since ``len(Store.made)`` was ``mark``, once no live result reads them."""
    for store in Store.made[mark:]:
        if store is not but:
            store.drop(*store.saved)
    del Store.made[mark:]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
