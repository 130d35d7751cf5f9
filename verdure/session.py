"""Sessions and shared intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "verdure", **conf: str) -> SparkSession:
    """A session with UTC times, adaptive execution and Arrow transfer; ``conf`` overrides."""
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    builder = SparkSession.builder.appName(name)
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the session's spark.checkpoint.dir; in a temporary folder only where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        local = tempfile.mkdtemp(prefix="verdure-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        folder = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read back from a table in the cluster's checkpoint folder."""
    path = shared_path(df.sparkSession, "cut")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut = path
    return out


def discard(df: DataFrame) -> None:
    """Removes the table that ``cut`` made for these rows, once nothing that reads it is still to run."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
