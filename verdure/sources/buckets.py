"""A keyed table on disk in hash buckets, of which a change rewrites those that it touches.

Each commit writes the touched buckets as a generation of their own, then a manifest that
names the generation of every bucket, and removes what no bucket refers to any more. A
reader sees the manifest's generations only; a commit that fails before its manifest
leaves the table as it was, and one that is repeated under its number changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass
class Commit:
    """What a commit did: its number, the buckets that it rewrote, the rows in them, and bytes of all buckets after it."""

    number: int
    buckets: list[int]
    rows: int
    bytes: int


def _manifest(spark: SparkSession, path: str) -> dict:
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest.json")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return {"number": -1, "generation": {}}
    return json.loads(spark.read.text(f"{path}/manifest.json", wholetext=True).first()[0])


def current(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the table at ``path``, of which there is a commit."""
    held = _manifest(spark, path)
    schema = StructType.fromJson(held["schema"])
    paths = [f"{path}/generation={g}/bucket={b}" for b, g in held["generation"].items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


class Buckets:
    """The table below ``path``; ``bucket`` gives a row's bucket, from 0 to ``n`` - 1, by columns that every change has too."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, bucket: Column, n: int):
        self.spark, self.path, self.n = spark, path.rstrip("/"), n
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.bucket = F.coalesce(F.pmod(bucket, F.lit(n)), F.lit(0)).cast("int")

    # --- files ---

    def _place(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def manifest(self) -> dict:
        """{"number": of the last commit or -1, "generation": by bucket}."""
        return _manifest(self.spark, self.path)

    def _put_manifest(self, manifest: dict) -> None:
        """Written beside and renamed, so that a reader finds the old one or the new one."""
        system, fresh = self._place("manifest.json.new")
        out = system.create(fresh, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        _, path = self._place("manifest.json")
        system.delete(path, False)
        system.rename(fresh, path)

    def _sweep(self, manifest: dict) -> int:
        """Removes the generations of buckets that the manifest doesn't name; bytes of what is left."""
        system, root = self._place("")
        kept = 0
        for generation in system.listStatus(root):
            name = generation.getPath().getName()
            if not name.startswith("generation="):
                continue
            left = 0
            for part in system.listStatus(generation.getPath()):
                b = part.getPath().getName()
                if b.startswith("bucket=") and manifest["generation"].get(b[7:]) == int(name[11:]):
                    kept, left = kept + system.getContentSummary(part.getPath()).getLength(), left + 1
                elif b.startswith("bucket="):
                    system.delete(part.getPath(), True)
            if not left:
                system.delete(generation.getPath(), True)
        return kept

    # --- rows ---

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets; no commit yet gives no rows."""
        held = self.manifest()["generation"]
        paths = [f"{self.path}/generation={g}/bucket={b}" for b, g in held.items() if buckets is None or int(b) in buckets]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of these rows: at most ``n`` numbers."""
        return sorted(r[0] for r in rows.select(self.bucket.alias("b")).distinct().collect())

    def commit(self, touched: list[int], merge: Callable[[DataFrame], DataFrame], number: int | None = None) -> Commit:
        """Rewrites the touched buckets as ``merge`` of their rows. ``number``: of the commit; one that was made already is left."""
        manifest = self.manifest()
        number = manifest["number"] + 1 if number is None else number
        if number <= manifest["number"] or not touched:
            return Commit(number, [], 0, self._sweep(manifest) if manifest["generation"] else 0)
        from pyspark.sql import Observation

        seen = Observation()
        fresh = merge(self.read(touched)).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).withColumn("bucket", self.bucket)
        fresh = fresh.observe(seen, F.count(F.lit(1)).alias("n"))
        # Large buckets are split, small ones put together.
        fresh.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/generation={number}")
        system, root = self._place(f"generation={number}")
        written = {s.getPath().getName()[7:] for s in system.listStatus(root) if s.getPath().getName().startswith("bucket=")}
        held = {b: g for b, g in manifest["generation"].items() if int(b) not in touched}
        manifest = {"number": number, "generation": held | {b: number for b in written}, "schema": self.schema.jsonValue()}
        self._put_manifest(manifest)
        return Commit(number, touched, seen.get["n"], self._sweep(manifest))


def upsert(table: Buckets, rows: DataFrame, keys: list[str], seq: list[str], number: int | None = None) -> Commit:
    """The latest row of each key by ``seq``, of the table and of ``rows``; only their buckets are read and rewritten."""
    from verdure.operators.state import last_write_wins

    fresh = last_write_wins(rows, keys, seq)
    return table.commit(table.touched(rows), lambda old: last_write_wins(old.unionByName(fresh.select(old.columns)), keys, seq), number)


def label_table(spark: SparkSession, path: str, n: int = 64) -> Buckets:
    """Curation rows by region: all crops of a region lie in one bucket; rows without a region by their crop's name."""
    from verdure.operators.state import region_of
    from verdure.sources.files import LABELS

    region = region_of(F.col("crop"))
    return Buckets(spark, path, LABELS, F.when(region != "", region.cast("long")).otherwise(F.crc32(F.col("crop").cast("binary"))), n)


def upsert_label_rows(table: Buckets, new: DataFrame) -> Commit:
    """The regions that ``new`` brings have its rows alone; other buckets are not read."""
    from verdure.operators.state import upsert_labels

    return table.commit(table.touched(new), lambda old: upsert_labels(old, new.select(old.columns)))


def retract_label_rows(table: Buckets, crops: DataFrame) -> Commit:
    """Without the rows of these very crops."""
    from verdure.operators.state import retract_labels

    return table.commit(table.touched(crops), lambda old: retract_labels(old, crops))


def rename_label_family(table: Buckets, old: str, new: str) -> Commit:
    """Another name for a family, in the buckets that have rows of it."""
    from verdure.operators.state import rename_family

    return table.commit(table.touched(table.read().where(F.col("family") == old)), lambda rows: rename_family(rows, old, new))


def bounded(entries: DataFrame, keys: list[str], size: str, used: str, most: int, since: int | None = None) -> DataFrame:
    """The entries that a cache of ``most`` bytes keeps: those used last, ties by key, while all sizes up to theirs fit; none last used before ``since``.

    One exchange by ranges of use; no task orders all entries.
    """
    from verdure.operators.ranking import running_sum

    young = entries if since is None else entries.where(F.col(used) >= since)
    return running_sum(young, [], [F.desc(used), *map(F.col, keys)], F.coalesce(F.col(size), F.lit(0)), "_upto").where(F.col("_upto") <= most).drop("_upto")


def evict(table: Buckets, keys: list[str], size: str, used: str, most: int, since: int | None = None) -> Commit:
    """Removes what ``bounded`` doesn't keep from a cache on disk; buckets without such entries stay as they are."""
    from verdure.session import cut

    held = table.read()
    gone = cut(held.select(*keys, size, used).join(bounded(held.select(*keys, size, used), keys, size, used, most, since).select(*keys), keys, "left_anti"))
    return table.commit(table.touched(gone), lambda old: old.join(gone.select(*keys), keys, "left_anti").select(old.columns))


def look_up(table: Buckets, wanted: DataFrame, keys: list[str], used: str, now: int) -> tuple[DataFrame, DataFrame, Commit]:
    """(hits, misses, commit): hits count as used now; only the buckets of what is wanted are read and rewritten."""
    from verdure.session import cut

    touched = table.touched(wanted)
    asked = wanted.select(*keys).distinct()
    hits = cut(table.read(touched).join(asked, keys, "left_semi"))
    misses = asked.join(hits.select(*keys), keys, "left_anti")
    stamp = hits.select(*keys).distinct().withColumn("_hit", F.lit(True))

    def merge(old: DataFrame) -> DataFrame:
        return old.join(stamp, keys, "left").withColumn(used, F.when(F.col("_hit"), F.greatest(F.col(used), F.lit(now))).otherwise(F.col(used))).select(old.columns)

    return hits, misses, table.commit(table.touched(hits), merge)
