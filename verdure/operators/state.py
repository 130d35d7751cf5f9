"""Append-only logs and the state they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_write_wins(log: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """The latest row of each key by ``seq``; a partial aggregate, so that a hot key is reduced before the shuffle."""
    rest = [c for c in log.columns if c not in keys]
    latest = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*seq)).alias("_row"))
    return latest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def region_of(crop: Column) -> Column:
    """The region of a crop's file name, single or tiled."""
    return F.regexp_extract(crop, r"^region_(\d+)[._]", 1)


def upsert_labels(labels: DataFrame, new: DataFrame) -> DataFrame:
    """``labels`` without the crops of the regions that ``new`` brings, and ``new``."""
    hit = new.select(region_of(F.col("crop")).alias("_r")).where("_r <> ''").distinct()
    return labels.withColumn("_r", region_of(F.col("crop"))).join(hit, "_r", "left_anti").drop("_r").unionByName(new)


def retract_labels(labels: DataFrame, crops: DataFrame) -> DataFrame:
    """``labels`` without the rows of these very crops; other crops of the same region stay."""
    return labels.join(crops.select("crop"), "crop", "left_anti").select(*labels.columns)


def rename_family(labels: DataFrame, old: str, new: str) -> DataFrame:
    return labels.withColumn("family", F.when(F.col("family") == old, new).otherwise(F.col("family")))


def is_reject(source: Column, family: Column) -> Column:
    return (source == "reject") | (family == "rejected")


def reject_word(label: Column) -> Column:
    return F.when(F.lower(F.trim(label)).isin("", "healthy", "reject", "rejected"), "rejected").otherwise(label)


def join_marks(leaves: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """Leaves with their mark's state; a mark counts only if its fingerprint (w, h) is unknown (0) or the leaf's own."""
    m = marks.select(*keys, F.col("state"), F.col("w").alias("_w"), F.col("h").alias("_h"))
    known = (F.col("_w") != 0) & (F.col("_h") != 0)
    differs = known & ((F.col("_w") != F.col("w")) | (F.col("_h") != F.col("h")))
    out = leaves.join(m, keys, "left").withColumn("mismatch", F.coalesce(differs, F.lit(False)))
    return out.withColumn("state", F.when(~F.col("mismatch"), F.col("state"))).drop("_w", "_h")


def name_chain(labels: DataFrame, runtime: DataFrame, head: DataFrame, label: str = "label") -> DataFrame:
    """Name given at run time, else the head's, else a numbered one; noise below 0."""
    out = labels.join(runtime.select(label, F.col("name").alias("_a")), label, "left").join(head.select(label, F.col("name").alias("_b")), label, "left")
    return out.withColumn("name", F.when(F.col(label) < 0, "noise").otherwise(F.coalesce("_a", "_b", F.concat(F.lit("Cluster "), F.col(label))))).drop("_a", "_b")


def class_ids(rows: DataFrame, head: DataFrame, name: str, order: str) -> DataFrame:
    """(key, class) of each normalized name: the head's class, or new ids after its largest, in order of first appearance.

    ``head`` (class, name) and the distinct new names are small dimensions.
    """
    key = F.lower(F.trim(F.col(name)))
    seen = rows.where(F.col(name).isNotNull()).groupBy(key.alias("key")).agg(F.min(order).alias("first"))
    known = head.select(F.lower(F.trim("name")).alias("key"), "class")
    both = seen.join(known, "key", "left")
    top = head.agg(F.coalesce(F.max("class"), F.lit(0))).first()[0]
    fresh = F.row_number().over(Window.partitionBy(F.col("class").isNull()).orderBy("first", "key"))
    return both.select("key", F.coalesce("class", F.lit(top) + fresh).cast("long").alias("class"))


def fold_edits(edits: DataFrame, key: str, seq: str) -> DataFrame:
    """State after an undo log: the latest "after" that wasn't undone. edits (seq, key, kind, undoes, after)."""
    undone = edits.where("kind = 'undo'").select(F.col("undoes").alias(seq))
    live = edits.where("kind <> 'undo'").join(undone, seq, "left_anti")
    return last_write_wins(live.select(key, seq, "after"), [key], [seq]).select(key, "after")


def class_named(classes: DataFrame, name: str, wanted: str) -> DataFrame:
    """The class of a name, whatever its case and the spaces around it."""
    return classes.where(F.lower(F.trim(F.col(name))) == wanted.strip().lower())


def recent(opened: DataFrame, item: str, seq: str, most: int = 10) -> DataFrame:
    """(item, place): the last opened first, each once, at most ``most``."""
    last = opened.groupBy(item).agg(F.max(seq).alias(seq)).orderBy(F.desc(seq)).limit(most)
    return last.withColumn("place", F.row_number().over(Window.orderBy(F.desc(seq))) - 1).select(item, "place")


def delete_class(head: DataFrame, labels: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The head and the label rows without a family."""
    return head.where(F.col("name") != name), labels.where(F.col("family") != name)


def merge_family(head: DataFrame, labels: DataFrame, old: str, into: str) -> tuple[DataFrame, DataFrame]:
    """The head without ``old``, and its label rows renamed; nothing changes unless both names exist."""
    both = head.agg(F.bool_or(F.col("name") == old).alias("a"), F.bool_or(F.col("name") == into).alias("b")).first()
    if not (both["a"] and both["b"]):
        return head, labels
    return head.where(F.col("name") != old), rename_family(labels, old, into)
