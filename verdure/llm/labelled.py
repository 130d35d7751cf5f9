"""Labels joined to documents, and the split that scores are judged on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdure.llm.store import Store

#: Labelled rows of a file.
PART_ROWS = 2_500


def remainder() -> Column:
    """crc32 of the decimal doc_id, modulo 5; null for a null id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, store: Store, most_bytes: int = 64_000_000) -> DataFrame:
    """(doc_id, text, label) of labelled documents that aren't held out (remainder 0), about ``most`` rows and ``most_bytes`` of text at most.

    The bounds hold through a hash of doc_id, the first taken on the labels alone; what is
    left of them is small enough to broadcast, and their whole texts are kept in a table.
    Labels other than 0 and 1 and null ids are left out; of conflicting labels of an id the
    larger counts; documents that repeat an id come each, null texts too. Further columns
    are not read.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label")).where(remainder() != 0)
    n = known.count()
    share = min(1.0, most / max(n, 1))
    place = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000))
    known = known.where(place < int(share * 1_000_000))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # So few rows are dealt anew, to files of some thousands.
    found = rows.join(F.broadcast(known), "doc_id").repartition(1 + int(min(most, n)) // PART_ROWS)
    saved = store.save(found, f"labelled-{label}")
    size = saved.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return saved if size <= most_bytes else saved.where(place < int(share * 1_000_000 * most_bytes / size))
