"""A corpus from raw documents to packed sequences.

Every stage reads all rows that the one before it kept, and its decisions take
effect; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from verdure.llm import quality, toxicity
from verdure.llm.decontam import without_contaminated
from verdure.llm.dedup import without_near_duplicates
from verdure.llm.labelled import training_rows
from verdure.llm.packing import pack
from verdure.llm.queries import QUALITY_BYTES, QUALITY_ROWS, TOXICITY_ROWS
from verdure.llm.store import Store, sweep, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 for toxicity.

    Null, empty and wordless texts score as texts without any toxic passage, so they stay
    where toxic documents are the fewer. Repeated rows are judged each; all columns of
    ``docs`` are kept, whatever their names; an empty table gives no rows.
    """
    store = Store(spark, "stage-toxicity")
    model = toxicity.fit(training_rows(docs, table(spark, sf_dir, "labels"), "toxic", TOXICITY_ROWS, store))
    store.drop("labelled-toxic")
    return toxicity.without_toxic(docs, model, 0.5)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least 0.3 for quality.

    Null and empty texts score as the model's bias alone, one half without labels. Repeated
    rows are judged each; all columns of ``docs`` are kept, whatever their names; an empty
    table gives no rows.
    """
    store = Store(spark, "stage-quality")
    model = quality.fit(training_rows(docs, table(spark, sf_dir, "labels"), "quality", QUALITY_ROWS, store, QUALITY_BYTES))
    store.drop("labelled-quality")
    return quality.of_quality(docs, model, 0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id: five-word shingles, similarity 0.8.

    Repeated rows are near copies too: one stays. Null, empty and wordless texts and rows
    with a null doc_id stay; all columns of ``docs`` are kept, whatever their names; an
    empty table gives no rows.
    """
    return without_near_duplicates(docs, width=5, similarity=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null, empty and wordless texts hold none. Repeated rows are judged each; all columns of
    ``docs`` are kept, whatever their names; an empty table gives no rows.
    """
    return without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens.

    A null or empty text is its end token alone. Repeated rows and null ids are packed
    each; columns other than doc_id and text are not read; an empty table gives no rows.
    """
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("packing", pack_sequences),
]

#: No SQL can express the trained stages; the tests hold each one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written and read again before the next; only the last one's table stays."""
    store = Store(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        mark = len(Store.made)
        docs = store.save(stage(spark, docs, sf_dir), name)
        sweep(mark)
        if k:
            store.drop(STAGES[k - 1][0])
    return docs
