"""Writers: result tables, logs, versions and image files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fixed(df: DataFrame, decimals: dict[str, int]) -> DataFrame:
    """Columns as text with so many decimals; null stays null, an empty cell once written."""
    text = lambda c: F.when(F.col(c).isNotNull(), F.format_string(f"%.{decimals[c]}f", F.col(c).cast("double"))).alias(c)
    return df.select(*[text(c) if c in decimals else F.col(c) for c in df.columns])


def write_csv(df: DataFrame, path: str, order: list[str] | None = None, mode: str = "overwrite") -> None:
    """A quoted CSV with a header; unknown values are empty cells."""
    out = df.orderBy(*order) if order else df
    out.write.mode(mode).option("header", "true").option("emptyValue", "").option("nullValue", "").option("escape", '"').csv(path)


def append_json(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """Appends rows to a log, as one file, in their order if it is given; the readers take files by their time."""
    one = df.coalesce(1)
    (one.sortWithinPartitions(*order) if order else one).write.mode("append").json(path)


def write_generation(df: DataFrame, path: str, number: int) -> str:
    """A new version beside the old ones, which stay as they are."""
    target = f"{path}/generation={number}"
    df.write.mode("errorifexists").parquet(target)
    return target


def write_files(df: DataFrame, name: str, content: str, write: Callable[[str, bytes], None]) -> None:
    """Hands each row's bytes to ``write`` on the executors, partition by partition."""
    df.select(name, content).foreachPartition(lambda rows: [write(r[0], bytes(r[1])) for r in rows] and None)


def markdown(title: str, rows: list[dict]) -> str:
    """A small table as Markdown."""
    if not rows:
        return f"## {title}\n\nno rows\n"
    names = list(rows[0])
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    return "\n".join([f"## {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names), *["| " + " | ".join(cell(r[n]) for n in names) + " |" for r in rows], ""])


def dataset_index(items: DataFrame, recorded: DataFrame, src: str = "src") -> DataFrame:
    """Items with a stable index: the recorded one, else new ones after the largest, in order of src."""
    from verdure.operators.ranking import numbered

    top = recorded.agg(F.coalesce(F.max("index"), F.lit(-1))).first()[0]
    kind = dict(recorded.dtypes)["index"]
    known = items.join(recorded.select(src, "index"), src)
    fresh = numbered(items.join(recorded.select(src), src, "left_anti"), [], [F.col(src)], "index").withColumn("index", F.col("index") + top + 1)
    return known.unionByName(fresh.withColumn("index", F.col("index").cast("long" if kind == "bigint" else kind)))
