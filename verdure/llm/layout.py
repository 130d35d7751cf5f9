"""Clustered layout by a sixteen-ary trie of z-order digits.

Four values of each row become coordinates of ``bits`` binary digits by their ranks.
A z-order digit takes one bit of each coordinate, so that it has sixteen values, and
``bits`` digits lead from the root of a trie to the cell of a row. Every trie node
holds the number of rows below it; descending from the root, a node's offset is its
parent's plus the counts of its smaller siblings. A cell's rows lie in order of their
key behind the cell's offset, which gives their positions, and every run of
``file_rows`` positions is a file.

A box query descends the trie through the nodes that intersect the box. A node that
lies inside it gives one interval of positions, hence of files, without a look below.

The trie has at most 16**bits cells, however many rows there are. What grows with the
rows stays in tables that are joined by shuffles: rows by their cell within a range of
positions, files by their number.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdure.llm.store import Store
from verdure.operators.ranking import running_sum

#: Names of the four coordinates, in the order of their bits within a digit.
DIMS = ("c0", "c1", "c2", "c3")
_MERGE = "merge"


def _sorted_text(value: Column, kind: str) -> Column:
    """A string, or null, whose order by bytes is the value's order."""
    if kind == "string":
        return value
    # Whole numbers, shifted to be unsigned.
    return F.lpad((value.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")


def thresholds(rows: DataFrame, values: list[str], bits: int, store: Store) -> list[list]:
    """For each value column, the least values of coordinate 1, 2, ...; None where no value has it.

    A value's coordinate is floor(2**bits * s / n), s of the n rows being smaller; it rises
    with the value, so that 2**bits - 1 values tell all of them. Values are counted before
    they are ordered, and summed up by ranges.
    """
    n, parts = rows.count(), 1 << bits
    kinds = dict(rows.dtypes)
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("dim"), _sorted_text(F.col(v), kinds[v]).alias("value")) for i, v in enumerate(values)])).alias("x")
    counts = rows.select(each).groupBy("x.dim", "x.value").agg(F.count("*").alias("n"))
    summed = running_sum(counts, ["dim"], [F.asc_nulls_first("value")], F.col("n"), "upto")
    below = parts * (F.col("upto") - F.col("n"))
    found = summed.groupBy("dim").agg(*[F.min(F.when(below >= k * n, F.col("value"))).alias(f"t{k}") for k in range(1, parts)])
    held = {r["dim"]: [r[f"t{k}"] for k in range(1, parts)] for r in found.collect()}
    return [held.get(i, [None] * (parts - 1)) for i in range(len(values))]


def interleave(coordinates: list[Column], bits: int) -> Column:
    """The z-order number: one bit of each coordinate in turn, the highest first."""
    z = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for c in coordinates:
            z = z * 2 + F.shiftright(c, b).bitwiseAND(1)
    return z


def grow(cells: DataFrame, bits: int) -> DataFrame:
    """(level, node, n, offset) of all trie nodes, from (z, n) of the cells; level 1 lies below the root.

    Counts add up from below; offsets come down, at most sixteen siblings at a time.
    """
    nodes = None
    for level in range(1, bits + 1):
        here = cells.groupBy(F.shiftright("z", 4 * (bits - level)).alias("node")).agg(F.sum("n").alias("n"))
        siblings = Window.partitionBy(F.shiftright("node", 4)).orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        here = here.withColumn("before", F.coalesce(F.sum("n").over(siblings), F.lit(0)))
        if nodes is None:
            here = here.select(F.lit(level).alias("level"), "node", "n", F.col("before").alias("offset"))
            nodes = last = here
        else:
            up = last.select(F.col("node").alias("parent"), F.col("offset").alias("base"))
            last = here.join(up.hint(_MERGE), F.shiftright("node", 4) == F.col("parent")).select(F.lit(level).alias("level"), "node", "n", (F.col("base") + F.col("before")).alias("offset"))
            nodes = nodes.union(last)
    return nodes


def _corner(node: Column, level: int, bits: int, dim: int) -> Column:
    """The least coordinate of a node in one dimension: bit ``dim`` of each of its digits."""
    low = F.lit(0)
    for k in range(level):
        low = low * 2 + F.shiftright(node, 4 * (level - 1 - k) + 3 - dim).bitwiseAND(1).cast("int")
    return low * (1 << (bits - level))


@dataclass
class Layout:
    """rows: the given columns, c0 to c3, z, position, file; trie: (level, node, n, offset); files: bounds of each file, (file, n, lo0, hi0, ...)."""

    rows: DataFrame
    trie: DataFrame
    files: DataFrame
    cells: DataFrame
    bits: int
    file_rows: int
    store: Store

    def search(self, boxes: DataFrame) -> DataFrame:
        """(box, first, last) intervals of files that hold a row inside a box (box, lo0, hi0, ... lo3, hi3), bounds included; several of a box may share a file.

        Each step takes the frontier of partly covered nodes one digit down.
        """
        bounds = [f"{side}{d}" for d in range(4) for side in ("lo", "hi")]
        front, found = boxes.select("box", F.lit(0).cast("long").alias("node"), *bounds), None
        for level in range(1, self.bits + 1):
            size = 1 << (self.bits - level)
            below = front.select("box", *bounds, F.explode(F.sequence(F.col("node") * 16, F.col("node") * 16 + 15)).alias("node"))
            meets, inside = F.lit(True), F.lit(True)
            for d in range(4):
                low = _corner(F.col("node"), level, self.bits, d)
                meets = meets & (low <= F.col(f"hi{d}")) & (low + (size - 1) >= F.col(f"lo{d}"))
                inside = inside & (low >= F.col(f"lo{d}")) & (low + (size - 1) <= F.col(f"hi{d}"))
            nodes = self.trie.where(F.col("level") == level).select("node", "n", "offset")
            met = self.store.save(below.where(meets).withColumn("inside", inside).join(nodes.hint(_MERGE), "node"), f"front-{level}-{len(self.store.saved)}")
            whole = met.where("inside").select("box", F.floor(F.col("offset") / self.file_rows).alias("first"), F.floor((F.col("offset") + F.col("n") - 1) / self.file_rows).alias("last"))
            found = whole if found is None else found.union(whole)
            front = met.where("not inside").select("box", "node", *bounds)
        return found

    def matching(self, boxes: DataFrame) -> DataFrame:
        """(box, files_matching): how many files hold a row inside each box; boxes without any give no row."""
        # Positions of a box's intervals are apart, so that neighbours share one file at most.
        before = F.lag("last").over(Window.partitionBy("box").orderBy("first", "last"))
        own = F.col("last") - F.col("first") + 1 - F.when(before == F.col("first"), 1).otherwise(0)
        return self.search(boxes).withColumn("own", own).groupBy("box").agg(F.sum("own").alias("files_matching"))

    def touched(self, boxes: DataFrame) -> DataFrame:
        """(box, files_touched): how many files have bounds that meet each box; boxes without any give no row.

        Files of one cell have the cell's bounds, and at most one file more than there are
        cells has others: files alike in bounds are counted first. Bounds and boxes meet at
        the least corner of what they share in the first two dimensions.
        """
        bounds = [f"{side}{d}" for d in range(4) for side in ("lo", "hi")]
        alike = self.files.groupBy(*bounds).agg(F.count("*").alias("files"))

        def spread(df: DataFrame, prefix: str) -> DataFrame:
            df = df.select(*[F.col(b).alias(f"{prefix}{b}") for b in bounds], *[c for c in df.columns if c not in bounds])
            for d in (0, 1):
                df = df.withColumn(f"at{d}", F.explode(F.sequence(f"{prefix}lo{d}", f"{prefix}hi{d}")))
            return df

        met = spread(alike, "f_").join(spread(boxes.select("box", *bounds), "q_").hint(_MERGE), ["at0", "at1"])
        for d in (0, 1):
            met = met.where(F.col(f"at{d}") == F.greatest(f"f_lo{d}", f"q_lo{d}"))
        for d in (2, 3):
            met = met.where((F.col(f"f_lo{d}") <= F.col(f"q_hi{d}")) & (F.col(f"f_hi{d}") >= F.col(f"q_lo{d}")))
        return met.groupBy("box").agg(F.sum("files").alias("files_touched"))

    def write(self, path: str) -> None:
        """The rows as Parquet files of ``file_rows`` rows in order of position; a task writes whole files."""
        tasks = int(self.rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.rows.repartitionByRange(tasks, "file").sortWithinPartitions("position").write.option("maxRecordsPerFile", self.file_rows).parquet(path)


def lay_out(df: DataFrame, values: list[str], key: str, *, bits: int = 3, file_rows: int = 1000, name: str = "layout") -> Layout:
    """The rows of ``df`` in clustered order of four value columns, strings or whole numbers; see ``Layout``.

    Nulls are the smallest values and keys; strings compare by their UTF-8 bytes. Equal
    values share a coordinate, repeated keys lie next to each other within a cell, in any
    order. All columns are kept; names of the layout's own (c0 to c3, z, position, file,
    and what begins with an underscore) are refused. An empty table has no cells and no files.
    """
    if len(values) != 4:
        raise ValueError("a sixteen-ary digit takes one bit of each of four values")
    own = {*DIMS, "z", "position", "file"} & set(df.columns)
    if own:
        raise ValueError(f"columns {sorted(own)} have names of the layout's own")
    spark = df.sparkSession
    store = Store(spark, name)
    # The row's number in its table tells repeated keys apart, so that no key fills a range.
    rows = store.save(df.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id())), "rows")
    limits = thresholds(rows, values, bits, store)
    kinds = dict(rows.dtypes)
    coordinates = []
    for v, limit in zip(values, limits):
        text = _sorted_text(F.col(v), kinds[v])
        passed = [F.coalesce((text >= F.lit(t)).cast("int"), F.lit(0)) for t in limit if t is not None]
        coordinates.append(sum(passed, F.lit(0)).cast("int"))
    placed = rows.select("*", *[c.alias(d) for c, d in zip(coordinates, DIMS)])
    placed = placed.withColumn("z", interleave([F.col(d) for d in DIMS], bits))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("z"), F.asc_nulls_first(key), F.col("_salt")]
    # The number that a row gets on its way to the table has its range and its place there.
    dealt = placed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = store.save(dealt.withColumn("_range", F.shiftright("_at", 33)).withColumn("_place", F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_salt"), "dealt")
    runs = store.save(dealt.groupBy("z", "_range").agg(F.count("*").alias("n"), F.min("_place").alias("first")), "runs")
    cells = runs.groupBy("z").agg(F.sum("n").alias("n"))
    trie = store.save(grow(cells, bits), "trie", 16 ** min(bits, 4))
    # A row's rank in its cell: the cell's rows in ranges before, and those before it in its own.
    before = Window.partitionBy("z").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranked = runs.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first"))
    offsets = trie.where(F.col("level") == bits).select(F.col("node").alias("z"), "offset")
    shifts = ranked.join(offsets.hint(_MERGE), "z").select("z", "_range", (F.col("offset") + F.col("shift")).alias("shift"))
    rows = dealt.join(shifts.hint(_MERGE), ["z", "_range"]).withColumn("position", F.col("_place") + F.col("shift"))
    rows = store.save(rows.withColumn("file", F.floor(F.col("position") / file_rows)).select(*df.columns, *DIMS, "z", "position", "file"), "positions")
    store.drop("rows", "dealt", "runs")
    cells = store.save(rows.groupBy("file", "z", *DIMS).agg(F.count("*").alias("n")), "cells")
    files = cells.groupBy("file").agg(F.sum("n").alias("n"), *[f(d).alias(f"{side}{i}") for i, d in enumerate(DIMS) for side, f in (("lo", F.min), ("hi", F.max))])
    return Layout(rows, trie, store.save(files, "files"), cells, bits, file_rows, store)


def neighbourhoods(docs: DataFrame, *, reach: int = 1, bits: int = 3, file_rows: int = 1000) -> DataFrame:
    """(doc_id, z, position, file, files_touched, files_matching, file_bounds) for every row of ``docs`` (doc_id, text, lang, source).

    The four values are source, lang, the text's length in UTF-8 bytes (null: -1) and the
    unsigned crc32 of the decimal doc_id modulo 365 (null: null). Each row asks for equal
    coordinates of source and lang and for those of length and date at most ``reach`` away.
    What it is told depends on its cell alone, so that cells ask, not rows.

    Null, empty and very long texts are lengths like others; repeated rows and null ids each
    have their position; other columns are not read; an empty table gives no rows.
    """
    size = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(-1)).cast("long")
    date = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 365
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), size.alias("length"), date.alias("date"))
    laid = lay_out(narrow, ["source", "lang", "length", "date"], "doc_id", bits=bits, file_rows=file_rows)
    near = lambda d: [F.greatest(F.col(d) - reach, F.lit(0)), F.least(F.col(d) + reach, F.lit((1 << bits) - 1))]
    sides = [F.col("c0"), F.col("c0"), F.col("c1"), F.col("c1"), *near("c2"), *near("c3")]
    names = [f"{side}{d}" for d in range(4) for side in ("lo", "hi")]
    asked = laid.store.save(laid.cells.select(F.col("z").alias("box"), *[s.alias(n) for s, n in zip(sides, names)]).distinct(), "boxes")
    told = laid.store.save(laid.matching(asked).join(laid.touched(asked).hint(_MERGE), "box").withColumnRenamed("box", "z"), "told")
    bounds = laid.files.select("file", F.concat_ws(",", *names).alias("file_bounds"))
    # Each part of a cell in a file has at most ``file_rows`` rows: no key of these joins is hot.
    parts = laid.cells.select("file", "z").join(told.hint(_MERGE), "z").join(bounds.hint(_MERGE), "file")
    out = laid.rows.join(parts.hint(_MERGE), ["file", "z"])
    return out.select("doc_id", "z", "position", "file", "files_touched", "files_matching", "file_bounds")
