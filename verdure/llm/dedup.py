"""MinHash near-dedup: universal hash minima, banding, verification, components.

Documents with equal shingle sets form one class from the start; everything
after works on one representative of each class, so that copies never meet in
pairs. Within a band's bucket a few pivots are compared with every member; the
linked documents are joined to components. Where a bucket still holds more than
one component, only the members outside its largest one are left to be compared:
with pivots of their own, round by round, while they are many and rounds find
links; then, in blocks, with all members of other components, by tasks that hold the full
sets, so that only links that join components become rows. Every pair that passes
the signature test is confirmed on the full sets. No bucket, partner list or
document is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdure.llm import scan
from verdure.llm.components import components
from verdure.llm.store import FILE_ROWS, Store

U = np.uint64
#: Members of a block of a bucket, and shingles of all its sets together; two blocks meet in a task.
BLOCK, BLOCK_SHINGLES = 4096, 1 << 20
#: Rounds of pivots among the members outside a bucket's largest component, at most.
ROUNDS = 4

_SKETCH = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()),
    T.StructField("key_a", T.LongType()), T.StructField("key_b", T.LongType()),
    T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType()), T.StructField("text_hash", T.LongType()),
])


def minima(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """(documents, n) minima of ``n`` universal hashes a * x + b modulo 2**32 over non-empty runs."""
    a, b = scan.randoms(n, 11).astype(np.uint32) | np.uint32(1), scan.randoms(n, 13).astype(np.uint32)
    x = (scan.mix(hashes) >> U(32)).astype(np.uint32)
    out = np.empty((len(at) - 1, n), np.uint32)
    work = np.empty_like(x)
    for k in range(n):
        np.multiply(x, a[k], out=work)
        work += b[k]
        out[:, k] = np.minimum.reduceat(work, at[:-1])
    return out


def _sketches(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = scan.randoms(rows, 17) | U(1)
        salt = scan.randoms(bands, 19)
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, raw, at in scan.blocks(batch.column(1)):
                h, s = scan.distinct(*scan.shingle_sets(scan.Scan(raw, at), width)[:2])
                n = np.diff(s)
                full = np.flatnonzero(n)
                key_a, key_b = np.zeros(hi - lo, np.int64), np.zeros(hi - lo, np.int64)
                small = np.zeros((hi - lo, bands * rows), np.uint8)
                values = np.zeros((len(full), bands), np.int64)
                if len(full):
                    runs = s[np.append(full, len(n))]
                    key_a[full] = np.add.reduceat(scan.mix(h), runs[:-1]).view(np.int64)
                    key_b[full] = np.add.reduceat(scan.mix(h ^ U(0xA5A5A5A5A5A5A5A5)), runs[:-1]).view(np.int64)
                    m = minima(h, runs, bands * rows)
                    # A byte that depends on all bits: minima of long texts have no high ones.
                    small[full] = ((m * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
                    values = scan.mix((m.reshape(len(full), bands, rows).astype(U) * turns).sum(axis=2, dtype=U) + salt).view(np.int64)
                counts = np.zeros(hi - lo + 1, np.int32)
                counts[1:][full] = bands
                yield pa.RecordBatch.from_arrays([
                    ids.slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(key_a), pa.array(key_b),
                    pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), pa.array(values.reshape(-1))),
                    scan.binary_rows(small.reshape(-1), np.arange(hi - lo + 1) * bands * rows), batch.column(2).slice(lo, hi - lo),
                ], names=_SKETCH.names)

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, at in scan.blocks(batch.column(1)):
                h, s = scan.distinct(*scan.shingle_sets(scan.Scan(raw, at), width)[:2])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), scan.binary_rows(h, s)], names=["rep", "hashes"])

    return run


def _confirm(similarity: int):
    """Keeps the pairs with 100 * intersection >= similarity * union on the full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left_set"), batch.column("right_set")
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                # An id may stand for several sets, if it repeats with other texts.
                a, y = np.frombuffer(left[i].as_buffer(), U), np.frombuffer(right[i].as_buffer(), U)
                both = len(a) + len(y)
                if 100 * min(len(a), len(y)) < similarity * max(len(a), len(y)):
                    continue
                met = np.sort(np.concatenate((a, y)))
                common = int(np.count_nonzero(met[1:] == met[:-1]))
                keep[i] = 100 * common >= similarity * (both - common)
            kept = batch.select(["x", "y"]).filter(pa.array(keep))
            if kept.num_rows:
                yield kept

    return run


def _estimate(similarity: int, n: int) -> int:
    """Equal minima, of n, below which a link of this similarity is out by five standard deviations."""
    s = similarity / 100
    return int(np.floor(n * (s - 5 * np.sqrt(s * (1 - s) / n))))


def _blocks_of_bucket(similarity: int, n_minima: int, n_bands: int):
    """Links across components between a block of a bucket's members outside its largest component and a block of all.

    As few links are returned as join the components that they link. Sizes and minima
    rule out most pairs; the rest is confirmed here on the full sets. A pair that meets
    in several buckets is looked at in the first of its bands alone.
    """
    least = _estimate(similarity, n_minima)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        bucket = key[0].as_py()
        rep, comp, asks, outside = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "component", "asks", "outside"))
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(len(rep), n_minima)
        bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(len(rep), n_bands)
        sets = [np.frombuffer(x.as_buffer(), U) for x in rows.column("hashes")]
        size = np.array([len(x) for x in sets])
        comp = comp.copy()
        right = np.flatnonzero(~asks)
        xs, ys = [], []
        for k in np.flatnonzero(asks):
            # Two members outside the largest component meet from either side; the smaller one asks.
            may = right[(comp[right] != comp[k]) & (~outside[right] | (rep[right] > rep[k])) & (100 * np.minimum(size[right], size[k]) >= similarity * np.maximum(size[right], size[k]))]
            if not len(may):
                continue
            may = may[np.count_nonzero(sketch[may] == sketch[k], axis=1) >= least]
            met = bands[may] == bands[k]
            may = may[bands[k][met.argmax(axis=1)] == bucket]
            for y in may:
                if comp[y] == comp[k]:
                    continue
                at = np.minimum(np.searchsorted(sets[k], sets[y]), size[k] - 1)
                common = int(np.count_nonzero(sets[k][at] == sets[y]))
                if 100 * common >= similarity * (size[y] + size[k] - common):
                    comp[comp == comp[y]] = comp[k]
                    xs.append(rep[k])
                    ys.append(rep[y])
        return pa.table({"u": pa.array(xs, pa.int64()), "v": pa.array(ys, pa.int64())})

    return run


def spread(placed: DataFrame, mixed: DataFrame) -> DataFrame:
    """(bucket, i, j, asks, rep, component, outside): block i of the members outside a bucket's largest component, and block j of all, for every i and j.

    A bucket of n members, m of them outside, gives n * ceil(m / BLOCK) + m * ceil(n / BLOCK) rows.
    """
    parts = lambda n, shingles: F.greatest(F.ceil(F.col(n) / F.lit(BLOCK)), F.ceil(F.col(shingles) / F.lit(BLOCK_SHINGLES))).cast("int")
    held = placed.join(mixed, "bucket").withColumn("outside", F.col("component") != F.col("largest"))
    held = held.withColumn("n_i", parts("outer", "outer_shingles")).withColumn("n_j", parts("n", "shingles"))
    names = ["rep", "component", "outside"]
    block = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asked = held.select("bucket", every("n_i").alias("i"), block("n_j").alias("j"), F.lit(False).alias("asks"), *names)
    asks = held.where("outside").select("bucket", block("n_i").alias("i"), every("n_j").alias("j"), F.lit(True).alias("asks"), *names)
    return asked.union(asks)


def near_duplicates(
    docs: DataFrame, *, width: int = 5, similarity: int = 80, bands: int = 32, rows: int = 5, pivots: int = 4,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_hash) for every row of ``docs`` (doc_id, text).

    Two documents are linked if 100 * |A & B| >= similarity * |A | B| on their sets
    of ``width``-word shingles, lower-cased in A-Z. component_id is the smallest
    doc_id reachable over links; text_hash is xxhash64 of the text. The banding misses a link of similarity s with
    probability (1 - s**rows)**bands: 3e-6 at 0.8, 7e-9 at 0.85.

    Null or wordless texts have an empty set, are linked with nothing and kept. A
    text of fewer words than ``width`` is one shingle. Rows that repeat a doc_id each
    give a row, with the component of its own text; if their texts differ and the id is
    the smallest of both, these texts are one document in the links. A null doc_id has
    component null and kept null. Texts of any length are read whole; further columns are
    not read; an empty table gives no rows. Sets are of 54-bit hashes.
    """
    spark = docs.sparkSession
    store = Store(spark, "dedup")
    n_minima = bands * rows
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = store.save(text.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_sketches(width, bands, rows), _SKETCH), "sketches")

    # One representative, the smallest doc_id, of each class of equal sets.
    n_rows = sketched.count()
    classes = store.save(
        sketched.where("n_shingles > 0 and doc_id is not null").groupBy("key_a", "key_b", "n_shingles")
        .agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")),
        "classes", 4 * n_rows,
    )
    # A band's hash already holds its number; pivots differ by bucket and lie anywhere in it.
    in_bands = classes.select("rep", F.explode("bands").alias("bucket")).where("rep is not null")
    shared = in_bands.groupBy("bucket").agg(F.count("*").alias("n"), *[F.min(F.struct(F.xxhash64("rep", F.lit(k)), "rep")).alias(f"p{k}") for k in range(pivots)]).where("n > 1")
    members = store.save(in_bands.join(shared.select("bucket", "n", F.element_at(F.array(*[F.col(f"p{k}.rep") for k in range(pivots)]), F.pmod("bucket", F.lit(pivots)).cast("int") + 1).alias("pivot")), "bucket"), "members", 4 * n_rows)
    n_members = members.count()
    sets = store.save(text.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id").mapInArrow(_sets(width), "rep long, hashes binary"), "sets", 8 * n_rows)

    small = classes.select("rep", "n_shingles", "sketch")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The linked ones of the pairs (x, y), by full sets; hot sides are split by the join."""
        with_left = pairs.join(sets.select(F.col("rep").alias("x"), F.col("hashes").alias("left_set")), "x")
        return with_left.join(sets.select(F.col("rep").alias("y"), F.col("hashes").alias("right_set")), "y").mapInArrow(_confirm(similarity), "x long, y long")

    least = _estimate(similarity, n_minima)

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, n_minima) for c in ("left_sketch", "right_sketch"))
            yield batch.select(["x", "y"]).filter(pa.array(np.count_nonzero(a == b, axis=1) >= least))

    def linked(pairs: DataFrame) -> DataFrame:
        """The linked ones among pairs of representatives that share a bucket."""
        pairs = pairs.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
        pairs = pairs.join(small.select(F.col("rep").alias("x"), F.col("n_shingles").alias("nx"), F.col("sketch").alias("left_sketch")), "x")
        pairs = pairs.join(small.select(F.col("rep").alias("y"), F.col("n_shingles").alias("ny"), F.col("sketch").alias("right_sketch")), "y")
        pairs = pairs.where(f"100 * least(nx, ny) >= {similarity} * greatest(nx, ny)").select("x", "y", "left_sketch", "right_sketch")
        return confirmed(pairs.mapInArrow(alike, "x long, y long")).select(F.col("x").alias("u"), F.col("y").alias("v"))

    found = store.save(components(linked(members.where("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b"))), store, "stars", n_members), "found-0", n_members)
    crowd = store.save(members.where("n > 2").select("bucket", "rep").join(classes.select("rep", "n_shingles"), "rep"), "crowd", n_members)
    for k in range(ROUNDS + 1):
        placed = store.save(crowd.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", "n_shingles", F.coalesce("component", "rep").alias("component")), f"placed-{k}", n_members)
        # Each bucket's components, the largest of them, and what lies outside it.
        parts = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
        mixed = parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("shingles").alias("shingles"), F.max(F.struct("n", "shingles", "component")).alias("top")).where("n > top.n")
        mixed = store.save(mixed.select("bucket", "n", "shingles", (F.col("n") - F.col("top.n")).alias("outer"), (F.col("shingles") - F.col("top.shingles")).alias("outer_shingles"), F.col("top.component").alias("largest")), f"mixed-{k}", n_members // 8)
        blocks = F.ceil(F.col("outer") / F.lit(BLOCK))
        rows_of = mixed.agg(F.coalesce(F.sum(F.col("n") * (blocks - 1) + F.col("outer") * (F.ceil(F.col("n") / F.lit(BLOCK)) - 1)), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if k == ROUNDS or rows_of[0] <= rows_of[1]:
            break  # the blocks' rows are in proportion to the members
        outer = placed.join(mixed.select("bucket", "largest"), "bucket")
        chosen = outer.where("component <> largest").groupBy("bucket").agg(F.min(F.struct(F.xxhash64("rep", "bucket", F.lit(k)), "rep", "component")).alias("p"))
        pairs = placed.join(chosen, "bucket").where("component <> p.component").select(F.col("rep").alias("a"), F.col("p.rep").alias("b"))
        more = store.save(linked(pairs).distinct(), f"links-{k}", n_members)
        if more.isEmpty():
            break
        found = store.save(components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more), store, f"round-{k}", n_members), f"found-{k + 1}", n_members)
        store.drop(f"placed-{k}", f"mixed-{k}")

    held = spread(placed, mixed).join(classes.select("rep", "sketch", "bands"), "rep").join(sets, "rep")
    more = held.groupBy("bucket", "i", "j").applyInArrow(_blocks_of_bucket(similarity, n_minima, bands), "u long, v long")
    found = store.save(components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more), store, "all", n_members), "found", n_members)

    moved = classes.select("key_a", "key_b", "n_shingles", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    moved = store.save(moved.select("key_a", "key_b", "n_shingles", F.coalesce("component", "rep").alias("found")), "moved", n_rows)
    store.drop(*store.saved - {"sketches", "moved"})
    out = sketched.select("doc_id", "n_shingles", "key_a", "key_b", "text_hash").join(moved, ["key_a", "key_b", "n_shingles"], "left").coalesce(1 + n_rows // FILE_ROWS)
    component = F.when(F.col("n_shingles") > 0, F.col("found")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"), "text_hash")


def without_near_duplicates(docs: DataFrame, *, width: int = 5, similarity: float = 80) -> DataFrame:
    """One row of each group of near copies in ``docs`` (doc_id, text), with all its columns: one of the smallest doc_id.

    Texts of one id are one document, as far as they come first in their classes of equal
    texts. Where the smallest id repeats, a row of its smallest text_hash stays. Null and wordless texts are copies of nothing and stay, as do
    rows with a null doc_id, whose texts are in no group. An empty table gives no rows.
    """
    found = near_duplicates(docs, width=width, similarity=similarity).where("doc_id is not null and n_shingles > 0")
    found = found.groupBy("doc_id", "text_hash").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    found = Store(docs.sparkSession, "copies").save(found, "found")
    only = found.where("kept").groupBy("doc_id").agg(F.min("text_hash").alias("only"), F.count("*").alias("texts")).where("texts > 1")
    gone = found.where("not kept").select("doc_id", "text_hash").union(found.where("kept").join(only, "doc_id").where("text_hash <> only").select("doc_id", "text_hash"))
    # The rows' own columns stay in one, so that no name can clash.
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    kept = rows.join(gone, ["doc_id", "text_hash"], "left_anti")
    repeats = found.where("kept and n > 1").select("doc_id", "text_hash")
    if not repeats.isEmpty():  # rows alike in id and text: one of them, picked by a partial aggregate
        one = kept.join(repeats, ["doc_id", "text_hash"], "left_semi").groupBy("doc_id", "text_hash").agg(F.first("row").alias("row"))
        kept = kept.join(repeats, ["doc_id", "text_hash"], "left_anti").select("row").union(one.select("row"))
    return kept.select("row.*")
