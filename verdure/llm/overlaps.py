"""Exact Jaccard join of shingle sets: a size-aware heavy-light join.

First the shingles that no other set has are told from shared ones. Blocks of documents
ask for their shingles by ranges of hashes, each distinct one once, so that a shingle of
very many documents is asked for once by a block. A set of which too few shingles are
shared has no partner, and unshared shingles count for its size alone from here on.

Of what is left, a set is light below a boundary and heavy from there. Two light sets
that are linked share a subset of the least overlap that their sizes allow; light
sets enumerate their subsets of each such size. A heavy set scans the inverted lists of
its rarest shingles, as many as a partner can't miss all of, and the lists hold every set
that is large enough to be its partner. The boundary is where the enumerated subsets
and the lists' entries are fewest together, from sums by set size.

Sets meet in lists, and lists with the same members are one. Within a list, links are
made to one member first. Lists that still have more than one component are put together
to groups where they share members, unless single lists make fewer rows; the members
outside a group's largest component scan inverted lists over blocks of all. Only links
that join components become rows; nothing is capped.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdure.llm import scan
from verdure.llm.components import components
from verdure.llm.dedup import BLOCK as MEMBERS
from verdure.llm.dedup import BLOCK_SHINGLES as MEMBER_SHINGLES
from verdure.llm.dedup import ROUNDS, spread
from verdure.llm.store import FILE_ROWS, Store

U = np.uint64
#: Bits of a shingle's hash.
BITS = 54
#: Shingles of a block of documents, and of a range of hashes, on average.
BLOCK = 1 << 20
#: Documents of a block, at most: their numbers take two bytes, and one number says that several have a shingle.
MOST = (1 << 16) - 1
MANY = (1 << 16) - 1
#: Sets of more shingles are heavy at any cost: at a similarity of 0.8 one of them has over a hundred thousand subsets.
LIGHT = 24

_KEYS = T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "n_shingles", "key_a", "key_b")])
_ASKED = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("bucket", T.LongType()), T.StructField("asked", T.IntegerType()),
    T.StructField("rows", T.BinaryType()), T.StructField("hashes", T.BinaryType()), T.StructField("own", T.BinaryType()),
])
_SET = T.StructType([*_KEYS.fields, T.StructField("shared", T.BinaryType())])


def least_overlap(a: int, b: int, similarity: int) -> int:
    """The fewest common elements with which sets of these sizes are linked."""
    return -(-similarity * (a + b) // (100 + similarity))


def subset_sizes(n: int, similarity: int, most: int) -> list[int]:
    """The least overlaps of a set of n elements with partners of at most ``most``."""
    return sorted({least_overlap(n, m, similarity) for m in range(-(-similarity * n // 100), min(most, n * 100 // similarity) + 1)})


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """ids, sizes, two keys of the whole set, hashes and offsets, for runs of documents."""
    for lo, hi, raw, at in scan.blocks(batch.column(1)):
        h, s = scan.distinct(*scan.shingle_sets(scan.Scan(raw, at), width)[:2])
        n = np.diff(s)
        full = np.flatnonzero(n)
        keys = np.zeros((2, hi - lo), np.int64)
        if len(full):
            runs = s[full]
            keys[0, full] = np.add.reduceat(scan.mix(h), runs).view(np.int64)
            keys[1, full] = np.add.reduceat(scan.mix(h ^ U(0xA5A5A5A5A5A5A5A5)), runs).view(np.int64)
        yield batch.column(0).slice(lo, hi - lo), n, keys[0], keys[1], h, s


def _keys(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, n, a, b, _, _ in _sets(batch, width):
                yield pa.RecordBatch.from_arrays([ids, pa.array(n.astype(np.int64)), pa.array(a), pa.array(b)], names=_KEYS.names)

    return run


def _pack(x: np.ndarray) -> bytes:
    """Rising 64-bit numbers: differences by byte planes, compressed."""
    planes = np.ascontiguousarray(np.diff(x, prepend=U(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=8 * n, codec="zstd"), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=U)


def _ask(width: int, buckets: int, most: int):
    """Blocks of documents as requests, by ranges of hashes, and as one row of their own with what is known to be shared.

    Of a block's documents with equal sets the one of the smallest id asks for all.
    """
    edges = np.array([-(-(k << BITS) // buckets) for k in range(1, buckets)], U)

    def flush(block: int, ids, n, a, b, h) -> pa.RecordBatch:
        ids, n, a, b = (np.concatenate(x) for x in (ids, n, a, b))
        order = np.lexsort((ids, n, b, a))
        first = np.ones(len(ids), bool)
        first[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1]) | (n[order][1:] != n[order][:-1])
        keep = np.zeros(len(ids), bool)
        keep[order[first]] = True
        hashes = np.concatenate(h)[np.repeat(keep, n)]
        ids, n, a, b = ids[keep], n[keep], a[keep], b[keep]
        row = np.repeat(np.arange(len(n), dtype=np.uint16), n)
        order = np.argsort(hashes, kind="stable")
        hashes, row = hashes[order], row[order]
        start = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        count = np.diff(np.append(start, len(hashes)))
        ours = np.repeat(count > 1, count)
        asked, by = hashes[start], np.where(count > 1, MANY, row[start]).astype(np.uint16)
        at = np.concatenate(([0], np.searchsorted(asked, edges), [len(asked)]))
        some = np.flatnonzero(np.diff(at))
        out = [{"block": block, "bucket": int(k), "asked": int(at[k + 1] - at[k]), "rows": by[at[k] : at[k + 1]].tobytes(), "hashes": _pack(asked[at[k] : at[k + 1]]), "own": None} for k in some]
        own = np.concatenate([x.astype(np.int64) for x in (ids, n, a, b)])
        out.append({"block": block, "bucket": -1 - block, "asked": len(some), "rows": row[ours].tobytes(), "hashes": hashes[ours].tobytes(), "own": own.tobytes()})
        return pa.RecordBatch.from_pylist(out, pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("asked", pa.int32()), ("rows", pa.binary()), ("hashes", pa.binary()), ("own", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size, docs = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            for ids, n, a, b, h, _ in _sets(batch, width):
                real = n > 0
                if held and (size + len(h) > most or docs + len(n) > MOST):
                    yield flush(block, *zip(*held))
                    block, held, size, docs = block + 1, [], 0, 0
                if real.any():
                    held.append((ids.to_numpy(zero_copy_only=False)[real].astype(np.int64), n[real], a[real], b[real], h))
                    size, docs = size + len(h), docs + int(real.sum())
        if held:
            yield flush(block, *zip(*held))

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Tells each block which of the shingles that one of its documents has are also elsewhere; a block's own row passes."""
    if table.column("bucket")[0].as_py() < 0:
        return table
    asked = table.column("asked").to_numpy()
    hashes = np.concatenate([_unpack(x.as_buffer(), n) for x, n in zip(table.column("hashes"), asked)])
    rows = np.concatenate([np.frombuffer(x.as_buffer(), np.uint16) for x in table.column("rows")])
    order = np.argsort(hashes, kind="stable")
    s = hashes[order]
    again = np.zeros(len(s), bool)
    again[1:] = s[1:] == s[:-1]
    again[:-1] |= again[1:]
    shared = np.zeros(len(s), bool)
    shared[order] = again
    shared &= rows != MANY  # the block knows these
    at = np.concatenate(([0], np.cumsum(asked)))
    cut = [slice(*x) for x in zip(at[:-1], at[1:])]
    return table.set_column(3, "rows", pa.array([rows[c][shared[c]].tobytes() for c in cut], pa.binary())).set_column(4, "hashes", pa.array([hashes[c][shared[c]].tobytes() for c in cut], pa.binary()))


def _gather(similarity: int):
    """The sets of a block that can have a partner, with the hashes of their shared shingles."""

    def run(table: pa.Table) -> pa.Table:
        buckets = table.column("bucket").to_numpy()
        own = np.flatnonzero(buckets < 0)
        if len(own) != 1 or table.column("asked")[int(own[0])].as_py() != len(buckets) - 1:
            raise RuntimeError("a block's requests were not all answered: the documents came in another order when a part was read again")
        ids, n, a, b = np.frombuffer(table.column("own")[int(own[0])].as_buffer(), np.int64).reshape(4, -1)
        rows = np.concatenate([np.frombuffer(x.as_buffer(), np.uint16) for x in table.column("rows")])
        hashes = np.concatenate([np.frombuffer(x.as_buffer(), U) for x in table.column("hashes")])
        count = np.bincount(rows, minlength=len(n))
        alive = np.flatnonzero(100 * count >= similarity * n)
        order = np.lexsort((hashes, rows))
        hashes, at = hashes[order], np.concatenate(([0], np.cumsum(count)))
        shared = [hashes[at[k] : at[k + 1]].tobytes() for k in alive]
        return pa.table([pa.array(ids[alive]), pa.array(n[alive]), pa.array(a[alive]), pa.array(b[alive]), pa.array(shared, pa.binary())], names=_SET.names)

    return run


def shared_sets(docs: DataFrame, width: int, similarity: int, buckets: int, block: int, store: Store) -> DataFrame:
    """(rep, n, shared) of each distinct set that can have a partner: its smallest doc_id, its size, the hashes that other sets have too."""
    asked = docs.where("doc_id is not null").mapInArrow(_ask(width, buckets, block), _ASKED)
    answers = store.save(asked.groupBy("bucket").applyInArrow(_answer, _ASKED), "answers")
    alive = answers.groupBy("block").applyInArrow(_gather(similarity), _SET)
    found = store.save(alive, "alive")
    one = found.groupBy("key_a", "key_b", "n_shingles").agg(F.min("doc_id").alias("doc_id"))
    # A set asks once in each of its blocks; copies of one id in several blocks are alike.
    return found.join(one, [*_KEYS.names]).dropDuplicates(_KEYS.names).select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "key_a", "key_b", "shared")


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each set and shared shingle."""
    for batch in batches:
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column(1)]
        at = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))], names=["id", "hash"])


def _ranked(told: DataFrame, similarity: int) -> DataFrame:
    """(id, n, hashes, keep, entries) of the sets (id, n, hash, df) that can still have a partner: hashes, the rarest first; how many of these a partner can't miss; the entries of their lists."""
    held = told.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct("df", "hash"))).alias("e"))
    held = held.withColumn("keep", (F.size("e") + 1 - F.ceil(F.col("n") * similarity / 100)).cast("long")).where("keep > 0")
    return held.select("id", "n", F.transform("e", lambda x: x["hash"]).alias("hashes"), "keep", F.aggregate(F.slice("e", 1, F.col("keep").cast("int")), F.lit(0).cast("long"), lambda s, x: s + x["df"]).alias("entries"))


def _lists(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """The hashes of each row of a list column."""
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = np.concatenate(([0], np.cumsum(pa.compute.list_value_length(c).to_numpy(zero_copy_only=False))))
    flat = c.flatten().to_numpy(zero_copy_only=False).view(U)
    return [flat[x:y] for x, y in zip(at[:-1], at[1:])]


def light_cost(n: int, kept: int, similarity: int) -> int:
    """Subsets that a set of n elements, ``kept`` of them shared, enumerates."""
    return sum(math.comb(kept, c) for c in subset_sizes(n, similarity, LIGHT))


def boundary(sizes: list[tuple[int, int, int, int]], similarity: int) -> int:
    """The set size from which sets are heavy, from (size, subsets, list entries, prefix length) sums; the least cost, the smaller size among ties.

    Light sets that a heavy one may be linked to lie in the lists too.
    """
    best = None
    for x in range(1, LIGHT + 2):
        cost = sum(subsets for n, subsets, _, _ in sizes if n < x) + sum(entries for n, _, entries, _ in sizes if n >= x) + sum(keep for n, _, _, keep in sizes if n < x <= n * 100 // similarity)
        if best is None or cost < best[0]:
            best = cost, x
    return best[1]


def _listed(similarity: int, heavy: int):
    """(bucket, rep): subsets of light sets, rarest shingles of heavy sets and of those that one of them may be linked to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = scan.randoms(LIGHT + 1, 23) | U(1)
        for batch in batches:
            keys, at = [], []
            for n, keep, h in zip(batch.column("n").to_pylist(), batch.column("keep").to_pylist(), _lists(batch.column("hashes"))):
                if n < heavy:
                    marks = scan.mix(np.sort(h))
                    for c in subset_sizes(n, similarity, heavy - 1):
                        chosen = np.array(list(itertools.combinations(range(len(marks)), c)), np.int64).reshape(-1, c)
                        keys.append(scan.mix((marks[chosen] * turns[:c]).sum(axis=1, dtype=U) + turns[c]))
                if n * 100 // similarity >= heavy:
                    keys.append(scan.mix(h[:keep] ^ U(0x5DEECE66D5DEECE6)))
                at.append(sum(map(len, keys)))
            rep = np.repeat(np.arange(batch.num_rows), np.diff([0, *at]))
            yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(keys) if keys else np.zeros(0, U)).view(np.int64)), batch.column("rep").take(pa.array(rep))], names=["bucket", "rep"])

    return run


def _linked(similarity: int):
    """Keeps the pairs (x, y) that are linked, by the shared shingles and the sizes of both sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y, n) in enumerate(zip(_lists(batch.column("set_x")), _lists(batch.column("set_y")), batch.column("n").to_pylist())):
                met = np.sort(np.concatenate((x, y)))
                keep[i] = (100 + similarity) * np.count_nonzero(met[1:] == met[:-1]) >= similarity * n
            yield batch.select(["x", "y"]).filter(pa.array(keep))

    return run


def _scanned(similarity: int):
    """Links across components between a block of a group's members outside its largest component and a block of all.

    Inverted lists over the rarest shingles of the latter name the candidates; whole sets decide.
    """

    def run(table: pa.Table) -> pa.Table:
        rep, comp, asks, outside, n, keep = (table.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "component", "asks", "outside", "n", "keep"))
        sets = _lists(table.column("hashes"))
        comp = comp.copy()
        right = np.flatnonzero(~asks)
        owner = np.repeat(right, keep[right])
        hashes = np.concatenate([sets[k][: keep[k]] for k in right]) if len(right) else np.zeros(0, U)
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], owner[order]
        xs, ys = [], []
        for k in np.flatnonzero(asks):
            mine = sets[k][: keep[k]]
            lo = np.searchsorted(hashes, mine, "left")
            count = np.searchsorted(hashes, mine, "right") - lo
            may = np.unique(owner[np.repeat(lo, count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))])
            # Two members outside the largest component meet from either side; the smaller one asks.
            may = may[(comp[may] != comp[k]) & (~outside[may] | (rep[may] > rep[k])) & (100 * np.minimum(n[may], n[k]) >= similarity * np.maximum(n[may], n[k]))]
            own = np.sort(sets[k])
            for y in may:
                if comp[y] == comp[k]:
                    continue
                at = np.minimum(np.searchsorted(own, sets[y]), len(own) - 1)
                if (100 + similarity) * np.count_nonzero(own[at] == sets[y]) >= similarity * (n[y] + n[k]):
                    comp[comp == comp[y]] = comp[k]
                    xs.append(rep[k])
                    ys.append(rep[y])
        return pa.table({"u": pa.array(xs, pa.int64()), "v": pa.array(ys, pa.int64())})

    return run


def _mixed(placed: DataFrame) -> DataFrame:
    """(bucket, n, shingles, outer, outer_shingles, largest, rows) of the buckets of more than one component: members, those outside the largest one, and the rows that ``spread`` makes of them."""
    parts = placed.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.sum("shingles").alias("shingles"))
    mixed = parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("shingles").alias("shingles"), F.max(F.struct("n", "shingles", "component")).alias("top")).where("n > top.n")
    mixed = mixed.select("bucket", "n", "shingles", (F.col("n") - F.col("top.n")).alias("outer"), (F.col("shingles") - F.col("top.shingles")).alias("outer_shingles"), F.col("top.component").alias("largest"))
    blocks = lambda n, s: F.greatest(F.ceil(F.col(n) / F.lit(MEMBERS)), F.ceil(F.col(s) / F.lit(MEMBER_SHINGLES)))
    return mixed.withColumn("rows", F.col("n") * blocks("outer", "outer_shingles") + F.col("outer") * blocks("n", "shingles"))


def _grouped(placed: DataFrame, mixed: DataFrame, store: Store, n_members: int) -> tuple[DataFrame, DataFrame]:
    """Lists that share members as one group, so that a set goes to a task once and not for each of its lists, wherever that makes fewer rows."""
    left = store.save(placed.join(mixed.select("bucket"), "bucket"), "left", n_members)
    first = left.groupBy("bucket").agg(F.min("rep").alias("v"))
    found = store.save(components(left.join(first, "bucket").select(F.col("rep").alias("u"), "v"), store, "groups", n_members), "groups", n_members)
    # A group's members, each once, in the group's own bucket.
    whole = store.save(left.select("rep", "shingles", "component").distinct().join(found.withColumnRenamed("node", "rep").withColumnRenamed("component", "group"), "rep").select(F.xxhash64("group", F.lit("group")).alias("bucket"), "rep", "shingles", "component", "group"), "whole", n_members)
    mixed_groups = _mixed(whole)
    own = mixed.join(first, "bucket").join(found.withColumnRenamed("node", "v").withColumnRenamed("component", "group"), "v")
    rows = own.groupBy("group").agg(F.sum("rows").alias("listed"))
    better = store.save(mixed_groups.join(whole.select("bucket", "group").distinct(), "bucket").join(rows, "group").where("rows <= listed").select("group", "bucket"), "better", n_members // 8)
    groups = mixed_groups.join(better.select("bucket"), "bucket")
    rest = own.join(better.select("group"), "group", "left_anti").select(mixed.columns)
    columns = ["bucket", "rep", "component"]
    return whole.join(better.select("bucket"), "bucket").select(columns).union(left.join(rest.select("bucket"), "bucket").select(columns)), groups.select(mixed.columns).union(rest)


def _link(members: DataFrame, sets: DataFrame, similarity: int, store: Store, n_members: int) -> DataFrame:
    """(node, component) of the linked sets, members (bucket, rep) meeting in lists; sets (rep, n, keep, hashes)."""
    side = lambda s: sets.select(F.col("rep").alias(s), F.col("n").alias(f"n_{s}"), F.col("hashes").alias(f"set_{s}"))
    size = lambda s: sets.select(F.col("rep").alias(s), F.col("n").alias(f"m_{s}"))

    def linked(pairs: DataFrame) -> DataFrame:
        pairs = pairs.where("a <> b").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
        pairs = pairs.join(size("x"), "x").join(size("y"), "y").where(f"100 * least(m_x, m_y) >= {similarity} * greatest(m_x, m_y)").select("x", "y")
        met = pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "set_x", "set_y", (F.col("n_x") + F.col("n_y")).alias("n"))
        return met.mapInArrow(_linked(similarity), "x long, y long").select(F.col("x").alias("u"), F.col("y").alias("v"))

    order = F.struct(F.xxhash64("rep"), "rep")
    pivot = members.groupBy("bucket").agg(F.min(order)["rep"].alias("b"))
    found = store.save(components(linked(members.join(pivot, "bucket").select(F.col("rep").alias("a"), "b")), store, "stars", n_members), "found-0", n_members)
    sized = store.save(members.join(sets.select("rep", F.size("hashes").cast("long").alias("shingles")), "rep"), "sized", n_members)
    for k in range(ROUNDS + 1):
        placed = store.save(sized.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", "shingles", F.coalesce("component", "rep").alias("component")), f"placed-{k}", n_members)
        mixed = store.save(_mixed(placed), f"mixed-{k}", n_members // 8)
        # Rounds of single members go on while blocks would ship more than two rows for each.
        rows, least = mixed.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum(F.col("n") + F.col("outer")), F.lit(0))).first()
        if k == ROUNDS or rows <= least:
            break
        outer = placed.join(mixed.select("bucket", "largest"), "bucket")
        chosen = outer.where("component <> largest").groupBy("bucket").agg(F.min(F.struct(F.xxhash64("rep", F.lit(k)), "rep", "component")).alias("p"))
        pairs = placed.join(chosen, "bucket").where("component <> p.component").select(F.col("rep").alias("a"), F.col("p.rep").alias("b"))
        links = store.save(linked(pairs), f"links-{k}", n_members)
        if links.isEmpty():
            break
        found = store.save(components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).union(links), store, f"round-{k}", n_members), f"found-{k + 1}", n_members)
    placed, mixed = _grouped(placed, mixed, store, n_members)
    held = spread(placed, mixed.drop("rows")).join(sets.select("rep", "n", "keep", "hashes"), "rep")
    links = held.groupBy("bucket", "i", "j").applyInArrow(_scanned(similarity), "u long, v long")
    return components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).union(links), store, "all", n_members)


def jaccard_components(docs: DataFrame, *, width: int = 5, similarity: int = 80, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text), by all links, exactly.

    Two documents are linked if 100 * |A & B| >= similarity * |A | B| on their sets of
    ``width``-word shingles, lower-cased in A-Z. component_id is the smallest doc_id
    reachable over links, the document's own included. Documents ask for their shingles in
    blocks of about ``block``.

    Null or wordless texts have an empty set and are linked with nothing. A text of fewer
    words than ``width`` is one shingle. Rows that repeat a doc_id each give a row, with
    the component of their own text; one id with several texts is as many documents. A
    null doc_id has component null and links nothing. Texts of any length are read whole; further columns
    are not read; an empty table gives no rows. Sets are of 54-bit hashes. ``docs`` is read
    several times and should be a table, as the parts of a text that is read again must
    come in the same order; if they don't, the join fails rather than miss a link.
    """
    spark = docs.sparkSession
    store = Store(spark, "jaccard")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = store.save(text.mapInArrow(_keys(width), _KEYS), "keys")
    n_rows, shingles = keyed.agg(F.count("*"), F.coalesce(F.sum("n_shingles"), F.lit(0))).first()
    alive = store.save(shared_sets(text, width, similarity, max(1, shingles // block), block, store).withColumn("id", F.xxhash64("rep", "key_a", "key_b")), "sets")
    n_alive = alive.count()
    # How often a shingle occurs in the sets that are left; what then has no partner leaves.
    entries = store.save(alive.select("id", "shared").mapInArrow(_entries, "id long, hash long"), "entries")
    often = entries.groupBy("hash").agg(F.count("*").alias("df")).where("df > 1")
    told = entries.join(often, "hash").join(alive.select("id", "n"), "id")
    sets = store.save(_ranked(told, similarity).join(alive.select("id", "rep", "key_a", "key_b"), "id"), "ranked")
    cost = [(r["n"], r["kept"], r["times"], r["entries"], r["keep"]) for r in sets.where(F.col("n") <= LIGHT).groupBy("n", F.size("hashes").alias("kept")).agg(F.count("*").alias("times"), F.sum("entries").alias("entries"), F.sum("keep").alias("keep")).collect()]
    heavy = boundary([(n, times * light_cost(n, kept, similarity), e, keep) for n, kept, times, e, keep in cost], similarity)
    # A set's id stands for it from here on, as an id of several texts would mix them.
    lists = store.save(sets.select("n", "keep", "hashes", F.col("id").alias("rep")).mapInArrow(_listed(similarity, heavy), "bucket long, rep long").distinct(), "lists")
    mark = F.xxhash64("rep")
    met = lists.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(mark).alias("x"), F.sum(F.shiftright(mark, 20)).alias("s")).where("n > 1")
    only = met.groupBy("n", "x", "s").agg(F.min("bucket").alias("bucket"))
    members = store.save(lists.join(only.select("bucket"), "bucket"), "members")
    n_members = members.count()
    found = store.save(_link(members, sets.select(F.col("id").alias("rep"), "n", "keep", "hashes"), similarity, store, n_members), "found", n_members)
    # The component of a class of equal sets is named by its smallest doc_id.
    named = found.join(sets.select(F.col("id").alias("node"), "rep", "key_a", "key_b", "n"), "node")
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    named = named.join(least, "component").select("key_a", "key_b", F.col("n").alias("n_shingles"), "least")
    classes = keyed.where("n_shingles > 0 and doc_id is not null").groupBy("key_a", "key_b", "n_shingles").agg(F.min("doc_id").alias("rep"))
    classes = store.save(classes.join(named, ["key_a", "key_b", "n_shingles"], "left").select("key_a", "key_b", "n_shingles", F.coalesce("least", "rep").alias("found")), "classes", n_rows)
    store.drop(*store.saved - {"keys", "classes"})
    out = keyed.join(classes, ["key_a", "key_b", "n_shingles"], "left").coalesce(1 + n_rows // FILE_ROWS)
    component = F.when(F.col("n_shingles") > 0, F.col("found")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
