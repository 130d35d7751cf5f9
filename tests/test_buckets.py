"""Tables in buckets: what a change rewrites, what a repeated or broken commit leaves, and a bounded cache."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from verdure.sources import buckets
from verdure.streaming.state import BatchRun, latest_generation, read_stream, upsert_state

SCHEMA = "k long, seq long, v string"


def files_below(path):
    return sorted(f for f in glob.glob(f"{path}/**/*.parquet", recursive=True))


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def table(spark, tmp_path):
    return buckets.Buckets(spark, f"{tmp_path}/t", SCHEMA, F.col("k"), 8)


def put(spark, table, rows, **more):
    return buckets.upsert(table, spark.createDataFrame(rows, SCHEMA), ["k"], ["seq"], **more)


def test_a_change_rewrites_its_buckets_only(spark, table, tmp_path):
    assert table.read().collect() == [] and put(spark, table, []).buckets == []
    first = put(spark, table, [(k, 1, "a") for k in range(40)])
    assert first.buckets == list(range(8)) and first.rows == 40
    before = files_below(f"{tmp_path}/t")
    second = put(spark, table, [(3, 2, "b"), (11, 0, "old"), (43, 1, "new")])
    assert second.buckets == [3] and second.rows == 6
    after = files_below(f"{tmp_path}/t")
    assert [f for f in before if "bucket=3/" not in f] == [f for f in after if "bucket=3/" not in f]  # the others stay as they are
    assert not [f for f in after if "generation=0/bucket=3/" in f]  # what was replaced is gone
    assert rows_of(table.read()) == sorted([(k, 1, "a") for k in range(40) if k != 3] + [(3, 2, "b"), (43, 1, "new")])
    assert 0 < second.bytes <= sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(f"{tmp_path}/t") for f in names)


def test_a_repeated_commit_changes_nothing(spark, table):
    put(spark, table, [(1, 1, "a")], number=0)
    put(spark, table, [(1, 2, "b")], number=1)
    assert put(spark, table, [(1, 9, "z")], number=1).buckets == []
    assert rows_of(table.read()) == [(1, 2, "b")]


def test_a_commit_that_fails_leaves_the_table(spark, table):
    put(spark, table, [(1, 1, "a"), (2, 1, "a")])
    with pytest.raises(Exception, match="no"):
        table.commit([1], lambda old: old.withColumn("v", F.raise_error(F.lit("no")).cast("string")))
    assert rows_of(table.read()) == [(1, 1, "a"), (2, 1, "a")]
    assert put(spark, table, [(1, 3, "c")]).buckets == [1] and rows_of(table.read()) == [(1, 3, "c"), (2, 1, "a")]


def test_a_bucket_that_becomes_empty_and_null_keys(spark, table):
    put(spark, table, [(1, 1, "a"), (9, 1, "a"), (None, 1, "n")])
    table.commit([1], lambda old: old.where("false"))
    assert rows_of(table.read()) == [(None, 1, "n")] and list(table.manifest()["generation"]) == ["0"]
    assert rows_of(buckets.current(spark, table.path)) == [(None, 1, "n")]


def test_labels_of_a_region(spark, tmp_path):
    labels = buckets.label_table(spark, f"{tmp_path}/l")
    row = lambda crop, family: (crop, "", family, "", "", 0)
    frame = lambda rows: spark.createDataFrame(rows, labels.schema)
    buckets.upsert_label_rows(labels, frame([row(f"region_{k}.png", "x") for k in (46, 463, 110)] + [row("region_46_1.png", "x"), row("other.png", "y")]))
    assert buckets.upsert_label_rows(labels, frame([row("region_46.png", "z")])).buckets == [46]
    assert rows_of(labels.read().select("crop", "family")) == [("other.png", "y"), ("region_110.png", "x"), ("region_46.png", "z"), ("region_463.png", "x")]
    assert buckets.retract_label_rows(labels, frame([row("other.png", "")]).select("crop")).rows == 0
    assert set(buckets.rename_label_family(labels, "x", "w").buckets) == {463 % 64, 110 % 64}
    assert rows_of(labels.read().select("family")) == [("w",), ("w",), ("z",)]


def test_the_cache_keeps_what_was_used_last(spark, tmp_path):
    cache = buckets.Buckets(spark, f"{tmp_path}/c", "k long, bytes long, used long", F.col("k"), 4)
    entries = spark.createDataFrame([(k, 10, k) for k in range(20)] + [(90, 500, 99), (91, None, 1)], "k long, bytes long, used long")
    buckets.upsert(cache, entries, ["k"], ["used"])
    buckets.evict(cache, ["k"], "bytes", "used", 560, since=2)
    assert {r.k for r in cache.read().collect()} == {90, 19, 18, 17, 16, 15, 14}
    hits, misses, done = buckets.look_up(cache, spark.createDataFrame([(14, 1), (15, 1), (3, 1)], "k long, x int"), ["k"], "used", 200)
    assert {r.k for r in hits.collect()} == {14, 15} and {r.k for r in misses.collect()} == {3} and done.buckets == [2, 3]
    buckets.evict(cache, ["k"], "bytes", "used", 525)
    assert {r.k for r in cache.read().collect()} == {90, 14, 15}
    assert buckets.evict(cache, ["k"], "bytes", "used", 525).buckets == []


def test_state_of_a_stream_that_starts_again(spark, tmp_path):
    put_in = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    commits = []

    def run():
        stream = read_stream(spark, f"{tmp_path}/in", SCHEMA, per_trigger=1)
        upsert_state(stream, f"{tmp_path}/s", f"{tmp_path}/log", ["k"], ["seq"], F.col("k"), 16, commits).awaitTermination()
        return rows_of(latest_generation(spark, f"{tmp_path}/s"))

    put_in([(k, 1, "a") for k in range(64)])
    assert len(run()) == 64
    put_in([(5, 2, "b"), (5, 0, "old")])
    assert run() == sorted([(k, 1, "a") for k in range(64) if k != 5] + [(5, 2, "b")]) == run()
    assert [c.buckets for c in commits] == [list(range(16)), [5]] and commits[1].rows == 4


def test_a_run_that_is_cancelled_and_resumed(spark, tmp_path):
    for k in range(5):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: read_stream(spark, f"{tmp_path}/in", "id long", per_trigger=1)
    runs = []
    runs.append(BatchRun(stream(), lambda df: df, f"{tmp_path}/out", f"{tmp_path}/log"))
    assert runs[0].wait()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 50
    first = BatchRun(stream(), lambda df: df, f"{tmp_path}/out2", f"{tmp_path}/log2")
    first.cancel()
    ended = first.wait()
    held = spark.read.schema("id long, batch int").parquet(f"{tmp_path}/out2").count() if os.path.exists(f"{tmp_path}/out2") else 0
    assert held % 10 == 0 and (ended or held < 50)
    assert BatchRun(stream(), lambda df: df, f"{tmp_path}/out2", f"{tmp_path}/log2").wait()
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out2").collect()) == list(range(50))


def test_an_error_of_the_transform_is_no_cancel(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in")
    run = BatchRun(read_stream(spark, f"{tmp_path}/in", "id long"), lambda df: df.select(F.raise_error(F.lit("bad"))), f"{tmp_path}/out", f"{tmp_path}/log")
    with pytest.raises(Exception, match="bad"):
        run.wait()
