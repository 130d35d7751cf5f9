"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from verdure.llm.store import Store


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest node it knows."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node links its smaller neighbours and itself to the smallest of them; u > v in each edge."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, store: Store, name: str, rows: int | None = None, most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of the edges (u, v): component is the smallest node reachable.

    Neighbour lists are never gathered: a step is a grouped minimum and a join, so
    that a node with very many neighbours is pre-aggregated and its join partition
    split. Self-links and repeated links are allowed; no edges give no rows. ``rows``:
    the likely number of edges, by which the first table is dealt to files.
    """

    def keep(df: DataFrame, table: str, rows: int | None) -> tuple[DataFrame, tuple[int, int]]:
        """Writes the edges; their number and a fingerprint are observed on the way."""
        seen = Observation()
        saved = store.save(df.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")), table, rows)
        return saved, (seen.get["n"], seen.get["x"])

    now, state = keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}-0", rows)
    for k in range(1, most_rounds + 1):
        if not state[0]:
            break
        large = store.save(_large_star(now), f"{name}-{k}l", 2 * state[0])
        last = state
        now, state = keep(_small_star(large), f"{name}-{k}", 2 * state[0])
        store.drop(f"{name}-{k}l", f"{name}-{k - 1}")
        if state == last:
            break
    else:
        raise RuntimeError("components did not converge")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(now.select("v", "v").distinct())
