"""Registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdure.llm import lm, quality, toxicity
from verdure.llm.ann import nearest
from verdure.llm.chat import maximal_conversations
from verdure.llm.decontam import contaminated
from verdure.llm.dedup import near_duplicates
from verdure.llm.htmltext import main_text
from verdure.llm.layout import neighbourhoods
from verdure.llm.labelled import remainder, training_rows
from verdure.llm.lloyd import clusters
from verdure.llm.overlaps import jaccard_components
from verdure.llm.packing import pack
from verdure.llm.sharding import shard
from verdure.llm.store import Store, table

#: Bound of the labelled rows that the toxicity model learns from.
TOXICITY_ROWS = 24_000
#: Bounds of the labelled rows, and of their bytes, that the quality model learns from.
QUALITY_ROWS, QUALITY_BYTES = 4_000, 32_000_000


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, similarity=85).drop("text_hash")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = Store(spark, "quality")
    model = quality.fit(training_rows(docs, table(spark, sf_dir, "labels"), "quality", QUALITY_ROWS, store, QUALITY_BYTES))
    store.drop("labelled-quality")
    scored = quality.score(docs, model).withColumn("held_out", remainder() == 0)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maximal_conversations(table(spark, sf_dir, "conversations"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = Store(spark, "toxicity")
    model = toxicity.fit(training_rows(docs, table(spark, sf_dir, "labels"), "toxic", TOXICITY_ROWS, store))
    store.drop("labelled-toxic")
    scored = toxicity.score(docs, model).withColumn("held_out", remainder() == 0)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "passages")


def op6_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_adaptive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op8_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op10_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), 8)


def op11_clustered_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbourhoods(table(spark, sf_dir, "documents"))


def op12_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(table(spark, sf_dir, "embeddings"), k=8, rounds=10, dim=64)


def op13_heavy_light_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=5, similarity=80)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_dedup,
        op2_best_fit_packing,
        op3_quality_classifier,
        op4_chat_snapshots,
        op5_toxicity,
        op6_simhash_decontamination,
        op7_adaptive_scan,
        op8_recurrent_lm,
        op9_html_main_text,
        op10_histogram_sharding,
        op11_clustered_layout,
        op12_delta_lloyd,
        op13_heavy_light_join,
    )
}


def _lloyd_sql(k: int, rounds: int, dim: int) -> str:
    """Lloyd's rounds, one after the other."""
    steps = [
        f"""WITH e AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v AS m FROM e QUALIFY c < {k})""",
    ]
    near = "list_sum(list_transform(list_zip(v, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, vec_id, v, min(struct_pack(d := {near}, c := c)) AS best FROM e, c{i} GROUP BY ALL)""")
        if i < rounds:
            mean = "list(((s - (s % n + n) % n) // n)::BIGINT ORDER BY i)"
            sums = f"(SELECT best.c AS c, i, sum(v[i])::BIGINT AS s, count(*)::BIGINT AS n FROM a{i}, range(1, {dim + 1}) t(i) GROUP BY ALL)"
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT c, coalesce(x.m, c{i}.m) AS m FROM c{i} LEFT JOIN (SELECT c, {mean} AS m FROM {sums} GROUP BY c) x USING (c))""")
    return ",\n".join(steps) + f"""
SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance, sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia, sum(best.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON c = best.c"""


#: DuckDB SQL of the same rows, where SQL can express them.
ORACLE_SQL: dict[str, str] = {
    "op13_heavy_light_join": """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM w, LATERAL (SELECT unnest(range(1, greatest(len(w) - 3, 2))) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM c LEFT JOIN n USING (doc_id)""",
    "op1_minhash_dedup": """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM w, LATERAL (SELECT unnest(range(1, greatest(len(w) - 1, 2))) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)""",
    "op4_chat_snapshots": """
WITH whole AS (
  SELECT conv_id, count(*) AS n_turns,
    list(struct_pack(t := turn, r := role, x := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
hashed AS (SELECT conv_id, n_turns, turns, list_transform(turns, lambda s: struct_pack(r := s.r, x := s.x))::VARCHAR AS whole,
    list_transform(turns, lambda s: struct_pack(r := s.r, x := s.x)) AS body FROM whole),
prefixes AS (SELECT DISTINCT body[:k]::VARCHAR AS whole FROM hashed, LATERAL (SELECT unnest(range(1, n_turns)) AS k)),
kept AS (SELECT min(conv_id) AS conv_id, count(*) AS n_copies FROM hashed GROUP BY whole HAVING whole NOT IN (SELECT whole FROM prefixes))
SELECT conv_id, CAST(n_turns AS INTEGER) AS n_turns, n_copies,
  array_to_string(list_transform(turns, lambda s: '<|im_start|>' || coalesce(nullif(replace(s.r, '<|', '<\u200b|'), ''), 'unknown') || chr(10) || coalesce(replace(s.x, '<|', '<\u200b|'), '') || '<|im_end|>' || chr(10)), '') AS rendered
FROM kept JOIN hashed USING (conv_id)""",
    "op11_clustered_layout": """
WITH v AS (SELECT doc_id, source, lang, CASE WHEN text IS NULL THEN -1 ELSE strlen(text) END AS length,
    xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ord(s)::UBIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)), 4294967295::UBIGINT) % 365 AS date FROM documents),
c AS (SELECT doc_id, 8 * (rank() OVER (ORDER BY source NULLS FIRST) - 1) // count(*) OVER () AS c0, 8 * (rank() OVER (ORDER BY lang NULLS FIRST) - 1) // count(*) OVER () AS c1,
    8 * (rank() OVER (ORDER BY length NULLS FIRST) - 1) // count(*) OVER () AS c2, 8 * (rank() OVER (ORDER BY date NULLS FIRST) - 1) // count(*) OVER () AS c3 FROM v),
z AS (SELECT *, list_sum(list_transform([0, 1, 2], lambda b: ((c0 >> b & 1) * 8 + (c1 >> b & 1) * 4 + (c2 >> b & 1) * 2 + (c3 >> b & 1)) << 4 * b))::BIGINT AS z FROM c),
f AS (SELECT *, row_number() OVER (ORDER BY z, doc_id NULLS FIRST) - 1 AS position, (row_number() OVER (ORDER BY z, doc_id NULLS FIRST) - 1) // 1000 AS file FROM z),
b AS (SELECT file, min(c0) AS l0, max(c0) AS h0, min(c1) AS l1, max(c1) AS h1, min(c2) AS l2, max(c2) AS h2, min(c3) AS l3, max(c3) AS h3 FROM f GROUP BY file),
q AS (SELECT DISTINCT z, c0, c1, c2, c3 FROM f),
t AS (SELECT z, count(*) AS files_touched FROM q JOIN b ON c0 BETWEEN l0 AND h0 AND c1 BETWEEN l1 AND h1 AND l2 <= c2 + 1 AND h2 >= c2 - 1 AND l3 <= c3 + 1 AND h3 >= c3 - 1 GROUP BY z),
m AS (SELECT q.z, count(DISTINCT file) AS files_matching FROM q JOIN (SELECT DISTINCT file, c0, c1, c2, c3 FROM f) f ON f.c0 = q.c0 AND f.c1 = q.c1 AND abs(f.c2 - q.c2) <= 1 AND abs(f.c3 - q.c3) <= 1 GROUP BY q.z)
SELECT doc_id, z, position, file, files_touched, files_matching, concat_ws(',', l0, h0, l1, h1, l2, h2, l3, h3) AS file_bounds FROM f JOIN b USING (file) JOIN t USING (z) JOIN m USING (z)""",
    "op12_delta_lloyd": _lloyd_sql(8, 10, 64),
}
