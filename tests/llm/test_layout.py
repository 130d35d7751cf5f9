import random
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from verdure.llm.layout import lay_out, neighbourhoods


def brute(rows, parts=8, per_file=1000, reach=1):
    """The rows that the query should return, from (doc_id, text, lang, source)."""
    values = [(s, lang, -1 if t is None else len(t.encode()), None if i is None else zlib.crc32(str(i).encode()) % 365) for i, t, lang, s in rows]
    rank = lambda v: (v is not None, v.encode() if isinstance(v, str) else v if v is not None else 0)
    cells = []
    for v in values:
        cells.append(tuple(parts * sum(rank(w[d]) < rank(v[d]) for w in values) // len(values) for d in range(4)))
    bits = parts.bit_length() - 1
    z = [int("".join(str(c >> b & 1) for b in range(bits - 1, -1, -1) for c in cell), 2) for cell in cells]
    order = sorted(range(len(rows)), key=lambda k: (z[k], rank(rows[k][0])))
    file = {k: p // per_file for p, k in enumerate(order)}
    bounds = {f: [(min(c), max(c)) for c in zip(*[cells[k] for k in order if file[k] == f])] for f in set(file.values())}
    out = []
    for p, k in enumerate(order):
        box = [(c - r, c + r) for c, r in zip(cells[k], (0, 0, reach, reach))]
        touched = sum(all(lo <= b and hi >= a for (lo, hi), (a, b) in zip(bounds[f], box)) for f in bounds)
        matching = len({file[j] for j in order if all(a <= c <= b for c, (a, b) in zip(cells[j], box))})
        out.append((rows[k][0], z[k], p, file[k], touched, matching, ",".join(f"{a},{b}" for a, b in bounds[file[k]])))
    return out


def made(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice([None, "", "hot", "hot", "hot", "ä", "z", "Z", f"s{rng.randrange(40)}"])
        text = None if rng.random() < 0.05 else "é" * rng.choice([0, 1, 5, rng.randrange(400)])
        rows.append((None if rng.random() < 0.02 else rng.randrange(n), text, rng.choice([None, "en", "en", "de"]), source))
    return rows


@pytest.mark.parametrize("n,per_file,reach", [(600, 40, 1), (600, 7, 2), (3, 1000, 1)])
def test_positions_files_and_boxes(spark, n, per_file, reach):
    rows = made(n, n + per_file)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    got = neighbourhoods(df, reach=reach, file_rows=per_file).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(rows, per_file=per_file, reach=reach)))


def test_edge_cases(edge, edge_rows):
    got = neighbourhoods(edge, file_rows=3).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute([(r[0], r[1], r[2], r[3]) for r in edge_rows], per_file=3)))


def test_empty(empty):
    assert neighbourhoods(empty).collect() == []


def test_boxes_of_any_shape_and_written_files(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, rng.randrange(50), rng.randrange(-9, 9), f"{rng.randrange(30)}", None if rng.random() < 0.1 else 1 << rng.randrange(60)) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, a int, b long, c string, d long")
    laid = lay_out(df, ["a", "b", "c", "d"], "id", bits=2, file_rows=25)
    held = laid.rows.collect()
    assert sorted(r.position for r in held) == list(range(900)) and len(laid.rows.columns) == 5 + 7
    boxes = [(k, *[x for lo, hi in [sorted((rng.randrange(4), rng.randrange(4))) for _ in range(4)] for x in (lo, hi)]) for k in range(40)]
    asked = spark.createDataFrame(boxes, "box long, " + ", ".join(f"lo{d} int, hi{d} int" for d in range(4)))
    matching = {r.box: r.files_matching for r in laid.matching(asked).collect()}
    touched = {r.box: r.files_touched for r in laid.touched(asked).collect()}
    for k, *b in boxes:
        inside = lambda r: all(b[2 * d] <= r[f"c{d}"] <= b[2 * d + 1] for d in range(4))
        assert matching.get(k, 0) == len({r.file for r in held if inside(r)})
        meets = [f for f in laid.files.collect() if all(f[f"lo{d}"] <= b[2 * d + 1] and f[f"hi{d}"] >= b[2 * d] for d in range(4))]
        assert touched.get(k, 0) == len(meets)
    laid.write(f"{tmp_path}/files")
    files = sorted((tmp_path / "files").glob("*.parquet"))
    assert len(files) == 36
    assert sorted(tuple(pq.read_table(f)["position"].to_pylist()) for f in files) == [tuple(range(k, k + 25)) for k in range(0, 900, 25)]


def test_one_value_in_all_rows_and_names(spark):
    df = spark.range(50).select("id", F.lit("x").alias("s"), F.lit(1).alias("a"), F.lit(None).cast("long").alias("b"))
    rows = lay_out(df, ["s", "a", "b", "a"], "id", file_rows=20).rows.collect()
    assert {r.z for r in rows} == {0} and all(r.position == r.id for r in rows)
    with pytest.raises(ValueError):
        lay_out(df.withColumn("z", F.lit(1)), ["s", "a", "b", "a"], "id")
