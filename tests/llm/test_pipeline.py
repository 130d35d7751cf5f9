import pytest

import corpus_pipeline
from tests.llm.conftest import COLUMNS, prose
from tests.llm.test_decontam import brute as leaks
from tests.llm.test_dedup import brute as groups
from tests.llm.tests_llm_data import labelled_rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, edge_rows):
    d = f"file://{tmp_path_factory.mktemp('corpus')}"
    rows, labels = labelled_rows(400)
    item = prose(77, 30)
    docs = [(i + 1000, t, None, "s", None, True, 7, 0.5, 1, False, 3) for i, t in rows]
    docs += [(5000 + i, docs[i][1], *docs[i][2:]) for i in range(30)] + [(6000, prose(78, 40) + " " + item, *docs[0][2:])]
    spark.createDataFrame(docs + edge_rows, COLUMNS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i + 1000, t, q) for i, t, q in labels], "doc_id long, toxic int, quality int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, folder, tmp_path):
    truth = {r.doc_id: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        after = docs.collect()
        kept = [r.doc_id for r in after]
        if name == "packing":
            assert {r.doc_id for r in after} == {r.doc_id for r in before}
            continue
        assert set(docs.columns) == set(COLUMNS.replace(",", "").split()[::2])
        if name in ("toxicity", "quality"):
            good = lambda r: not r.toxic if name == "toxicity" else r.quality
            known = [r for r in before if r.doc_id in truth]
            assert sum((r.doc_id in kept) == bool(good(truth[r.doc_id])) for r in known) >= 0.95 * len(known)
        elif name == "near_duplicates":
            want, _ = groups([(r.doc_id, r.text) for r in before], 5, 80)
            wordless = sum(r.doc_id is not None and not (r.text or "").split() for r in before)
            assert sorted(i for i in kept if i is not None) == sorted(i for i, c in want.items() if i == c)
            assert wordless >= 3 and kept.count(None) == sum(r.doc_id is None for r in before)
        else:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            bad = {d for d, _ in leaks([(r.doc_id, r.text) for r in before], items)}
            assert set(kept) == {r.doc_id for r in before} - bad


def test_one_row_of_each_group_of_copies_stays(spark):
    """Repeated rows, ids that repeat with other texts, and columns with the operators' own names."""
    a, b, c = prose(1, 80), prose(2, 80), prose(3, 80)
    rows = [(5, a), (5, a), (5, a), (5, b), (6, b + " x"), (7, c), (8, a + " y"), (8, "other words " + prose(4, 70)), (9, ""), (9, ""), (9, None), (None, a), (None, a)]
    columns = "doc_id int, text string, text_hash string, kept int, rows_ int, id_ int"
    docs = spark.createDataFrame([(*r, "h", 1, 2, 3) for r in rows], columns)
    after = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert after.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in after.collect()), key=repr)
    five = [t for i, t in got if i == 5]
    assert len(five) == 1 and five[0] in (a, b)
    # Two texts of the id 8 are one document, and one of them is a copy of document 5's.
    assert sorted((i for i, _ in got if i is not None)) == [5, 7, 9, 9, 9]
    assert sum(i is None for i, _ in got) == 2
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").collect() == []


def test_a_run_leaves_its_result_alone(spark, folder):
    import glob

    from verdure.llm.store import Store, shared_folder

    before = set(glob.glob(f"{shared_folder(spark).removeprefix('file://')}/*/*"))
    mark = len(Store.made)
    rows = corpus_pipeline.run(spark, folder)
    assert rows.count() > 0
    left = {p.rsplit("/", 1)[1] for p in set(glob.glob(f"{shared_folder(spark).removeprefix('file://')}/*/*")) - before}
    assert left == {"packing"} and len(Store.made) == mark + 1


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset"} <= set(rows[0].asDict())
    assert not any(r.doc_id == 6000 for r in rows)
