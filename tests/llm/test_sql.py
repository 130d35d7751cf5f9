import glob
import os

import duckdb
import pytest

from verdure.llm.queries import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    got, want = QUERIES[name](spark, DIR).toPandas(), c.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = sorted(got.columns)
    assert sorted(map(repr, got[key].itertuples(index=False, name=None))) == sorted(map(repr, want[key].itertuples(index=False, name=None)))


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, len(QUERIES) + 1))
