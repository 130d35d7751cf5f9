"""Every query of the catalog against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from verdure.plans import catalog, files, pixels, rows  # noqa: F401

DIR = "/root/testdata/sf0.001"
#: Queries without rows on the smallest tables.
EMPTY = {"px_geometric_holes", "px_hole_regions", "populated_classes"}


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def as_rows(df):
    df = df[sorted(df.columns)]
    clean = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else v + 0.0 if isinstance(v, float) else v
    return sorted((tuple(clean(v) for v in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    got = catalog.QUERIES[name](spark, DIR).toPandas()
    assert len(got) > 0 or name in EMPTY
    if name in catalog.ORACLE_SQL:
        want = db.execute(catalog.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert as_rows(got) == as_rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
