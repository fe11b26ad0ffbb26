import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tessella import queries as arrays

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def same(got, want):
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    x, y = (f[columns].sort_values(columns).reset_index(drop=True).astype(str) for f in (got, want))
    assert x.equals(y)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(arrays.queries()))
def test_query_equals_sql(spark, db, name):
    got = arrays.queries()[name](spark, SF).toPandas()
    if name in arrays.oracle_sql():
        same(got, db.sql(arrays.oracle_sql()[name]).df())
    else:
        assert len(got)


def test_every_query_is_registered():
    assert set(arrays.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
