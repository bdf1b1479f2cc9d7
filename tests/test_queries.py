"""Every registered query of the signal operators against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from undula import clip_queries as queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        out.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return out


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, con, name):
    got = queries.QUERIES[name](spark, DATA)
    want = con.sql(queries.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=str)


def test_stream_is_the_batch(spark):
    a, b = (sorted(map(tuple, queries.QUERIES[n](spark, DATA).collect())) for n in ("iir_stream_batches", "iir_bandpass"))
    assert a == b


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
