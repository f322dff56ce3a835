"""Each catalogued query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from pairfold import queries as core

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", core.QUERIES)
def test_query(spark, sql, name):
    got = core.QUERIES[name](spark, FOLDER)
    data = [tuple(r) for r in got.collect()]
    if name in core.SQL:
        want = sql.execute(core.SQL[name])
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(got.columns)
        assert rows(got.columns, data) == rows(columns, want.fetchall())
    else:
        assert data


def test_entry_offers_the_catalogue():
    import __spark_entry__ as entry

    assert set(core.QUERIES) <= set(entry.queries()) and set(core.SQL) <= set(entry.oracle_sql())
