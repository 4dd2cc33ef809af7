"""Every core query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from spindrel.plans import atlas, catalog, directory, orphans, serve

DATA = "/root/testdata/sf0.001"
CORE = {**orphans.QUERIES, **directory.QUERIES, **atlas.QUERIES, **serve.QUERIES, **catalog.QUERIES}
CORE_SQL = {**orphans.SQL, **directory.SQL, **atlas.SQL, **serve.SQL, **catalog.SQL}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        path = f"{DATA}/{name}" + ("/*.parquet" if os.path.isdir(f"{DATA}/{name}") else "")
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda x: "" if x is None else f"{float(x):.6g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(tuple(text(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, sql, name):
    got = CORE[name](spark, DATA)
    values = got.collect()
    if name in CORE_SQL:
        want = sql.execute(CORE_SQL[name])
        columns = [d[0] for d in want.description]
        assert sorted(got.columns) == sorted(columns)
        assert rows(got.columns, values) == rows(columns, want.fetchall())


def test_entry(spark):
    assert set(CORE) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
