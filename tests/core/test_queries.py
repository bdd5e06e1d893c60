"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from tessella.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(values, order):
    return sorted(tuple(repr(r[k]) for k in order) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    frame = catalog.queries()[name](spark, SF)
    got = frame.collect()
    if name not in catalog.oracle_sql():
        assert got
        return
    want = duck.sql(catalog.oracle_sql()[name])
    names = sorted(frame.columns)
    assert names == sorted(want.columns)
    assert rows(got, names) == rows(want.fetchall(), [want.columns.index(c) for c in names])


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
