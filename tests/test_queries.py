"""Every core query against its SQL, or for rows and a stable schema."""

import os

import pytest

from skein.plans import queries as core


def plain(df):
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    cell = lambda x: tuple(x) if hasattr(x, "__iter__") and not isinstance(x, str) else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    return sorted(repr(tuple(cell(x) for x in r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, sf, duck, name):
    df = core.QUERIES[name](spark, sf)
    got = df.toPandas()
    if name in core.SQL:
        assert plain(got) == plain(duck.sql(core.SQL[name]).df())
    else:
        assert list(got.columns) == df.columns


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
