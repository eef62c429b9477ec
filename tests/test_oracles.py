"""Every query with an oracle gives DuckDB's rows, and some rows."""

import os

import duckdb
import pytest

from galleyproof.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def norm(rows):
    return sorted((tuple("" if x is None else str(x) for x in r) for r in rows))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = norm(df.select(*columns).collect())
    assert got
    if name in catalog.ORACLE_SQL:
        rel = duck.sql(catalog.ORACLE_SQL[name])
        assert sorted(rel.columns) == columns
        want = norm(duck.sql(f"select {', '.join(columns)} from ({catalog.ORACLE_SQL[name]})").fetchall())
        assert len(got) == len(want)
        bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
        assert not bad, bad[:3]
