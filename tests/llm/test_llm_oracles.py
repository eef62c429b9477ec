import duckdb
import pytest

from galleyproof.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    got = sorted(map(tuple, df.collect()))
    want = sorted(con.sql(f"select {', '.join(df.columns)} from ({registry.ORACLE_SQL[name]})").fetchall())
    assert got == want
