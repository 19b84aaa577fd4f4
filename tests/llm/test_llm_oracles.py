"""Operators that SQL can express give the SQL's rows."""

import duckdb
import pytest

from tallgrass.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", queries.ORACLES)
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)

    def plain(v):
        return round(v, 6) if isinstance(v, float) else v

    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    found = con.execute(queries.ORACLES[name])
    given = [d[0] for d in found.description]
    assert sorted(given) == columns
    at = [given.index(c) for c in columns]
    assert mine == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)
