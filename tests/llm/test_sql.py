"""Queries with SQL, side by side, on sf0.01."""

from pathlib import Path

import duckdb
import pytest

from docloom.llm import queries as Q

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_equals_its_sql(spark, name):
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = c.sql(Q.SQL[name])
    got = Q.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    got = got.select(want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
