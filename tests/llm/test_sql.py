"""Queries against their SQL on the smallest tables; the driver compares them on larger ones."""

import os

import duckdb
import pytest

from meshlark.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["op5_sharding", "op11_importance", "op12_centroids"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    columns = sorted(want.columns)
    out = QUERIES[name](spark, DATA)
    assert sorted(out.columns) == columns
    got = [tuple(r[c] for c in columns) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want.select(", ".join(f'"{c}"' for c in columns)).fetchall(), key=str) and got
