"""A few of the queries against their SQL; the driver compares all of them."""

import os

import duckdb
import pytest

from meshlark.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["coordination_strained", "c6_weights", "scatter_indexed", "dft_sign_plus", "reciprocal_kernels", "expr_binary", "expr_sort", "expr_bits", "scatter_jvp", "expr_axes", "expr_wide", "expr_helpers", "spectral_aux_input", "spectral_rotation_transposed", "spectral_forward", "scatter_backward", "scatter_and_gather", "deconvolution_factor"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("embeddings", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    columns = sorted(want.columns)
    got = [tuple(r[c] for c in columns) for r in QUERIES[name](spark, DATA).collect()]
    assert sorted(got) == sorted(want.select(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert any(any(r) for r in got)


def test_an_edge_whose_last_bit_decides(spark, tmp_path):
    """Both ways between two atoms of sf0.1: with displacements summed in another order, the rounded weight was one unit less."""
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT * FROM (VALUES (0, [0.02289104089140892, -0.053986240178346634, -0.27857306599617004]::FLOAT[], 4), (1, [-0.025688935071229935, 0.07703203707933426, -0.006664508953690529]::FLOAT[], 4))
        t(vec_id, embedding, label)) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)""")
    con.execute(f"COPY (SELECT * FROM (VALUES (1, 0, 2, 3), (4, 3, 0, 2)) t(l_orderkey, l_partkey, l_suppkey, l_linenumber)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    for table in ("embeddings", "lineitem"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    want = con.sql(ORACLE_SQL["edge_contributions"]).fetchall()
    got = QUERIES["edge_contributions"](spark, str(tmp_path)).select("src", "dst", "sx", "sy", "sz", "d", "c").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_every_oracle_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
