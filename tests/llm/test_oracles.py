"""Queries that SQL can express, against DuckDB on the smallest sample."""

import os

import duckdb
import pytest

from test_media_and_vectors import SCHEMA, vectors

from tessera.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want, got = con.sql(queries.ORACLE_SQL[name]), queries.QUERIES[name](spark, SF)
    assert got.columns == want.columns
    found = sorted(tuple(r) for r in got.collect())
    assert found == sorted(want.fetchall())


def test_linked_vectors(spark, tmp_path):
    df = spark.createDataFrame(vectors(), SCHEMA).where("vec_id is not null").dropDuplicates(["vec_id"])
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(con.sql(queries.ORACLE_SQL["op10_embedding_dedup"]).fetchall())
    assert sorted(tuple(r) for r in queries.op10_embedding_dedup(spark, str(tmp_path)).collect()) == want
    assert any(r[1] > 1 for r in want) and any(not r[3] for r in want)
