"""Queries that SQL can express, against it, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from orderweave.llm import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    relation = c.sql(registry.SQL[name])
    df = registry.QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(relation.columns)
    assert sorted(map(tuple, df.select(relation.columns).collect()), key=repr) == sorted(relation.fetchall(), key=repr)
