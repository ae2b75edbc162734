"""Queries with SQL against DuckDB."""

import duckdb
import pytest

from peakloom.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    rel, df = c.sql(SQL[name]), QUERIES[name](spark, SF)
    names, cols = list(rel.columns), sorted(df.columns)
    assert sorted(names) == cols
    assert sorted(tuple(str(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(str(r[names.index(c)]) for c in cols) for r in rel.fetchall())
