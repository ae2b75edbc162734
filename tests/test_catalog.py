"""Every catalogue query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from peakloom.plans import format_queries, kernel_queries, rule_queries  # noqa: F401
from peakloom.plans.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return ("nan" if math.isnan(v) else repr(v + 0.0)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, name):
    df, rel = QUERIES[name](spark, SF), duck.sql(SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    kinds = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    names = list(rel.columns)
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows and all(len(r) == len(df.columns) for r in rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_band_joins_are_equi_joins(spark):
    for name in ("q23_band_join_ppm", "q24_tight_first_band_join", "q25_interval_overlap_join", "q26_range_containment_join", "q42_mass_shift_pairs"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_filters_reach_the_scan(spark):
    plan = QUERIES["q01_scan_filter_project"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan and "l_tax" not in plan
