"""Every query against its SQL in DuckDB, at the smallest scale."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from folioforge.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    number = lambda x: float(f"{x:.9g}") if isinstance(x, float) and math.isfinite(x) else x
    return sorted(([number(r[i]) for i in order] for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    found = duck.sql(catalogue.SQL[name])
    assert sorted(got.columns) == sorted(found.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(found.columns, found.fetchall())


def test_plans_have_no_cross_join(spark):
    for name in ("title_similarity_join", "collisions", "publisher_containment", "best_match_no_tie"):
        plan = catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_driver_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
