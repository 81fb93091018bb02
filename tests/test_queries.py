"""Every registered query with a SQL twin gives the rows of that twin."""

import math

import duckdb
import pytest

from precis.plans.oracle import oracles
from precis.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = ["documents", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(str(plain(r[i])) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(oracles())))
def test_query_equals_sql(spark, duck, name):
    found = QUERIES[name](spark, FOLDER)
    twin = duck.execute(oracles()[name])
    names = [d[0] for d in twin.description]
    assert sorted(names) == sorted(found.columns)
    assert rows_of(found.columns, found.collect()) == rows_of(names, twin.fetchall())


def test_every_twin_has_a_query():
    assert set(oracles()) <= set(QUERIES)


@pytest.mark.parametrize("name", ["rougeL_labels", "hand_label_join", "cosine_labels", "split_stratified"])
def test_no_cartesian_product(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
