"""Every registered query against its SQL on the same tables, value by value."""

import os

import duckdb
import pandas as pd
import pytest

from windrow.plans.oracle import all_sql
from windrow.plans.queries import all_queries

FOLDER = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.01")
SQL, QUERIES = all_sql(), all_queries()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(FOLDER):
        connection.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    return connection


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    columns = []
    for c in frame.columns:
        values = frame[c]
        if values.dtype.kind == "M":
            values = values.astype("datetime64[us]").astype(str)
        columns.append([None if v is None or v != v or v is pd.NaT else (v.item() if hasattr(v, "item") else v) for v in values])
    return sorted(zip(*columns), key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def check_plan(name: str, plan: str) -> None:
    """No cross join of tables, nothing row by row in Python."""
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    ours = frame.toPandas()
    check_plan(name, frame._jdf.queryExecution().executedPlan().toString())
    theirs = duck.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) == len(theirs)
    assert len(ours) > 0
    mine, expected = canonical(ours), canonical(theirs)
    different = [(a, b) for a, b in zip(mine, expected) if a != b]
    assert not different, (len(different), different[:3])
