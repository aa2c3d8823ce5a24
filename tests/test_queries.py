"""Every registered query of the library against its SQL twin, on the small tables."""

import math
import os

import duckdb
import pytest

from quarry.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for f in os.listdir(SF):
        connection.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return connection


def norm(x):
    if isinstance(x, float) and math.isfinite(x):
        return round(x, 9)
    return x


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_is_its_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    mine = sorted((tuple(norm(r[c]) for c in columns) for r in got.collect()), key=repr)
    twin = duck.sql(registry.oracle_sql()[name])
    assert sorted(twin.columns) == columns
    theirs = sorted((tuple(norm(v) for v in r) for r in twin.select(", ".join(f'"{c}"' for c in columns)).fetchall()), key=repr)
    assert mine == theirs


def test_no_query_joins_by_nested_loops(spark):
    for name in ("route_match", "unconsumed", "missing", "near_miss", "dup_windows", "readme_lines"):
        plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
