"""Operators over a few rows: against rows written by hand, and against recorded ones."""

import duckdb
import pytest

from . import handwritten, recorded
from .test_queries import norm

CASES = [(m, name) for m in (handwritten, recorded) for name in sorted(m.queries())]


@pytest.mark.parametrize(("module", "name"), CASES, ids=[name for _, name in CASES])
def test_rows(spark, module, name):
    got = module.queries()[name](spark, "")
    columns = sorted(got.columns)
    mine = sorted((tuple(norm(r[c]) for c in columns) for r in got.collect()), key=repr)
    twin = duckdb.sql(module.SQL[name])
    assert sorted(twin.columns) == columns
    assert mine == sorted((tuple(norm(v) for v in r) for r in twin.select(", ".join(f'"{c}"' for c in columns)).fetchall()), key=repr)
