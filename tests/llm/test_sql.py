"""Queries of the corpus operators against their SQL."""

import duckdb
import pytest

from quarry.llm import queries


def rows_of(relation, columns):
    return sorted(relation.select(", ".join(columns)).fetchall(), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_is_its_sql(spark, small, name):
    got = queries.queries()[name](spark, small)
    columns = sorted(got.columns)
    with duckdb.connect() as duck:
        for table in ("documents", "embeddings"):
            duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
        twin = duck.sql(queries.oracle_sql()[name])
        assert sorted(twin.columns) == columns
        theirs = rows_of(twin, columns)
    mine = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    assert len(mine) == len(theirs)
    for a, b in zip(mine, theirs, strict=True):
        assert a == pytest.approx(b, rel=1e-12) if any(isinstance(v, float) for v in a) else a == b


@pytest.mark.parametrize("n", [0, 1, 2, 3, 41])
def test_shards_of_few_rows_are_their_sql(spark, n):
    docs = spark.createDataFrame([(i * 3 if i else None, "é" * i if i % 2 else None) for i in range(n)], "doc_id long, text string")
    from quarry.llm import sharding

    mine = sorted((tuple(r) for r in sharding.shard(docs).drop("row_number").collect()), key=repr)
    with duckdb.connect() as duck:
        duck.register("documents", docs.toArrow())
        assert sorted(duck.sql(queries.OP6_SQL).fetchall(), key=repr) == mine
