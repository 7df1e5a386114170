"""The queries that SQL can express against DuckDB, on whole tables."""

import duckdb
import pytest

from lodestone.llm import queries as q


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    result = con.execute(q.SQL[name])
    columns = [d[0] for d in result.description]
    got = q.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(result.fetchall())


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in q.QUERIES) == list(range(1, 11))
