from __future__ import annotations

import duckdb
import pytest

from fieldloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    columns = sorted(want.columns)
    df = QUERIES[name](spark, small)
    assert sorted(df.columns) == columns
    got = [repr(tuple(r)) for r in df.select(*columns).collect()]
    assert sorted(got) == sorted(repr(r) for r in want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
