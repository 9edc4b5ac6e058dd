"""Each query of these operators that SQL can express, against DuckDB over the same tables."""

import duckdb
import pytest

from latentfield.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", [n for n in ORACLE_SQL if n != "op3_source_mixing"])
def test_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, sf)
    assert set(columns) <= set(got.columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())
