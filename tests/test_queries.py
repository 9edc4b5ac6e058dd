"""Every registered query of the engine against its SQL twin in DuckDB."""

import duckdb
import pytest

from jobs import queries as jobs
from latentfield.plans import oracle, queries, tree_oracle, tree_queries

SQL = oracle.SQL | tree_oracle.SQL | jobs.SQL
QUERIES = queries.QUERIES | tree_queries.QUERIES | jobs.QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents benchmark conversations pages".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(float(r[i])) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else repr(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    got = canonical([tuple(r) for r in df.collect()], df.columns)
    con.execute(SQL[name])
    columns = [d[0] for d in con.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == canonical(con.fetchall(), columns)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
