"""Every registered query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from corpusloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


def rows_of(records, columns, names):
    places = [names.index(c) for c in columns]
    return sorted(tuple(plain(r[i]) for i in places) for r in records)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = rows_of(df.collect(), columns, df.columns)
    if name in SQL:
        relation = duck.sql(SQL[name])
        assert sorted(relation.columns) == columns
        assert got == rows_of(relation.fetchall(), columns, list(relation.columns))


def test_most_queries_have_sql():
    assert len(SQL) >= 0.85 * len(QUERIES)
