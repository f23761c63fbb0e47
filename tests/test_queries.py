"""Every query with SQL, on the smallest tables, against DuckDB."""

import collections
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        path = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, db, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = collections.Counter(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name in SQL:
        found = db.execute(SQL[name])
        names = [x[0] for x in found.description]
        assert sorted(names) == columns
        assert rows == collections.Counter(repr([plain(dict(zip(names, r))[c]) for c in columns]) for r in found.fetchall())
    else:
        assert sum(rows.values()) > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() > 0
