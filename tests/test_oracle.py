"""Every warehouse query against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tallyframe import queries as warehouse

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        con.sql(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(x):
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    return float(x) if isinstance(x, float) else x if x is None else str(x) if not isinstance(x, (int, bool)) else x


@pytest.mark.parametrize("name", sorted(warehouse.oracle_sql()))
def test_query(spark, duck, data, name):
    mine = warehouse.queries()[name](spark, data)
    other = duck.sql(warehouse.oracle_sql()[name])
    assert sorted(mine.columns) == sorted(other.columns)
    order = sorted(mine.columns)
    rows = sorted((tuple(plain(r[c]) for c in order) for r in mine.collect()), key=repr)
    at = [other.columns.index(c) for c in order]
    assert rows == sorted((tuple(plain(r[k]) for k in at) for r in other.fetchall()), key=repr)
