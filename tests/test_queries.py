"""Every registered query against its SQL in DuckDB, on the smallest driver tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from sparloom.plans.queries import ORACLE_SQL, QUERIES, TABLES

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


def same(spark_rows, spark_columns, duck_rows, duck_columns):
    assert sorted(spark_columns) == sorted(duck_columns)

    def bag(rows, columns):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        return sorted([plain(r[i]) for i in order] for r in rows)

    assert bag(spark_rows, spark_columns) == bag(duck_rows, duck_columns)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", list(QUERIES))
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    r = duck.sql(ORACLE_SQL[name])
    same([tuple(x) for x in got.collect()], got.columns, r.fetchall(), r.columns)


def test_entry_points(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
    if os.path.isdir(SF):
        assert entry.entry(spark).columns == ["k", "idx", "part"]
