"""Every query with SQL against DuckDB on the smallest tables; the others run."""

import math
import os

import pytest

import __spark_entry__ as entry
from rolloom.plans import reference

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, list) else str(v)


def as_set(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    other = duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(other.columns)
    assert as_set(df.columns, df.collect()) == as_set(other.columns, other.fetchall())


CORE = sorted(set(reference.QUERIES) - set(entry.oracle_sql()))


@pytest.mark.parametrize("name", CORE)
def test_runs(spark, name):
    entry.queries()[name](spark, FOLDER).collect()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
