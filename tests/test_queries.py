"""Every core query against DuckDB on the same tables."""

from __future__ import annotations

import decimal
import math

import duckdb
import pytest

import __spark_entry__
from quern.functions import FAMILIES
from quern.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    return repr(float(v)) if isinstance(v, decimal.Decimal) else repr(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in SQL:
        assert rows
        return
    result = duck.execute(SQL[name])
    theirs = [d[0] for d in result.description]
    assert sorted(theirs) == columns
    assert rows == sorted(tuple(plain(r[theirs.index(c)]) for c in columns) for r in result.fetchall())


def test_pages_come_back(spark, sf):
    assert all(r.same and r.bytes < r.raw for r in QUERIES["coder_pages"](spark, sf).collect())


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["l_returnflag", "n", "q"] and df.count() > 0


def test_registered_names():
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_function_families_exist(spark):
    known = {f.name for f in spark.catalog.listFunctions()}
    assert not {n for names in FAMILIES.values() for n in names} - known
