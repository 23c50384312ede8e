"""Every query runs, and equals its SQL where it has one, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def sql(data):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(data):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if "llm" not in entry.queries()[n].__module__))
def test_query(spark, data, sql, name):
    df = entry.queries()[name](spark, data)
    columns = sorted(df.columns)
    got = sorted((norm(tuple(r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    if name not in entry.oracle_sql():
        return
    relation = sql.sql(entry.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    want = sorted((norm(tuple(r)) for r in relation.project(", ".join(f'"{c}"' for c in columns)).fetchall()), key=repr)
    assert got == want


def test_entry(spark, data):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["time", "url", "response_code", "count", "avg_size", "version"]


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
