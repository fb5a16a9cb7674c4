"""Every query runs on the smallest tables; those with SQL agree with it."""

import math
import os

import duckdb
import pytest

import __spark_entry__

NAMES = sorted(__spark_entry__.queries())


def _norm(v):
    if v is None:
        return "~"
    if isinstance(v, dict):
        return str(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    if isinstance(v, float):
        return "~" if math.isnan(v) else f"{v:.6g}"
    return str(v)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for file in os.listdir(small):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{small}/{file}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, small, duck, name):
    df = __spark_entry__.queries()[name](spark, small)
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        return
    found = duck.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted("|".join(_norm(r[i]) for i in order) for r in found.fetchall())
    assert sorted("|".join(_norm(x) for x in r) for r in rows) == want


def test_entry(spark, small):
    assert __spark_entry__.entry(spark).columns == ["query_id", "record_id", "score", "retrieval_lanes", "rel_path", "place"]


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(NAMES)
