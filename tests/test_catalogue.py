"""Every registered query runs on the smallest tables; those with oracle SQL equal DuckDB's answer."""

import math

import duckdb
import pytest

from inkfold.plans import registry
from inkfold.plans.views import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return str(value)
    return round(float(value), 6) + 0.0


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    rows = got.collect()
    assert rows
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return
    want = duck.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    order = sorted(columns)
    as_key = lambda r: tuple(str(v) for v in r)
    mine = sorted((tuple(plain(r[c]) for c in order) for r in rows), key=as_key)
    theirs = sorted((tuple(plain(v) for _, v in sorted(zip(columns, r, strict=True))) for r in want.fetchall()), key=as_key)
    assert mine == theirs
