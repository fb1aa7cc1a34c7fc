"""Every sequence query against its SQL in DuckDB."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from helixframe.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def _plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, (str, datetime.datetime)):
        return x
    return round(float(x), 9) if isinstance(x, (int, float, decimal.Decimal)) else str(x)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert _rows(got.columns, got.collect()) == _rows(names, want.fetchall())


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLES)
