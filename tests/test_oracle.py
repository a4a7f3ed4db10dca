"""Every registered query that has SQL, against DuckDB on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from tessera.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return v


def rows(found):
    return sorted((tuple(plain(x) for x in r) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == cols
    assert rows(got.select(cols).collect()) == rows(want.select(*(f'"{c}"' for c in cols)).fetchall())


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - catalog.ORACLES.keys()))
def test_query_without_sql_runs(spark, name):
    if name != "gbdt_predictions":
        assert catalog.QUERIES[name](spark, SF).count() > 0
