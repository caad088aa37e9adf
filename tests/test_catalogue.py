"""Each query against its SQL twin on the small tables, order left aside."""

import datetime
import decimal
import math

import duckdb
import pytest

from wavelake import catalogue

SF = "/root/testdata/sf0.001"


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = int(x) if x == int(x) else float(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return round(x, 9) if isinstance(x, float) and math.isfinite(x) else x


def rows(names, got):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([plain(r[i]) for i in at] for r in got), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in catalogue.TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_twin(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    other = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(df.columns) == sorted(other.columns)
    assert rows(df.columns, df.collect()) == rows(other.columns, other.fetchall())
