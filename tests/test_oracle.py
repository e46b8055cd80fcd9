"""Every registered query against its SQL twin on the smallest tables."""

import math

import duckdb
import pytest

from checks import ORACLES, QUERIES
from tests.conftest import SMALL, TABLES


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return str(value)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES.split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", ORACLES)
def test_query(spark, duck, name):
    result = QUERIES[name](spark, SMALL)
    columns = sorted(result.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in result.collect())
    twin = duck.execute(ORACLES[name])
    names = [d[0] for d in twin.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in twin.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_twin(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0
