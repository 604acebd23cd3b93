"""Every query against its SQL form, on the smallest tables."""

import math
import os

import duckdb
import pytest

from quillon.plans import suite

SF = os.environ.get("QUILLON_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


@pytest.mark.parametrize("name", sorted(suite.QUERIES))
def test_query(spark, duck, name):
    df = suite.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in suite.ORACLES:
        assert rows
        return
    found = duck.execute(suite.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert rows == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
