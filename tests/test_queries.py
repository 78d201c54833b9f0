"""Every registered query of the library against DuckDB on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from cohortspark.plans.fixtures import BASES
from cohortspark.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in BASES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = [tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall()]
    got = [tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()]
    assert sorted(df.columns) == sorted(names)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
