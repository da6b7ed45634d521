"""Every registered query of the lead domain against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from leadmill.plans import registry
from leadmill.sources.domain import BASE

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return f"{float(v):.6f}" if isinstance(v, int | float) and not isinstance(v, bool) else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for b in BASE:
        c.execute(f"create view {b} as select * from '{SF}/{b}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    found = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in df.columns) for r in found.fetchall())
    assert sorted(tuple(map(plain, r)) for r in df.collect()) == theirs


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
