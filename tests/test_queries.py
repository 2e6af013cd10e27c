"""Every registered query of the table operators against its SQL in DuckDB, or, without SQL, for rows."""

import math
import os

import duckdb
import pytest

from gridloom.plans import registry


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in os.listdir(data):
        con.execute(f"create view {name.split('.')[0]} as select * from '{data}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_equals_sql(spark, data, duck, name):
    found = registry.QUERIES[name](spark, data)
    columns = sorted(found.columns)
    mine = sorted(repr([plain(v) for v in r]) for r in found.select(*columns).collect())
    cursor = duck.execute(registry.ORACLE[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    theirs = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in cursor.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_has_rows(spark, data, name):
    assert registry.QUERIES[name](spark, data).count() > 0
