"""Every registered query of the core library against its SQL on the same tables."""

from __future__ import annotations

import math

import pytest

from tidemark.plans import registry


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    rows = df.collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows and df.columns
        return
    found = duck.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda r: tuple(str(x) for x in r)
    a = sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=key)
    b = sorted((tuple(plain(x) for x in r) for r in found.fetchall()), key=key)
    assert a == b
