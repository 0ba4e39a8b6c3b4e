"""Every query runs on the smallest tables; those with SQL give its rows."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from gleanstone.plans import registry


FEW = {"ver08", "ver12"}  # the smallest tables have no such point or summary; planted ones are in test_report.py


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.8g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if sql := registry.SQL.get(name):
        rel = duck.sql(sql)
        assert sorted(rel.columns) == cols
        at = [rel.columns.index(c) for c in cols]
        assert got == Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    else:
        assert got or name in FEW
