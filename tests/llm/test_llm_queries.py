"""Every query of the subpackage runs on the smallest tables; those with SQL give its rows."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from gleanstone.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = Counter(tuple(r[c] for c in cols) for r in df.collect())
    assert got
    if name.endswith("_found"):
        assert max(got.values()) == 1
    if sql := queries.SQL.get(name):
        c = duckdb.connect()
        for p in Path(sf).glob("*.parquet"):
            c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        rel = c.sql(sql)
        at = [rel.columns.index(x) for x in cols]
        assert got == Counter(tuple(r[i] for i in at) for r in rel.fetchall())
