"""Bootstrap queries take 2000 resamples: the rows of their SQL."""

import hashlib
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

from gleanstone.functions import draws
from gleanstone.operators.statistics import bootstrap_rho
from gleanstone.plans import registry


@pytest.mark.parametrize("name", ["st02", "st03", "st11", "ver17"])
def test_two_thousand_resamples(spark, sf, name):
    sf = sf.replace("sf0.001", "sf0.01") if name == "ver17" else sf  # the smaller tables have under three clips of both approaches
    sql = registry.SQL[name]
    assert sql.count("range(2000)") == 1
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = registry.QUERIES[name](spark, sf)
    want = c.sql(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()
    near = lambda r: tuple(pytest.approx(v, rel=1e-7, abs=2e-9) if isinstance(v, float) else v for v in r)
    got = sorted(tuple(r) for r in df.collect())
    assert got and None not in got[0] and got == [near(r) for r in sorted(want)]


def _draw(head, k):
    return int(hashlib.md5(f"{head}:{k}".encode()).hexdigest()[:8], 16) % (1 << 31)


@pytest.mark.parametrize("lanes", [64, 1 << 16])
@pytest.mark.parametrize("heads, n", [(["0:A"], 1), (["0:A", "7:B"], 1234), (["100:é", "101:é", "999:é"], 111), (["5:" + "x" * 45, "6:" + "x" * 45], 12000), (["5:" + "x" * 200, "6:" + "y" * 200], 120)])
def test_draws_are_md5(monkeypatch, lanes, heads, n):
    monkeypatch.setattr(draws, "LANES", lanes)
    assert draws.draws(heads, n).tolist() == [[_draw(h, k) for k in range(n)] for h in heads]


def test_bootstrap_rho_by_hand(spark):
    """Ties, nulls, one row alone and a constant side, against ranks of the rows drawn."""
    r = np.random.default_rng(3)
    rows = [(g, i, float(r.integers(9)), float(r.integers(30)), float(r.normal())) for g, n in (("a", 40), ("b", 7)) for i in range(n)]
    rows += [("a", 100, None, 3.0, 1.0), ("a", 101, 2.0, None, 1.0), ("a", 102, 2.0, 4.0, None), ("one", 1, 1.0, 1.0, 1.0), ("flat", 1, 1.0, 5.0, 1.0), ("flat", 2, 1.0, 6.0, 2.0), (None, 1, 1.0, 1.0, 1.0)]
    schema = "seg string, id bigint, x double, z double, y double"
    got = bootstrap_rho(spark.createDataFrame(rows, schema).repartition(3), "seg", "id", ["x", "z", "y"], 30).toPandas()
    assert set(got["seg"]) == {"a", "b", "one", "flat"}
    for seg in ("a", "b", "one", "flat"):
        own, want = pd.DataFrame([q for q in sorted(rows, key=lambda q: q[1]) if q[0] == seg], columns=["seg", "id", "x", "z", "y"]), []
        for b in range(30):
            d = own.iloc[[_draw(f"{b}:{seg}", k) % len(own) for k in range(len(own))]].dropna()
            with np.errstate(all="ignore"):
                want.append(tuple(d[c].rank().corr(d["y"].rank()) for c in "xz"))
        near = lambda v: sorted((tuple(np.nan_to_num(q, nan=9.0).round(9)) for q in v))
        assert near(got.loc[got["seg"] == seg, ["x", "z"]].to_numpy()) == near(np.array(want))
    assert bootstrap_rho(spark.createDataFrame([], schema), "seg", "id", ["x", "z", "y"], 30).count() == 0


@pytest.mark.parametrize("name", ["st02", "st03"])
def test_draws_are_not_moved(spark, sf, name):
    """2000 resamples of some thousand rows: only the rows themselves go through shuffles."""
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()
    bus, before = spark.sparkContext._jsc.sc().listenerBus(), written()
    assert registry.QUERIES[name](spark, sf.replace("sf0.001", "sf0.01")).count() == 5
    bus.waitUntilEmpty(30_000)
    assert written() - before < 2_000_000  # 8.2 MB when they were
