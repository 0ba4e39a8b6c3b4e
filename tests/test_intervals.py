import random

import pytest

from gleanstone.operators.intervals import periods_and_gaps

SCHEMA = "k string, v string, b bigint, e bigint"


def brute(rows, longest=None):
    out, by = set(), {}
    for k, v, b, e in rows:
        if None not in (k, v, b, e) and e >= b:
            by.setdefault((k, v), []).append((b, e))
    for (k, v), spans in by.items():
        merged = []
        for b, e in sorted(spans):
            if merged and b <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([b, e])
        out |= {(k, v, "period", b, e) for b, e in merged}
        out |= {(k, v, "gap", x[1], y[0]) for x, y in zip(merged, merged[1:]) if longest is None or y[0] - x[1] <= longest}
    return out


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in periods_and_gaps(df, ["k", "v"], "b", "e", **kw).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("seed", range(6))
def test_against_brute_force_with_a_hot_entity(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(400):
        hot = rng.random() < 0.6
        b = rng.randint(0, 3000)
        rows.append(("hot" if hot else f"k{rng.randint(0, 5)}", rng.choice("ab") if not hot else "a", b, b + rng.choice([-5, 0, 1, 3, 10, 10, 60 if rng.random() < 0.1 else 4, 900 if rng.random() < 0.05 else 2])))
    rows += rng.sample(rows, 40)
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, longest_gap=7) == brute(rows, 7)


def test_one_interval_spans_every_partition(spark):
    rows = [("k", "v", 0, 10_000)] + [("k", "v", i, i + 1) for i in range(5, 900, 3)] + [("k", "v", 20_000, 20_001)]
    assert run(spark, rows) == {("k", "v", "period", 0, 10_000), ("k", "v", "gap", 10_000, 20_000), ("k", "v", "period", 20_000, 20_001)}


def test_nulls_empty_touching_and_reversed(spark):
    rows = [(None, "v", 0, 1), ("k", None, 0, 1), ("k", "v", None, 1), ("k", "v", 0, None), ("k", "v", 9, 3), ("k", "v", 0, 5), ("k", "v", 5, 7), ("k", "v", 8, 8)]
    assert run(spark, rows) == {("k", "v", "period", 0, 7), ("k", "v", "period", 8, 8), ("k", "v", "gap", 7, 8)}
    assert run(spark, []) == set()


def test_other_columns_may_clash(spark):
    df = spark.createDataFrame([("k", "v", 0, 5, "x", 1)], "k string, v string, b bigint, e bigint, kind string, _pid int")
    assert [tuple(r) for r in periods_and_gaps(df, ["k", "v"], "b", "e").collect()] == [("k", "v", "period", 0, 5)]
