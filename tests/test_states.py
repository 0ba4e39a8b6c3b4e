import random

import pytest

from gleanstone.operators import states as S


def fold_rle(frames):
    out = []
    for t, s in sorted(frames):
        if not out or out[-1][0] != s:
            if out:
                out[-1][2] = t
            out.append([s, t, t])
        else:
            out[-1][2] = t
    return [tuple(x) for x in out]


def fold_suppress(runs, least):
    out = []
    for n, (s, a, b) in enumerate(runs):
        if n and b - a < least:
            out[-1][2] = b
        elif out and out[-1][0] == s:
            out[-1][2] = b
        else:
            out.append([s, a, b])
    return [tuple(x) for x in out]


def fold_merge(segs, gap):
    out = []
    for s, a, b in sorted(segs, key=lambda x: (x[1], x[2], x[0])):
        if out and out[-1][0] == s and a - out[-1][2] <= gap:
            out[-1][2] = max(out[-1][2], b)
        else:
            out.append([s, a, b])
    return sorted(tuple(x) for x in out)


def got(df):
    return [tuple(r) for r in df.select("state", "start", "end").orderBy("start").collect()]


@pytest.mark.parametrize("seed", range(4))
def test_windows_equal_the_folds(spark, seed):
    rng = random.Random(seed)
    frames = [(float(t), rng.choice("aabc")) for t in sorted(rng.sample(range(400), 120))]
    df = spark.createDataFrame([("k", t, s) for t, s in frames], "key string, t double, state string")
    runs = fold_rle(frames)
    assert got(S.rle(df)) == runs
    assert got(S.suppress_short(S.rle(df), 5.0)) == fold_suppress(runs, 5.0)
    segs = [(s, a, a + rng.choice([1.0, 2.0, 9.0])) for s, a, _ in runs]
    df = spark.createDataFrame([("k", s, a, b) for s, a, b in segs], "key string, state string, start double, end double")
    assert sorted(got(S.merge_gaps(df, 2.0))) == fold_merge(segs, 2.0)


def test_blinks(spark):
    rows = [(0.0, "x"), (0.1, "x"), (0.3, "look"), (0.5, "x"), (0.6, "look"), (1.0, "x"), (1.9, "look"), (2.0, "x")]
    df = spark.createDataFrame([("k", t, s) for t, s in rows], "key string, t double, state string")
    # the head takes the state behind it, a long run is away, a short one takes the state before it
    assert got(S.resolve_blinks(df, "x", "d", "away", 0.4)) == [("look", 0.0, 1.0), ("away", 1.0, 1.9), ("look", 1.9, 2.0)]


def test_only_blinks_and_empty(spark):
    schema = "key string, t double, state string"
    assert got(S.resolve_blinks(spark.createDataFrame([("k", 0.0, "x"), ("k", 0.1, "x")], schema), "x", "d", "away", 0.4)) == [("d", 0.0, 0.1)]
    assert got(S.rle(spark.createDataFrame([], schema))) == []
    assert got(S.rle(spark.createDataFrame([("k", None, "a"), ("k", 1.0, None)], schema))) == []


def test_shares(spark):
    df = spark.createDataFrame([("k", "a", 3.0), ("k", "b", 1.0), ("z", "a", 0.0)], "key string, state string, dur double")
    assert {(r["key"], r["state"]): r["share"] for r in S.shares(df, ["key"], "state").collect()} == {("k", "a"): 0.75, ("k", "b"): 0.25, ("z", "a"): 0.0}


def test_many_keys_hot_and_null(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice([1, 2]), rng.choice("xxy"), float(t := rng.randint(0, 900)), float(t + rng.choice([0, 1, 4, 30]))) for _ in range(700)]
    df = spark.createDataFrame(rows, "k string, n int, state string, start double, end double").selectExpr("*", "1 AS _p", "'z' AS _key")
    want = set()
    for g in {r[:2] for r in rows}:
        want |= {(*g, *x) for x in fold_merge([r[2:] for r in rows if r[:2] == g], 2.0)}
    assert {tuple(r) for r in S.merge_gaps(df, 2.0, ["k", "n"]).select("k", "n", "state", "start", "end").collect()} == want
