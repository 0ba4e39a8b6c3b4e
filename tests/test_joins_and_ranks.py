import random

from gleanstone.operators.interval_join import overlap_join
from gleanstone.operators.ranking import average_rank, global_row_number, quantile_bins


def test_overlap_join_against_brute_force(spark):
    rng = random.Random(3)
    mk = lambda n: [(i, rng.choice("kkkkm"), float(a := rng.randint(0, 500)), float(a + rng.choice([0, 1, 5, 80]))) for i in range(n)]
    a, b = mk(80), mk(120)
    da = spark.createDataFrame([*a, (98, None, 0.0, 1.0), (99, "k", None, 1.0)], "i int, key string, a_start double, a_end double")
    db = spark.createDataFrame([*b, (98, None, 0.0, 1.0)], "j int, key string, b_start double, b_end double")
    want = sorted((i, j) for i, k, s, e in a for j, m, x, y in b if k == m and x <= e + 1 and y >= s - 1)
    got = sorted((r["i"], r["j"]) for r in overlap_join(da, db, ["key"], 1.0, 10.0).collect())
    assert got == want
    assert sorted(r["i"] for r in overlap_join(da, db, ["key"], 1.0, 10.0, "left_semi").select("i").distinct().collect()) == sorted({i for i, _ in want})


def test_ranks(spark):
    v = [5.0, 1.0, 3.0, 3.0, None, 8.0, 3.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, v double")
    assert {r["i"]: r["r"] for r in average_rank(df, "v", "r").collect()} == {0: 5.0, 1: 1.0, 2: 3.0, 3: 3.0, 4: None, 5: 6.0, 6: 3.0}
    rows = global_row_number(spark.range(1000).selectExpr("id", "(id * 7919) % 1000 AS x"), ["x"], "n").collect()
    assert all(r["n"] == r["x"] + 1 for r in rows)
    bins = [r["b"] for r in quantile_bins(spark.range(23), ["id"], 5, "b").orderBy("id").collect()]
    assert bins == sorted(bins) and [bins.count(k) for k in range(5)] == [5, 4, 5, 4, 5]
    assert global_row_number(spark.range(0), ["id"], "n").count() == 0
