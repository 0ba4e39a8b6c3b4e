import random

import pytest

from gleanstone.llm.nearest import nearest_in_time


@pytest.mark.parametrize("seed", range(4))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    left = [(i, rng.choice(["hot", "hot", "k1", None]), rng.choice([rng.randint(-50, 2000), None])) for i in range(150)]
    right = [(1000 - i, rng.choice(["hot", "hot", "k1", "k2", None]), rng.choice([rng.randint(-50, 2000), None])) for i in range(400)]
    left, right = left + left[:20], right + right[:30]
    want = {}
    for i, k, t in left:
        c = [(abs(t - u), j) for j, m, u in right if k is not None and t is not None and m == k and u is not None and abs(t - u) <= 32]
        if c:
            want[i] = min(c)
    a = spark.createDataFrame(left, "l int, key string, t bigint")
    b = spark.createDataFrame(right, "r int, key string, t bigint").selectExpr("r", "key", "t", "1 AS _b", "'x' AS l")
    got = nearest_in_time(a, b, ["key"], "l", "r", "t", "t", 32, 4).collect()
    assert {r["l"]: (r["distance"], r["r"]) for r in got} == want and len(got) == len(want)


def test_edges(spark):
    a = spark.createDataFrame([(1, "k", 0), (2, "k", 100)], "l int, key string, t bigint")
    b = spark.createDataFrame([(7, "k", 8), (3, "k", -8), (5, "k", 108)], "r int, key string, t bigint")
    got = {r["l"]: r["r"] for r in nearest_in_time(a, b, ["key"], "l", "r", "t", "t", 8, 1).collect()}
    assert got == {1: 3, 2: 5}  # equally near: the smallest id; the tolerance itself counts
    empty = spark.createDataFrame([], "r int, key string, t bigint")
    assert nearest_in_time(a, empty, ["key"], "l", "r", "t", "t", 8, 1).count() == 0
    assert nearest_in_time(a.limit(0), b, ["key"], "l", "r", "t", "t", 8, 1).count() == 0
