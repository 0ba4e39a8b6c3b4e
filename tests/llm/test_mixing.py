import random

import pytest

from gleanstone.llm import mixing as M


def test_apportionment_is_that_of_the_highest_quotients():
    rng = random.Random(1)
    for _ in range(2000):
        n = rng.randint(1, 6)
        w, cap, seats = [rng.choice([0, 0.1, 0.2, 0.25, 0.5, rng.random()]) for _ in range(n)], [rng.randint(0, 12) for _ in range(n)], rng.randint(0, 40)
        q = [0] * n
        for _ in range(seats):
            o = [(w[i] / (2 * q[i] + 1), -i) for i in range(n) if q[i] < cap[i] and w[i] > 0]
            if o:
                q[-max(o)[1]] += 1
        assert q == M.sainte_lague(w, cap, seats)


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["Big one", "big_one ", "big-one", "mid", "mid", "small"][: 6 if i % 7 == 0 else 5]), "word " * rng.randint(20, 200)) for i in range(3000)]
    rows += [(5000, "mid", None), (5001, None, "x y z"), (5002, "mid", "")]
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string")


def test_shares_caps_and_seed(spark, corpus):
    t = spark.createDataFrame([("m", "big_one", 0.3, 2, 0.5), ("m", "mid", 0.6, 2, 0.5), ("m", "small", 0.1, 3, 0.5), ("m", "small", 0.1, 3, 0.5), ("n", "small", 1.0, 2, 0.9), ("n", "none", 0.5, 2, 0.9)], "mix_id string, source string, target_share double, max_repeats int, budget_share double")
    sel, rep = M.mix(corpus, t, block_tokens=256, shard_tokens=60_000)
    r = {(x["mix_id"], x["source"]): x for x in rep.collect()}
    assert len(r) == 5
    for s, share in (("big_one", 0.3), ("mid", 0.6), ("small", 0.1)):
        assert abs(r["m", s]["actual_share"] - share) < 0.03
    assert r["n", "small"]["most_repeats"] == 2 and r["n", "small"]["drawn_tokens"] <= 2 * r["n", "small"]["available_tokens"]
    assert r["n", "none"]["drawn_tokens"] == 0
    rows = sel.collect()
    assert all(x["times"] <= {"m": {"big_one": 2, "mid": 2, "small": 3}, "n": {"small": 2}}[x["mix_id"]][x["source"]] for x in rows)
    assert not {x["doc_id"] for x in rows} & {5000, 5001, 5002}
    assert {tuple(x) for x in rows} == {tuple(x) for x in M.mix(corpus.repartition(5), t, block_tokens=256, shard_tokens=60_000)[0].collect()}


def test_empty(spark, corpus):
    t = spark.createDataFrame([("m", "mid", 1.0, 2, 0.5)], "mix_id string, source string, target_share double, max_repeats int, budget_share double")
    sel, rep = M.mix(corpus.limit(0), t)
    assert sel.count() == 0 and rep.first()["actual_share"] is None
    assert M.mix(corpus, t.limit(0))[1].count() == 0


def test_shares_under_caps():
    from gleanstone.llm.corpus_queries import capped_shares

    assert capped_shares([0.5, 0.5], [10, 1000], 100) == [10, 90]
    assert capped_shares([0.6, 0.3, 0.1], [1000, 1000, 1000], 100) == [60, 30, 10]
    assert capped_shares([0.6, 0.3, 0.1], [20, 40, 1000], 100) == [20, 40, 40]
    assert capped_shares([1, 0], [5, 9], 100) == [5, 0] and capped_shares([], [], 3) == []
