import math
import random
from collections import Counter

from pyspark.sql import functions as F

from gleanstone.llm import consensus as C


def test_good_raters_outvote_many_bad_ones(spark):
    rng = random.Random(1)
    skill = {f"r{i}": 0.92 for i in range(4)} | {f"s{i}": 0.15 for i in range(5)}
    truth = {i: rng.randrange(5) for i in range(300)}
    votes = [(str(i), r, t if rng.random() < skill[r] else rng.randrange(5)) for i, t in truth.items() for r in rng.sample(list(skill), 5)]
    votes += [("x", None, 1), (None, "r0", 1), ("y", "r1", None)]
    fit = C.fit(spark.createDataFrame(votes, "item string, rater string, label int"), 5)
    got = {r["item"]: r["label"] for r in C.labels(fit).collect()}
    right = sum(got[str(i)] == t for i, t in truth.items()) / 300
    major = {}
    for i, _, label in votes[:-3]:
        major.setdefault(i, Counter())[label] += 1
    plain = sum(major[str(i)].most_common(1)[0][0] == t for i, t in truth.items()) / 300
    assert right > 0.85 and right > plain + 0.03
    rel = {r["rater"]: r for r in C.reliability(fit).collect()}
    assert all((rel[r]["accuracy"] > 0.75) == (s > 0.5) and rel[r]["low"] <= rel[r]["accuracy"] <= rel[r]["high"] for r, s in skill.items())
    prior = {r["rater"]: r for r in C.carried(fit, 5, 2).collect()}
    assert prior["r0"]["weight"] > 20 > 12 > prior["s0"]["weight"]


def test_empty_and_single(spark):
    schema = "item string, rater string, label int"
    assert C.labels(C.fit(spark.createDataFrame([], schema), 3)).count() == 0
    assert C.labels(C.fit(spark.createDataFrame([("i", "r", 2)], schema), 3)).first()["label"] == 2


def test_alpha(spark):
    df = lambda rows: C.krippendorff(spark.createDataFrame(rows, "item int, label string")).first()
    assert df([(1, "a"), (1, "a"), (2, "b"), (2, "b")])["alpha"] == 1.0
    r = df([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, "b"), (3, "b"), (4, None), (5, "a")])
    assert r["items"] == 3 and abs(r["alpha"] - (1 - 2 / ((36 - 18) / 5))) < 1e-12
    assert df([(1, "a")])["alpha"] is None


def test_digamma_and_spelling(spark):
    x = spark.createDataFrame([(0.1, -10.423754940411076), (1.0, -0.5772156649015329), (12.5, 2.4851956512749)], "x double, y double")
    assert all(abs(r["d"] - r["y"]) < 1e-6 for r in x.select(F.expr(C.digamma("x")).alias("d"), "y").collect())
    forms = [("headdown", 0), ("ก้มศีรษะ", 0), ("none", 1), ("noproblem", 1), ("headleft", 2)]
    words = {"​Head-Down (whole clip)": 0, "head dwn": 0, "ก้มศีรษะ; second half": 0, "no problm - partly": 1, "NONE.": 1, "?": None, "head": None, None: None}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r["w"]: r["k"] for r in df.select("w", C.spelled(C.plain_label(F.col("w")), forms).alias("k")).collect()} == words


def test_a_joined_model_gives_what_a_broadcast_one_gives(spark):
    rng = random.Random(3)
    votes = [(str(i), r, i % 3 if rng.random() < 0.8 else rng.randrange(3)) for i in range(60) for r in "abc"]
    df = spark.createDataFrame(votes, "item string, rater string, label int")
    fits = [C.fit(df, 3, small=n) for n in (C.SMALL_MODEL, 0)]
    assert fits[0].converged and fits[0].rounds == fits[1].rounds
    got = [{r["item"]: r["label"] for r in C.labels(f).collect()} for f in fits]
    assert got[0] == got[1] and len(got[0]) == 60
    assert not C.fit(df, 3, rounds=1, tolerance=0.0).converged


def test_every_spelling_is_looked_up_once(spark):
    forms = [("eyecontact", 0), ("nohands", 1)]
    rows = [("Eye contact",), ("EYE-CONTACT (sure)",), ("no hand",), ("other",), (None,), ("eye contakt",)]
    got = [r["k"] for r in C.spelled_once(spark.createDataFrame(rows, "label string"), "label", forms, "k").orderBy("label").collect()]
    want = [r["k"] for r in spark.createDataFrame(rows, "label string").orderBy("label").select(C.spelled(C.plain_label(F.col("label")), forms).alias("k")).collect()]
    assert got == want and got.count(None) == 2


def _plans(spark, act):
    """The plans that the driver makes during ``act``."""
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def made():
        bus.waitUntilEmpty(30_000)
        every = store.executionsList()
        return {(x := every.apply(i)).executionId(): x.physicalPlanDescription() for i in range(every.size())}

    before = made()
    act()
    return [plan for k, plan in made().items() if k not in before]


def test_rounds_of_a_small_model_plan_no_join(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(str(i), r, rng.randrange(12)) for i in range(40) for r in "abcd"], "item string, rater string, label int")
    few, many = (_plans(spark, lambda n=n: C.fit(df, 12, rounds=n, tolerance=0.0)) for n in (2, 6))
    assert len(many) == len(few) + 4  # one for each round
    assert sum("Join" in p for p in many) == sum("Join" in p for p in few)


def test_posteriors_and_confusion_are_those_of_plain_loops(spark):
    rng, classes, rounds = random.Random(5), 3, 4
    votes = [(i, r, i % 3 if rng.random() < 0.7 else rng.randrange(3)) for i in range(30) for r in rng.sample("abcde", 3)]
    known = {"a": (0.9, 20.0), "b": (0.3, 5.0)}
    own = {r: known.get(r, (0.6, 4.0)) for r in "abcde"}
    prior = lambda r, j, k: own[r][1] * (own[r][0] if j == k else (1 - own[r][0]) / 2)
    psi = lambda x: (math.lgamma(x + 1e-5) - math.lgamma(x - 1e-5)) / 2e-5
    by = {i: [(r, j) for x, r, j in votes if x == i] for i in range(30)}
    q = {i: [sum(j == k for _, j in v) / len(v) for k in range(classes)] for i, v in by.items()}
    for _ in range(rounds + 1):
        n = {(r, j, k): sum(q[i][k] for i, s, label in votes if (s, label) == (r, j)) for r in "abcde" for j in range(classes) for k in range(classes)}
        t = {(r, k): sum(n[r, j, k] for j in range(classes)) for r in "abcde" for k in range(classes)}
        for i, v in by.items():
            x = [psi(1 + sum(t[r, k] for r in "abcde")) + sum(psi(prior(r, j, k) + n[r, j, k]) - psi(own[r][1] + t[r, k]) for r, j in v) for k in range(classes)]
            q[i] = [math.exp(y - max(x)) / sum(math.exp(z - max(x)) for z in x) for y in x]
    fits = [C.fit(spark.createDataFrame(votes, "item int, rater string, label int"), classes, spark.createDataFrame([(r, *x) for r, x in known.items()], "rater string, accuracy double, weight double"), rounds=rounds, tolerance=0.0, small=s) for s in (C.SMALL_MODEL, 0)]
    for fit in fits:
        got = {r["item"]: r["q"] for r in fit.posterior.collect()}
        assert got.keys() == q.keys() and all(abs(x - y) < 1e-5 for i in q for x, y in zip(got[i], q[i]))
        rows = {(r["rater"], r["truth"]): r["row"] for r in fit.confusion.collect()}
        assert len(rows) == 15 and all(abs(rows[r, k][j] - prior(r, j, k) - x) < 1e-5 for (r, j, k), x in n.items())
