import random

import pytest
from pyspark.sql import functions as F

from gleanstone.llm.runs import collapse_runs, spelled_state

SCHEMA = "k string, s string, b bigint, e bigint, i bigint"


def brute(rows, tol):
    out, by = [], {}
    for k, s, b, e, i in {r for r in rows if None not in (r[0], r[2], r[4])}:
        by.setdefault(k, set()).add((b, max(b, e if e is not None else b), i, s))
    for k, items in by.items():
        run = None
        for b, e, i, s in sorted(items, key=lambda x: x[:3]):
            if run and s is not None and run["s"] == s and b <= run["top"] + tol:
                run["n"] += 1
                run["last"] = i
                run["top"] = max(run["top"], e)
            else:
                if run:
                    out.append(run)
                run = {"k": k, "s": s, "first": i, "last": i, "n": 1, "b": b, "top": e} if s is not None else None
        if run:
            out.append(run)
    return sorted((r["k"], r["s"], r["first"], r["last"], r["n"], r["b"], r["top"]) for r in out)


def run(spark, rows, tol=5):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(tuple(r) for r in collapse_runs(df, "k", "s", "b", "e", "i", tol).collect())


@pytest.mark.parametrize("seed", range(6))
def test_against_brute_force_with_a_hot_key(spark, seed):
    rng = random.Random(seed)
    ids = rng.sample(range(10_000), 500)
    rows = []
    for i in ids:
        b = rng.randint(0, 1500)
        rows.append(("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 4)}", rng.choice(["x", "x", "x", "y", None] if seed % 2 else ["x"]), b, rng.choice([None, b + 1, b + 3, b + 8, b - 2, b + 400 if rng.random() < 0.02 else b]), i))
    rows += rng.sample(rows, 30)
    assert run(spark, rows) == brute(rows, 5)


def test_one_run_over_all_partitions_and_edges(spark):
    rows = [("k", "x", i, i + 1, i) for i in range(0, 900, 2)]
    assert run(spark, rows) == [("k", "x", 0, 898, 450, 0, 899)]
    assert run(spark, []) == []
    assert run(spark, [(None, "x", 0, 1, 1), ("k", "x", None, 1, 2), ("k", "x", 0, 1, None), ("k", None, 0, 1, 3)]) == []


def test_spelling(spark):
    states = ("eye_contact", "looking_away", "no_face", "low_lids")
    words = {"EYE CONTACT ": "eye_contact", "eye_contcat": "eye_contact", "n0_face": "no_face", "lowlids": "low_lids", "looking_aaway": "looking_away", "banana": None, "": None, None: None}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r["w"]: r["s"] for r in df.select("w", spelled_state(F.col("w"), states).alias("s")).collect()} == words


def test_clashing_columns(spark):
    df = spark.createDataFrame([("k", "x", 0, 1, 1, 9, "z")], SCHEMA + ", p int, seg string")
    assert [tuple(r) for r in collapse_runs(df, "k", "s", "b", "e", "i", 5).collect()] == [("k", "x", 1, 1, 1, 0, 1)]


def test_every_label_is_looked_up_once(spark):
    from gleanstone.llm.runs import with_states

    rows = [(1, "EYE CONTACT ", "x"), (2, "n0_face", "x"), (3, None, "x"), (4, "banana", "x"), (5, "n0_face", None)]
    got = with_states(spark.createDataFrame(rows, "i int, event string, spelling string").drop("spelling"), "event", ("eye_contact", "no_face"), "event").orderBy("i").collect()
    assert [(r["i"], r["event"]) for r in got] == [(1, "eye_contact"), (2, "no_face"), (3, None), (4, None), (5, "no_face")]
