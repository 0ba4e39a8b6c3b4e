"""Cross-validation and learning curve have all their repeats and sizes."""

from gleanstone.plans import registry


def test_twenty_repeats(spark, sf):
    rows = registry.QUERIES["ml02"](spark, sf).collect()
    assert sorted(r["repeat"] for r in rows) == list(range(20)) and len({r["rho"] for r in rows}) > 10


def test_learning_curve_reaches_the_whole_pool(spark, sf):
    from gleanstone.plans.models import people

    size = people(spark, sf).where("id % 5 <> 0 AND target IS NOT NULL").count()
    rows = registry.QUERIES["ml10"](spark, sf).collect()
    assert sorted((r["n_train"], r["repeat"]) for r in rows) == [(n, r) for n in (25, 50, 100) for r in range(5)] + [(size, 0)]
    assert len({r["rho"] for r in rows}) > 5
