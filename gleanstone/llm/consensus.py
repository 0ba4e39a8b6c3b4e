"""Consensus of several raters' labels by a mean-field variational confusion model."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from gleanstone.session import cut


def digamma(x: str) -> str:
    """SQL of the digamma function for x > 0: six steps up, then the asymptotic series."""
    up = f"({x} + 6)"
    series = f"ln({up}) - 0.5D / {up} - 1D / (12 * {up} * {up}) + 1D / (120 * power({up}, 4)) - 1D / (252 * power({up}, 6))"
    return f"({series} - " + " - ".join(f"1D / ({x} + {i})" for i in range(6)) + ")"


def digammas(x: np.ndarray) -> np.ndarray:
    """The digamma function of numbers > 0, by the same series."""
    up = x + 6
    return np.log(up) - 0.5 / up - 1 / (12 * up**2) + 1 / (120 * up**4) - 1 / (252 * up**6) - sum(1 / (x + i) for i in range(6))


@dataclass
class Consensus:
    posterior: DataFrame  # item, q: probability of each class
    confusion: DataFrame  # rater, truth, row: expected counts of the given labels, prior included
    rounds: int  # that were taken
    converged: bool  # whether the last round still moved less than the tolerance


SMALL_MODEL = 8_000_000  # bytes of a model that is sent to every task; a larger one is joined
Likeliest = Callable[[np.ndarray, np.ndarray], np.ndarray]  # cells of all votes and the places where items begin -> the items' posteriors


def _votes(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells of all votes of a batch of items, each item's number of votes and its first one's place."""
    column = b.column("cells")
    n = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), n, np.cumsum(n) - n


def _shares(classes: int) -> Likeliest:
    """Starting posteriors: the shares of an item's votes."""
    return lambda at, first: (x := np.add.reduceat(np.eye(classes)[at % classes], first)) / x.sum(1, keepdims=True)


def _by_rates(rates: np.ndarray, share: np.ndarray) -> Likeliest:
    """Posteriors from each cell's expected log rates by true class and the classes' expected log shares."""

    def likeliest(at: np.ndarray, first: np.ndarray) -> np.ndarray:
        x = np.add.reduceat(rates[at], first) + share
        x = np.exp(x - x.max(1, keepdims=True))
        return x / x.sum(1, keepdims=True)

    return likeliest


def _counting(cells: int, classes: int, likeliest: Likeliest):
    """Expected votes by cell and true class, summed over a partition's items."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen = np.zeros((cells, classes)), np.zeros(cells, bool)
        for b in batches:
            if b.num_rows:
                at, n, first = _votes(b)
                q = np.repeat(likeliest(at, first), n, axis=0)
                there, place = np.unique(at, return_inverse=True)
                seen[there] = True
                for k in range(classes):
                    sums[there, k] += np.bincount(place, q[:, k])
        there = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), *(pa.array(sums[there, k]) for k in range(classes))], ["cell", *(f"n{k}" for k in range(classes))])

    return scan


def _posteriors(classes: int, likeliest: Likeliest):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, _, first = _votes(b)
                yield pa.RecordBatch.from_arrays([b.column("item"), _rows(likeliest(at, first), classes)], ["item", "q"])

    return scan


def _rows(x: np.ndarray, width: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * width, pa.int32()), pa.array(x.ravel()))


def _moved(now: list[float], old: list[float]) -> float:
    return max((abs(x - y) / (y + 1) for x, y in zip(now, old)), default=0.0)


def _fit_sent(votes: DataFrame, classes: int, rounds: int, tolerance: float) -> Consensus:
    """fit() with a model that the driver holds in arrays and sends to every task.

    ``votes`` (item, rater, label, a, w). A vote's cell is its rater's number times ``classes`` plus
    its label. Each round is one scan of the items and one group-by of the tasks' sums, with the
    same short plan every time, so that the driver doesn't fill up with plans and code.
    """
    spark = votes.sparkSession
    people = votes.select("rater", "a", "w").distinct().toArrow().sort_by("rater")
    raters = people.num_rows
    ids = spark.createDataFrame(people.select(["rater"]).append_column("id", pa.array(np.arange(raters), pa.int64())))
    items = cut(votes.join(F.broadcast(ids), "rater").groupBy("item").agg(F.sort_array(F.collect_list(F.col("id") * classes + F.col("label"))).alias("cells")))
    a, w = (people.column(c).to_numpy().reshape(-1, 1, 1) for c in ("a", "w"))
    prior = w * np.where(np.eye(classes, dtype=bool), a, (1 - a) / max(1, classes - 1))  # rater, label, true class
    kinds = ", ".join(["cell bigint", *(f"n{k} double" for k in range(classes))])

    def counted(likeliest: Likeliest) -> tuple[np.ndarray, list[float]]:
        """The expected counts; the classes' totals and the sum of the counts' squares."""
        parts = items.mapInArrow(_counting(raters * classes, classes, likeliest), kinds)
        got = parts.groupBy("cell").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(classes)]).toArrow()
        n = np.zeros((raters * classes, classes))
        n[got.column("cell").to_numpy()] = np.column_stack([got.column(f"n{k}").to_numpy() for k in range(classes)])
        return n.reshape(prior.shape), [*n.sum(0).tolist(), float((n * n).sum())]

    def by(n: np.ndarray, totals: list[float]) -> Likeliest:
        rates = digammas(prior + n) - digammas(w + n.sum(1, keepdims=True))
        return _by_rates(rates.reshape(-1, classes), digammas(np.array(totals) + 1))  # class shares count votes, so that items with more votes weigh more; their prior is flat

    n, sums = counted(_shares(classes))
    done, converged = 0, False
    while done < rounds and not converged:
        old = sums
        n, sums = counted(by(n, sums[:-1]))
        done += 1
        converged = _moved(sums, old) < tolerance
    rows = (prior + n).transpose(0, 2, 1).reshape(-1, classes)
    confusion = pa.table([people.column("rater").take(pa.array(np.repeat(np.arange(raters), classes))), pa.array(np.tile(np.arange(classes, dtype=np.int32), raters)), _rows(rows, classes)], ["rater", "truth", "row"])
    posterior = items.mapInArrow(_posteriors(classes, by(n, sums[:-1])), f"item {dict(votes.dtypes)['item']}, q array<double>")
    return Consensus(posterior, spark.createDataFrame(confusion), done, converged)


def fit(votes: DataFrame, classes: int, known: DataFrame | None = None, strength: float = 4.0, rounds: int = 40, tolerance: float = 1e-4, small: int = SMALL_MODEL) -> Consensus:
    """Variational posteriors of item classes and rater confusion rows.

    ``votes`` (item, rater, label): label is a class number from 0; null items, raters or labels
    are left out, and a rater's repeated vote on an item must have been resolved before. Each
    confusion row has a Dirichlet prior of weight ``strength`` that puts a rater's prior accuracy
    on the true class and spreads the rest; ``known`` (rater, accuracy, weight) gives raters a
    prior accuracy of its own weight (say from another task), 0.6 is taken for others.
    The class shares have a flat Dirichlet prior. Ties in the posterior are resolved by the
    smallest class number. An empty table gives empty results.

    Every round sums labels' expected log rates by item, where the votes lie by item already, and
    the item posteriors by rater and label. Only the model (for each rater the counts by label and
    true class) is kept; posteriors are derived from it again. It ends when the counts' squares and
    totals move by less than ``tolerance``, or after ``rounds``; the result tells which. A model
    of up to ``small`` bytes goes by way of the driver to every task (_fit_sent). A larger one is
    cut and joined in two group-bys a round, and the driver gets only the classes' totals.
    """
    ks = range(classes)
    votes = votes.select("item", "rater", F.col("label").cast("int").alias("label")).dropna()
    if known is not None:
        votes = votes.join(known.select("rater", "accuracy", "weight"), "rater", "left")
        votes = votes.select("item", "rater", "label", F.coalesce("accuracy", F.lit(0.6)).alias("a"), F.coalesce("weight", F.lit(strength)).alias("w"))
    else:
        votes = votes.select("item", "rater", "label", F.lit(0.6).alias("a"), F.lit(strength).alias("w"))
    votes = cut(votes.repartition("item"))
    if votes.select("rater").distinct().count() * classes * classes * 8 <= small:
        return _fit_sent(votes, classes, rounds, tolerance)

    # expressions are written as SQL: a round has hundreds of them, each of which would be a call from Python otherwise
    prior = f"(w * CASE WHEN {{}} = {{}} THEN a ELSE (1 - a) / {max(1, classes - 1)} END)"

    def model(posterior: DataFrame) -> DataFrame:
        """rater, a, w, n: for each label the expected number of votes by true class; t: their sums."""
        n = votes.join(posterior, "item").groupBy("rater", "label", "a", "w").agg(*[F.expr(f"sum(get(q, {k})) AS n{k}") for k in ks])
        x = n.groupBy("rater", "a", "w").agg(F.expr(f"collect_list(struct(label, array({', '.join(f'n{k}' for k in ks)}) AS n)) AS x"))
        t = ", ".join(f"aggregate(x, 0D, (s, y) -> s + get(y.n, {k}))" for k in ks)
        return x.selectExpr("rater", "a", "w", "map_from_arrays(x.label, x.n) AS n", f"array({t}) AS t")

    def kept(m: DataFrame) -> tuple[DataFrame, list[float]]:
        """The model, cut; the classes' totals and the sum of the counts' squares, observed on the way."""
        seen = Observation()
        square = "sum(aggregate(flatten(map_values(n)), 0D, (s, x) -> s + x * x)) AS square"
        m = cut(m.observe(seen, *map(F.expr, [*(f"sum(get(t, {k})) AS t{k}" for k in ks), square])))
        got = seen.get
        return m, [got[x] or 0.0 for x in [*(f"t{k}" for k in ks), "square"]]

    def posterior(m: DataFrame, totals: list[float]) -> DataFrame:
        e = f"transform_values(n, (label, row) -> transform(row, (n, k) -> {digamma('(' + prior.format('label', 'k') + ' + n)')} - get(d, k)))"
        # class shares count votes, so that items with more votes weigh more; their prior is flat. The totals
        # stand in the rows, so that the code made for a round serves the next one too
        share = f"transform(CASE WHEN w > 0 THEN array({', '.join(f'{x!r}D' for x in totals)}) ELSE t END, t -> {digamma('(t + 1)')})"
        rates = m.selectExpr("*", f"transform(t, t -> {digamma('(w + t)')}) AS d").selectExpr("rater", f"{e} AS e", f"{share} AS s")
        x = votes.join(rates, "rater").selectExpr("item", "try_element_at(e, label) AS e", "s")
        sums = x.groupBy("item").agg(*[F.expr(f"sum(get(e, {k})) + first(get(s, {k})) AS l{k}") for k in ks])
        q = sums.selectExpr("item", f"array({', '.join(f'l{k}' for k in ks)}) AS l").selectExpr("item", "transform(l, x -> exp(x - array_max(l))) AS w")
        return q.selectExpr("item", "transform(w, x -> x / aggregate(w, 0D, (a, b) -> a + b)) AS q")

    shares = votes.groupBy("item").agg(F.expr(f"array({', '.join(f'avg(CAST(label = {k} AS DOUBLE))' for k in ks)}) AS q"))
    now, sums = kept(model(shares))
    done, converged = 0, False
    while done < rounds and not converged:
        old = sums
        now, sums = kept(model(posterior(now, sums[:-1])))
        done += 1
        converged = _moved(sums, old) < tolerance
    rows = now.selectExpr("rater", "a", "w", f"explode(sequence(0, {classes - 1})) AS truth", "n")
    row = F.expr(f"transform(sequence(0, {classes - 1}), j -> coalesce(get(try_element_at(n, j), truth), 0D) + {prior.format('j', 'truth')})")
    return Consensus(posterior(now, sums[:-1]), rows.select("rater", "truth", row.alias("row")), done, converged)


def reliability(c: Consensus, z: float = 1.96) -> DataFrame:
    """rater, accuracy, low, high, votes: posterior accuracy over the rater's own mix of true classes.

    The interval is the normal one of the Dirichlet rows' posterior variance, cut to [0, 1].
    """
    total = F.aggregate("row", F.lit(0.0), lambda s, x: s + x)
    right = F.get("row", F.col("truth")) / F.col("total")
    rows = c.confusion.withColumn("total", total).withColumn("p", right)
    r = rows.groupBy("rater").agg(
        (F.sum(F.col("p") * F.col("total")) / F.sum("total")).alias("accuracy"),
        F.sqrt(F.sum(F.col("total") ** 2 * F.col("p") * (1 - F.col("p")) / (F.col("total") + 1)) / F.sum("total") ** 2).alias("sd"),
        F.sum("total").alias("votes"),
    )
    return r.select("rater", "accuracy", F.greatest(F.lit(0.0), F.col("accuracy") - z * F.col("sd")).alias("low"), F.least(F.lit(1.0), F.col("accuracy") + z * F.col("sd")).alias("high"), "votes")


def carried(c: Consensus, classes: int, to: int, strength: float = 30.0, least: float = 4.0) -> DataFrame:
    """rater, accuracy, weight: prior for another task of ``to`` classes.

    A rater who knows the answer in a share s of the cases and guesses in the others is right in
    s + (1 - s) / to of them. Who mostly guesses, or answers against the truth, gets a weak prior,
    so that the other task's own votes decide what that rater's answers mean there.
    """
    knows = F.greatest(F.lit(0.0), (F.col("accuracy") - 1 / classes) / (1 - 1 / classes))
    return reliability(c).select("rater", (knows + (1 - knows) / to).alias("accuracy"), (least + (strength - least) * knows).alias("weight"))


def labels(c: Consensus) -> DataFrame:
    """item, label, sure: the likeliest class of each item and its probability."""
    best = F.array_max("q")
    return c.posterior.select("item", (F.array_position("q", best) - 1).cast("int").alias("label"), best.alias("sure"))


def krippendorff(votes: DataFrame) -> DataFrame:
    """alpha, items, votes: nominal agreement over items with two votes or more.

    ``votes`` (item, label); nulls are left out. One label throughout gives alpha 1;
    no item with two votes gives null.
    """
    per = votes.select("item", "label").dropna().groupBy("item", "label").agg(F.count("*").alias("n"))
    size = per.groupBy("item").agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same")).where("m > 1")
    observed = size.agg(F.sum((F.col("m") * (F.col("m") - 1) - F.col("same")) / (F.col("m") - 1)).alias("d"), F.sum("m").alias("total"), F.count("*").alias("items"))
    margin = per.join(size.select("item"), "item", "left_semi").groupBy("label").agg(F.sum("n").alias("n")).agg(F.sum(F.col("n") * F.col("n")).cast("double").alias("sq"))
    t = F.col("total").cast("double")
    expected = (t * t - F.col("sq")) / (t - 1)
    one = observed.withColumn("one", F.lit(1)).join(margin.withColumn("one", F.lit(1)), "one")
    return one.select(F.when(t.isNull(), None).when(expected == 0, 1.0).otherwise(1 - F.col("d") / expected).alias("alpha"), "items", F.coalesce("total", F.lit(0)).alias("votes"))


def truth_answer(c: Column) -> Column:
    """0 for a clear yes, 1 for a clear no, else null."""
    word = F.lower(F.regexp_replace(c, r"[\s ​\.!]+", ""))
    return F.when(word.isin("true", "t", "1", "yes", "y"), 0).when(word.isin("false", "f", "0", "no", "n"), 1)


def plain_label(c: Column) -> Column:
    """The label's letters: without additions in brackets or behind a dash, semicolon or tilde, case, marks and blanks."""
    x = F.lower(F.regexp_replace(c, r"[​ ﻿]", " "))
    x = F.regexp_replace(x, r"[(\[].*$|;.*$|\s[-–—~]\s?.*$|~.*$", "")
    return F.regexp_replace(x, r"[\s_\-.,!?:'\"]+", "")


def spelled(c: Column, forms: list[tuple[str, int]], share: float = 0.25, most: int = 2) -> Column:
    """The class that a label evidently spells, or null.

    ``forms``: spellings without blanks and their classes. The nearest form counts if it is at
    most ``most`` edits and ``share`` of its length away and no other class is as near.
    """
    table = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(k).alias("k")) for f, k in forms])
    near = F.transform(table, lambda s: F.struct(F.levenshtein(c, s["f"]).alias("d"), s["k"].alias("k"), F.length(s["f"]).alias("n")))
    good = F.filter(near, lambda s: (s["d"] <= most) & (s["d"] <= s["n"] * share))
    best = F.array_min(F.transform(good, lambda s: s["d"]))
    hits = F.array_distinct(F.transform(F.filter(good, lambda s: s["d"] == best), lambda s: s["k"]))
    return F.when(F.size(hits) == 1, F.get(hits, F.lit(0)))


def spelled_once(df: DataFrame, column: str, forms: list[tuple[str, int]], out: str) -> DataFrame:
    """``df`` with ``out``, the class that its text column evidently spells; each different spelling is looked up once."""
    df = df.withColumn("plain " + column, plain_label(F.col(column)))
    known = df.select(F.col("plain " + column).alias("p")).where("p is not null").distinct().withColumn(out, spelled(F.col("p"), forms))  # a filter on it would be pushed in front of the distinct
    return df.join(known, df["plain " + column] == known["p"], "left").drop("p", "plain " + column)
