"""Statistics by group: rank correlation, bootstrap, agreement, differences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanstone.functions.draws import LANES, draws
from gleanstone.operators.ranking import group_ranks
from gleanstone.session import cut


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, n, rho: Spearman's rank correlation over rows with both values; null where a side is constant."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = group_ranks(group_ranks(d, keys, x, "_rx"), keys, y, "_ry")
    return r.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("_rx", "_ry").alias("rho"))


class _Ranks:
    """Distances of weighted ranks from their mean, for a column whose order is found once."""

    def __init__(self, values: np.ndarray):
        each, self.group = np.unique(values, return_inverse=True)
        self.tied = len(each) < len(values)
        self.order = np.argsort(self.group, kind="stable").astype(np.int32)
        self.begin = np.searchsorted(self.group[self.order], np.arange(len(each)))

    def distances(self, w: np.ndarray) -> np.ndarray:
        """A row for each row of ``w``: the rank distances of all values; ties share ranks."""
        t = np.take(w, self.order, 1)
        if self.tied:
            t = np.add.reduceat(t, self.begin, 1)
        t = t.astype(np.float64)
        up = np.cumsum(t, 1)
        up -= up[:, -1:] / 2 + t / 2
        return np.take(up, self.group, 1)


def _rhos(group: str, id: str, columns: list[str], resamples: int):
    def run(t: pa.Table) -> pa.Table:
        read = lambda c: t.column(c).to_numpy(zero_copy_only=False)
        name, part, parts = (t.column(c)[0].as_py() for c in (group, "_part", "_parts"))
        values, n = [read(c) for c in columns], t.num_rows
        slots = np.lexsort((*values, read(id)))  # where the draws' numbers are
        whole = ~np.any([t.column(c).is_null().to_numpy()[slots] for c in columns], 0)
        *sides, last = (_Ranks(v[slots][whole]) for v in values)
        first, end = part * resamples // parts, (part + 1) * resamples // parts
        out: list[list[float | None]] = [[] for _ in sides]
        size = max(1, LANES // n)
        for digits in sorted({len(str(b)) for b in range(first, end)}):
            some = [f"{b}:{name}" for b in range(first, end) if len(str(b)) == digits]
            for a in range(0, len(some), size):
                heads = some[a : a + size]
                picks = (draws(heads, n) % np.uint32(n)).astype(np.int64)
                picks += n * np.arange(len(heads))[:, None]
                w = np.bincount(picks.ravel(), minlength=n * len(heads)).reshape(len(heads), n)[:, whole]
                if not whole.any():
                    continue
                y = last.distances(w)
                wy = w * y
                yy = (wy * y).sum(1)
                for rho, side in zip(out, sides):
                    x = side.distances(w)
                    xx, xy = (w * x * x).sum(1), (wy * x).sum(1)
                    rho += [float(p / (np.sqrt(q) * np.sqrt(r))) if q > 0 and r > 0 else None for p, q, r in zip(xy, xx, yy)]
        return pa.table({group: pa.array([name] * len(out[0]), pa.string())} | {c: pa.array(r, pa.float64()) for c, r in zip(columns, out)})

    return run


def bootstrap_rho(p: DataFrame, group: str, id: str, columns: list[str], resamples: int) -> DataFrame:
    """group and the columns but the last: their rank correlation with the last one in every resample of the group.

    A group is drawn from with replacement, as often as it has rows, by hashes of resample, group and slot; rows
    with a null count as drawn and are then left out; null where a side is constant. Draws are made, counted and ranked where
    their resample is, so that nothing but the rows is moved: once for each part of a group's resamples. A
    group has as many parts as its share of the rows asks for; a task holds the columns of one group.
    """
    p = cut(p.where(F.col(group).isNotNull()).select(group, id, *[F.col(c).cast("double").alias(c) for c in columns]))
    tasks = 4 * p.sparkSession.sparkContext.defaultParallelism
    n = p.groupBy(group).agg(F.count("*").alias("_n"))
    share = F.ceil(tasks * F.col("_n") / F.lit(p.count()))
    parts = n.select(group, F.least(F.lit(resamples), F.greatest(F.lit(1), share)).cast("int").alias("_parts"))
    i = p.join(F.broadcast(parts), group).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    i = i.repartition(8 * tasks, group, "_part")  # mostly a part to a partition
    schema = ", ".join([f"{group} string", *[f"{c} double" for c in columns[:-1]]])
    return i.groupBy(group, "_part").applyInArrow(_rhos(group, id, columns, resamples), schema)


def cohen(df: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """keys, n, agree, kappa: Cohen's kappa of two label columns; null where chance agreement is 1."""
    keys = keys or []
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cell = d.groupBy(*keys, a, b).agg(F.count("*").alias("_n"))
    sides = [F.sum("_n").over(Window.partitionBy(*keys, c)) if keys else F.sum("_n").over(Window.partitionBy(c)) for c in (a, b)]
    cell = cell.withColumn("_ra", sides[0]).withColumn("_rb", sides[1])
    same = F.col(a) == F.col(b)
    out = cell.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sum(F.when(same, F.col("_n")).otherwise(0)).alias("_o"))
    # chance agreement: every label's two margins multiplied
    long = d.select(*keys, F.inline(F.array(F.struct(F.col(a).alias("_l"), F.lit(1).alias("_a"), F.lit(0).alias("_b")), F.struct(F.col(b).alias("_l"), F.lit(0).alias("_a"), F.lit(1).alias("_b")))))
    margin = long.groupBy(*keys, "_l").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b")).groupBy(*keys).agg(F.sum(F.col("_a").cast("double") * F.col("_b")).alias("_e"))
    j = out.join(margin, keys) if keys else out.withColumn("_1", F.lit(1)).join(margin.withColumn("_1", F.lit(1)), "_1").drop("_1")
    po, pe = F.col("_o") / F.col("n"), F.col("_e") / (F.col("n") * F.col("n"))
    return j.select(*keys, "n", po.alias("agree"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def quadratic_kappa(df: DataFrame, a: str, b: str, keys: list[str], low: int, high: int) -> DataFrame:
    """keys, n, qwk: kappa with quadratic weights over the labels low .. high, from moments alone."""
    d = df.where(F.col(a).between(low, high) & F.col(b).between(low, high))
    s = d.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col(a) - F.col(b)) ** 2).alias("_d"), F.avg(a).alias("_ma"), F.avg(b).alias("_mb"), F.var_pop(a).alias("_va"), F.var_pop(b).alias("_vb"))
    expected = F.col("_va") + F.col("_vb") + (F.col("_ma") - F.col("_mb")) ** 2
    return s.select(*keys, "n", F.when(expected > 0, 1 - F.col("_d") / expected).alias("qwk"))


def smd(value: Column, group: Column) -> Column:
    """Standardised mean difference of group true against false, over the deviation of all rows (aggregate)."""
    return F.try_divide(F.avg(F.when(group, value)) - F.avg(F.when(~group, value)), F.stddev_samp(F.when(group.isNotNull(), value)))


def icc2(df: DataFrame, subject: str, rater: str, value: str) -> DataFrame:
    """One row: icc of single random raters (two-way) over subjects rated by all raters, once each."""
    d = df.groupBy(subject, rater).agg(F.avg(value).alias("v"))
    k = d.select(rater).distinct().count()
    full = d.withColumn("_k", F.count("*").over(Window.partitionBy(subject))).where(F.col("_k") == k)
    s = full.groupBy(subject).agg(F.sum("v").alias("t"), F.sum(F.col("v") ** 2).alias("q"))
    one = s.agg(F.count("*").alias("n"), F.sum("t").alias("g"), F.sum("q").alias("q"), F.sum(F.col("t") ** 2).alias("tt"))
    r = full.groupBy(rater).agg(F.sum("v").alias("c")).agg(F.sum(F.col("c") ** 2).alias("cc"))
    x = one.withColumn("_1", F.lit(1)).join(r.withColumn("_1", F.lit(1)), "_1")
    n, mean = F.col("n"), F.col("g") ** 2 / (F.col("n") * k)
    msr = (F.col("tt") / k - mean) / (n - 1)
    msc = (F.col("cc") / n - mean) / (k - 1) if k > 1 else F.lit(None).cast("double")
    mse = (F.col("q") - F.col("tt") / k - F.col("cc") / n + mean) / ((n - 1) * (k - 1)) if k > 1 else F.lit(None).cast("double")
    return x.select("n", F.lit(k).alias("raters"), F.try_divide(msr - mse, msr + (k - 1) * mse + k * (msc - mse) / n).alias("icc"))


def verdict(low: Column, high: Column) -> Column:
    """What an interval of a difference shows."""
    return F.when(low > 0, "yes").when(high < 0, "no (worse)").otherwise("not shown")
