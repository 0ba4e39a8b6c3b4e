"""Ridge regression from Gram matrices: imputation, standardisation, folds, leave-one-out, scoring."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanstone.functions.draws import draw
from gleanstone.session import cut

ALPHAS = [10 ** (-2 + 6 * i / 24) for i in range(25)]


@dataclass
class Prepared:
    rows: DataFrame  # id, x (standardised features), y
    features: list[str]
    median: np.ndarray
    mean: np.ndarray
    sd: np.ndarray


@dataclass
class Ridge:
    features: list[str]
    median: np.ndarray
    mean: np.ndarray
    sd: np.ndarray
    coef: np.ndarray
    intercept: float
    alpha: float

    def to_json(self) -> str:
        return json.dumps({k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in vars(self).items()})

    @classmethod
    def from_json(cls, text: str) -> Ridge:
        got = json.loads(text)
        return cls(**{k: np.array(v) if k in ("median", "mean", "sd", "coef") else v for k, v in got.items()})

    def z(self) -> list[Column]:
        """Standardised features of a row; missing ones take the median."""
        return [(F.coalesce(F.col(f).cast("double"), F.lit(float(m))) - float(u)) / float(s) for f, m, u, s in zip(self.features, self.median, self.mean, self.sd)]

    def predict(self, refuse_missing: bool = False) -> Column:
        """Prediction; with ``refuse_missing`` null where any feature is missing."""
        p = F.lit(self.intercept)
        for c, z in zip(self.coef, self.z()):
            p = p + float(c) * z
        if refuse_missing:
            whole = F.lit(True)
            for f in self.features:
                whole = whole & F.col(f).isNotNull()
            return F.when(whole, p)
        return p

    def contributions(self) -> Column:
        """Map of feature to coefficient times z score."""
        return F.create_map(*[x for f, c, z in zip(self.features, self.coef, self.z()) for x in (F.lit(f), float(c) * z)])


def prepare(df: DataFrame, id_col: str, features: list[str], target: str) -> Prepared:
    """Median-imputed, standardised (population) rows with a target; constant features have deviation 1.

    Rows without target are left out; a feature without any value counts as 0.
    """
    d = df.where(F.col(target).isNotNull())
    med = d.agg(*[F.median(F.col(f).cast("double")).alias(f"m{i}") for i, f in enumerate(features)]).first()
    median = np.array([med[f"m{i}"] if med[f"m{i}"] is not None else 0.0 for i in range(len(features))])
    full = d.select(F.col(id_col).alias("id"), *[F.coalesce(F.col(f).cast("double"), F.lit(float(m))).alias(f"f{i}") for i, (f, m) in enumerate(zip(features, median))], F.col(target).cast("double").alias("y"))
    full = cut(full)
    st = full.agg(*[g(f"f{i}").alias(f"{n}{i}") for i in range(len(features)) for n, g in (("u", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([st[f"u{i}"] or 0.0 for i in range(len(features))])
    sd = np.array([st[f"s{i}"] or 1.0 for i in range(len(features))])
    x = F.array(*[(F.col(f"f{i}") - float(u)) / float(s) for i, (u, s) in enumerate(zip(mean, sd))])
    return Prepared(full.select("id", x.alias("x"), "y"), features, median, mean, sd)


def grams(rows: DataFrame, k: int, by: str | None = None) -> dict:
    """Per value of ``by``: the matrix of sums of products of (1, x, y); k + 2 squared numbers each."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict = {}
        for pdf in frames:
            if len(pdf):
                a = np.column_stack([np.ones(len(pdf)), np.stack(pdf["x"].to_numpy()), pdf["y"].to_numpy()])
                for g, ix in pdf.groupby("g").indices.items():
                    total[g] = total.get(g, 0) + a[ix].T @ a[ix]
        for g, m in total.items():
            yield pd.DataFrame({"g": [int(g)], "m": [m.ravel()]})

    got = rows.select("x", "y", (F.col(by) if by else F.lit(0)).cast("int").alias("g")).mapInPandas(scan, "g int, m array<double>")
    # one small matrix for each partition and fold
    sums = got.select("g", F.posexplode("m").alias("i", "v")).groupBy("g", "i").agg(F.sum("v").alias("v")).collect()
    out: dict = {}
    for r in sums:
        out.setdefault(r["g"], np.zeros((k + 2) ** 2))[r["i"]] = r["v"]
    return {g: m.reshape(k + 2, k + 2) for g, m in out.items()}


def solve(m: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Coefficients and intercept from a Gram matrix of (1, x, y), the intercept unpenalised."""
    n = m[0, 0]
    mx, my = m[0, 1:-1] / n, m[0, -1] / n
    xx = m[1:-1, 1:-1] - n * np.outer(mx, mx)
    xy = m[1:-1, -1] - n * mx * my
    b = np.linalg.solve(xx + alpha * np.eye(len(xx)), xy)
    return b, float(my - mx @ b)


def loo_alpha(p: Prepared, m: np.ndarray, alphas: list[float] = ALPHAS) -> float:
    """The penalty of least squared leave-one-out error, from leverages; one pass for all penalties."""
    n = m[0, 0]
    mx, my = m[0, 1:-1] / n, m[0, -1] / n
    lam, q = np.linalg.eigh(m[1:-1, 1:-1] - n * np.outer(mx, mx))
    lam = np.maximum(lam, 0)
    xy = q.T @ (m[1:-1, -1] - n * mx * my)

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(alphas))
        for pdf in frames:
            if len(pdf):
                z = (np.stack(pdf["x"].to_numpy()) - mx) @ q
                y = pdf["y"].to_numpy() - my
                for i, a in enumerate(alphas):
                    h = (z * z / (lam + a)).sum(1) + 1 / n
                    total[i] += (((y - z @ (xy / (lam + a))) / (1 - h)) ** 2).sum()
        yield pd.DataFrame({"e": [total]})

    errors = p.rows.select("x", "y").mapInPandas(scan, "e array<double>").select(F.posexplode("e").alias("i", "e")).groupBy("i").agg(F.sum("e").alias("e")).collect()
    return alphas[min(errors, key=lambda r: (r["e"], r["i"]))["i"]]


def fit(df: DataFrame, id_col: str, features: list[str], target: str, alpha: float | None = None, least: int = 5) -> Ridge | None:
    """Ridge regression on all rows with a target; ``alpha`` None takes the leave-one-out choice; None under ``least`` rows."""
    p = prepare(df, id_col, features, target)
    m = grams(p.rows, len(features)).get(0)
    if m is None or m[0, 0] < least:
        return None
    a = loo_alpha(p, m) if alpha is None else alpha
    coef, intercept = solve(m, a)
    return Ridge(features, p.median, p.mean, p.sd, coef, intercept, a)


def out_of_fold(df: DataFrame, id_col: str, features: list[str], target: str, folds: int = 5, repeats: int = 1, alpha: float = 1.0) -> DataFrame:
    """id, repeat, y, pred: predictions for rows left out of the fit, folds by a hash of the id.

    One pass sums the Gram matrix of every fold; a fold's model comes from the others' sum.
    """
    p = prepare(df, id_col, features, target)
    k, out = len(features), None
    for r in range(repeats):
        rows = p.rows.withColumn("fold", (draw(r, F.col("id")) % folds).cast("int"))
        per = grams(rows, k, "fold")
        total = sum(per.values())
        pred = F.lit(None).cast("double")
        for f, m in per.items():
            rest = total - m
            if rest[0, 0] >= 2:
                coef, intercept = solve(rest, alpha)
                value = F.aggregate(F.zip_with("x", F.array(*[F.lit(float(c)) for c in coef]), lambda a, b: a * b), F.lit(intercept), lambda a, b: a + b)
                pred = F.when(F.col("fold") == f, value).otherwise(pred)
        one = rows.select("id", F.lit(r).alias("repeat"), "y", pred.alias("pred"))
        out = one if out is None else out.unionByName(one)
    return out
