"""Joins on overlapping intervals, always inside an equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float, cell: float, how: str = "inner") -> DataFrame:
    """Rows of ``a`` (keys, a_start, a_end) with the rows of ``b`` (keys, b_start, b_end) they overlap.

    Both ends count, each interval of ``a`` widened by ``tolerance``. Both sides are cut into
    cells of ``cell`` on the time axis and joined on keys and cell, so that a hot key is spread
    over time; a pair that shares several cells is kept only in the first of them. Nulls in keys
    or times pair with nothing; ``how`` is inner or left_semi.
    """
    def cells(df: DataFrame, lo: Column, hi: Column) -> DataFrame:
        return df.withColumn("_lo", lo).withColumn("_hi", hi).where("_hi >= _lo").withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_lo") / cell), F.floor(F.col("_hi") / cell))))

    left = cells(a, F.col("a_start") - tolerance, F.col("a_end") + tolerance).withColumnsRenamed({"_lo": "_al", "_hi": "_ah"})
    right = cells(b, F.col("b_start"), F.col("b_end")).withColumnsRenamed({"_lo": "_bl", "_hi": "_bh"})
    for k in keys:
        right = right.withColumnRenamed(k, f"_b_{k}")
    right = right.withColumnRenamed("_cell", "_bcell")
    on = [F.col(k) == F.col(f"_b_{k}") for k in keys] + [F.col("_cell") == F.col("_bcell"), F.col("_bl") <= F.col("_ah"), F.col("_bh") >= F.col("_al")]
    first = F.col("_cell") == F.floor(F.greatest("_al", "_bl") / cell)
    joined = left.join(right, [*on, first], how)
    return joined.drop("_al", "_ah", "_bl", "_bh", "_cell", "_bcell", *[f"_b_{k}" for k in keys])
