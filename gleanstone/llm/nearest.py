"""Pairing records by nearest time: joins in expanding rings of time buckets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanstone.session import cut


def nearest_in_time(left: DataFrame, right: DataFrame, by: list[str], left_id: str, right_id: str, left_time: str, right_time: str, tolerance: int, first_ring: int) -> DataFrame:
    """For each row of ``left`` the row of ``right`` nearest in time among those equal in ``by``.

    Times are whole numbers. Returns ``left_id``, ``right_id``, ``distance``; rows of ``left``
    with nothing within ``tolerance`` don't occur; of equally near rows the smallest ``right_id``
    counts. Rows with a null in ``by``, id or time pair with nothing; repeated rows on either
    side change nothing; empty tables give an empty result; other columns are ignored, whatever
    their names.

    The right side is first reduced to the buckets of one tolerance around some left row. Then
    rings follow: with buckets of the ring's width, the rows of the left row's bucket and of the
    two beside it hold all that are less than a width away. A nearest row within the width is
    provably the nearest of all; left rows without one go on to buckets of double width, up to
    the tolerance. Buckets, not entities, are the join keys, so a hot entity is spread by time.
    """
    low = left.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col(left_id).alias("_l"), F.col(left_time).cast("bigint").alias("_lt")).dropna().distinct()
    keys = [f"_k{i}" for i in range(len(by))]
    high = right.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)], F.col(right_id).alias("_r"), F.col(right_time).cast("bigint").alias("_rt")).dropna()

    def bucket(t: str, width: int):
        return F.expr(f"floor({t} / {width}D)").cast("bigint")

    def beside(df: DataFrame, width: int) -> DataFrame:
        return df.withColumn("_b", F.explode(F.array(*[bucket("_lt", width) + d for d in (-1, 0, 1)])))

    low = cut(low)
    some = beside(low, tolerance).select(*keys, "_b").distinct()
    high = high.withColumn("_b", bucket("_rt", tolerance)).join(some, [*keys, "_b"], "left_semi").drop("_b")
    high = cut(high.groupBy(*keys, "_rt").agg(F.min("_r").alias("_r")))
    width, found = first_ring, []
    while True:
        width = min(width, tolerance)
        pairs = beside(low, width).join(high.withColumn("_b", bucket("_rt", width)), [*keys, "_b"])
        pairs = pairs.withColumn("_d", F.abs(F.col("_lt") - F.col("_rt"))).where(F.col("_d") <= width)
        best = cut(pairs.groupBy("_l").agg(F.min(F.struct("_d", "_r")).alias("_m")))
        found.append(best.select(F.col("_l").alias(left_id), F.col("_m._r").alias(right_id), F.col("_m._d").alias("distance")))
        if width >= tolerance:
            return reduce(DataFrame.unionByName, found)
        low = low.join(best, "_l", "left_anti")
        width *= 2
