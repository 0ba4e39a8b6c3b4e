"""Positions, neighbours and ranks in an order, without moving a table or a group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanstone.session import cut, range_ordered


def global_row_number(df: DataFrame, by: list[str], name: str = "rank") -> DataFrame:
    """``df`` with the position 1, 2, ... of each row in the order of ``by`` (nulls first).

    One range sort; the counts of the partitions, one row each, give every partition its offset.
    Rows equal in ``by`` are numbered in any order; an empty table stays empty.
    """
    rows = range_ordered(df, *by).withColumn("_p", F.spark_partition_id())
    counts = rows.groupBy("_p").agg(F.count("*").alias("n")).orderBy("_p").collect()  # one row for each partition
    start, offsets = 0, []
    for r in counts:
        offsets.append((r["_p"], start))
        start += r["n"]
    base = df.sparkSession.createDataFrame(offsets, "_p int, _o bigint")
    w = Window.partitionBy("_p").orderBy(*by)
    return rows.withColumn("_r", F.row_number().over(w)).join(F.broadcast(base), "_p").withColumn(name, F.col("_r") + F.col("_o")).drop("_p", "_r", "_o")


def numbered(df: DataFrame, keys: list[str], order: list, name: str) -> DataFrame:
    """``df`` with the position 1, 2, ... of each row in its group ``keys``, in the order of ``order``.

    Positions in the whole order, less the group's first one: no group has to fit one task.
    """
    exprs = {f"_o{i}": F.expr(o) if isinstance(o, str) else o for i, o in enumerate(order)}
    rows = cut(global_row_number(df.withColumns(exprs), [*keys, *exprs], "_g").drop(*exprs))
    first = rows.groupBy(*keys).agg(F.min("_g").alias("_f")).withColumnsRenamed({k: f"_k_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return rows.join(first, on).withColumn(name, F.col("_g") - F.col("_f") + 1).drop("_g", "_f", *[f"_k_{k}" for k in keys])


def previous(df: DataFrame, keys: list[str], order: list[str], columns: dict[str, str]) -> DataFrame:
    """``df`` with ``columns`` (new name to column) of the row before in the group, null in a group's first row.

    Inside a partition of the sorted rows it is a plain lag; a partition's first rows take the
    last row of the partition before them, if that is of the same group.
    """
    rows = range_ordered(df, *keys, *order).withColumn("_p", F.spark_partition_id())
    group, at = F.struct(*keys), F.struct(*keys, *order)
    ends = rows.groupBy("_p").agg(F.min(group).alias("first"), F.max(group).alias("last"), F.max_by(F.struct(*[F.col(c).alias(n) for n, c in columns.items()]), at).alias("v")).orderBy("_p").collect()
    kinds = dict(rows.dtypes)
    carry = [(b["_p"], *a["v"]) for a, b in zip(ends, ends[1:]) if a["last"] == b["first"]]  # one row for each partition
    there = df.sparkSession.createDataFrame(carry, ", ".join(["_cp int", *(f"_c_{n} {kinds[c]}" for n, c in columns.items())]))
    w = Window.partitionBy("_p").orderBy(*keys, *order)
    same = F.lag(group).over(w).eqNullSafe(group)
    top = F.row_number().over(w) == 1
    out = rows.join(F.broadcast(there), F.col("_p") == F.col("_cp"), "left")
    return out.withColumns({n: F.when(top, F.col(f"_c_{n}")).when(same, F.lag(c).over(w)) for n, c in columns.items()}).drop("_p", "_cp", *[f"_c_{n}" for n in columns])


def group_ranks(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Ranks from 1 of ``value`` in its group, ties sharing their mean; null values have none.

    Distinct values are counted, sorted over all partitions and summed up; a group's ranks begin
    where its first value stands in the whole order.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    rows = range_ordered(counts, *keys, value).withColumn("_p", F.spark_partition_id())
    sums = rows.groupBy("_p").agg(F.sum("_n").alias("n")).orderBy("_p").collect()  # one row for each partition
    start, offsets = 0, []
    for r in sums:
        offsets.append((r["_p"], start))
        start += r["n"]
    base = df.sparkSession.createDataFrame(offsets, "_q int, _o bigint")
    w = Window.partitionBy("_p").orderBy(*keys, value).rowsBetween(Window.unboundedPreceding, 0)
    ranks = rows.withColumn("_c", F.sum("_n").over(w)).join(F.broadcast(base), F.col("_p") == F.col("_q")).select(*keys, F.col(value).alias("_v"), "_n", (F.col("_o") + F.col("_c")).alias("_c"))
    if keys:
        first = ranks.groupBy(*keys).agg(F.min(F.col("_c") - F.col("_n")).alias("_f")).withColumnsRenamed({k: f"_k_{k}" for k in keys})
        ranks = ranks.join(first, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]).drop(*[f"_k_{k}" for k in keys])
    else:
        ranks = ranks.withColumn("_f", F.lit(0))
    ranks = ranks.select(*[F.col(k).alias(f"_r_{k}") for k in keys], "_v", (F.col("_c") - F.col("_f") - (F.col("_n") - 1) / 2).alias(name))
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys] + [F.col(value) == F.col("_v")]
    return df.join(ranks, on, "left").drop("_v", *[f"_r_{k}" for k in keys])


def average_rank(df: DataFrame, by: str, name: str = "rank") -> DataFrame:
    """``group_ranks`` over the whole table."""
    return group_ranks(df, [], by, name)


def quantile_bins(df: DataFrame, by: list[str], bins: int, name: str = "bin") -> DataFrame:
    """Equal bins 0 .. bins - 1 of the global rank, closed on the right; a single row is in bin 0."""
    ranked = global_row_number(df, by, "_rank")
    n = ranked.count()
    at = F.ceil((F.col("_rank") - 1) * bins / max(1, n - 1)) - 1
    return ranked.withColumn(name, F.greatest(at, F.lit(0)).cast("int")).drop("_rank")
