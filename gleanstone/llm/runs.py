"""Runs of consecutive equal events in ordered sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanstone.session import range_ordered


def spelled_state(c: Column, states: tuple[str, ...], most: int = 2) -> Column:
    """The state that a label evidently spells, or null.

    Case, blanks and marks don't count and a zero reads as o; of the states at most ``most``
    edits and a third of their length away the only nearest one counts.
    """
    word = F.regexp_replace(F.translate(F.lower(c), "01", "ol"), r"[^\p{L}\p{Nd}]", "")
    plain = [s.replace("_", "") for s in states]
    far = [F.levenshtein(word, F.lit(p)) for p in plain]
    near = F.least(*far)
    out = F.lit(None).cast("string")
    for s, p, d in zip(states, plain, far):
        alone = sum(F.when(x == near, 1).otherwise(0) for x in far) == 1
        out = F.when((d == near) & alone & (d <= min(most, len(p) // 3)), s).otherwise(out)
    return out


def with_states(df: DataFrame, label: str, states: tuple[str, ...], out: str) -> DataFrame:
    """``df`` with ``out``, the state that its label evidently spells or null; each different label is looked up once."""
    known = df.select(F.col(label).alias("spelling")).where("spelling is not null").distinct().withColumn("state spelled", spelled_state(F.col("spelling"), states))
    joined = df.join(known, df[label] == known["spelling"], "left").drop("spelling")
    return joined.withColumn(out, F.col("state spelled")).drop("state spelled")


def collapse_runs(df: DataFrame, key: str, state: str, start: str, end: str, event_id: str, tolerance: int) -> DataFrame:
    """Runs of neighbouring rows of one state, each collapsed into one row.

    Rows are ordered in each key by start, end and id. A row belongs to the run before it if it
    has the same state and starts at most ``tolerance`` after the latest end in that run. Returns
    ``key``, ``state``, ``first_id``, ``last_id``, ``n``, ``start``, ``end`` (latest); runs of one
    row too. ``start`` and ``end`` are whole numbers; an end that is missing or lies before the
    start is taken as the start. Rows without key, start or id are left out; rows with the same
    key, times and id count once; a row without state ends the run before it and is in none;
    an empty table gives an empty result; other columns are ignored, whatever their names.

    One range sort by key, start, end and id spreads a hot key over many partitions. In each
    partition every row is compared with its predecessor by lag, changes are flagged, and the
    running sum of flags numbers the runs. For what is open at a partition's beginning, a carried
    row stands in front of it: partitions are summed up in one row each, combined from left to
    right, and the carried rows go through the same windows.
    """
    rows = df.select(
        F.col(key).alias("k"), F.col(state).cast("string").alias("s"), F.col(start).cast("bigint").alias("b"),
        F.greatest(F.coalesce(F.col(end).cast("bigint"), F.col(start).cast("bigint")), F.col(start).cast("bigint")).alias("e"), F.col(event_id).alias("i"),
    ).dropna(subset=["k", "b", "i"])
    rows = range_ordered(rows, "k", "b", "e", "i").withColumn("p", F.spark_partition_id())
    order = ["b", "e", "i"]

    def numbered(x: DataFrame) -> DataFrame:
        w = Window.partitionBy("p", "k").orderBy("carried", *order)
        x = x.withColumn("copy", F.lag("i").over(w).eqNullSafe(F.col("i")) & (F.lag("b").over(w) == F.col("b")) & (F.lag("e").over(w) == F.col("e")))
        x = x.where("not coalesce(copy, false)")
        x = x.withColumn("seg", F.sum(F.when(F.lag("s").over(w) == F.col("s"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        inner = Window.partitionBy("p", "k", "seg").orderBy("carried", *order)
        # after a break every later end lies behind all earlier ones, so the segment's largest end is the run's
        x = x.withColumn("reach", F.max("e").over(inner.rowsBetween(Window.unboundedPreceding, -1)))
        x = x.withColumn("opens", F.col("reach").isNull() | (F.col("b") > F.col("reach") + tolerance))
        x = x.withColumn("run", F.sum(F.col("opens").cast("int")).over(inner.rowsBetween(Window.unboundedPreceding, 0)))
        # the run's last row: the next one opens a run or there is none
        return x.withColumn("closes", F.coalesce(F.lead("opens").over(inner), F.lit(True)))

    local = numbered(rows.withColumn("carried", F.lit(1)))
    # one row for each partition: its first and last key, and the last key's last segment
    ends = local.groupBy("p").agg(F.min("k").alias("first_key"), F.max("k").alias("last_key"), F.max(F.struct("k", "seg")).alias("last"))
    tail = local.groupBy("p", "k", "seg").agg(
        F.first("s").alias("s"), F.max(F.when(F.col("opens"), F.struct("b", "e", "i"))).alias("open"), F.max("e").alias("top"))
    ends = ends.join(tail.select("p", F.struct("k", "seg").alias("last"), "s", "open", "top"), ["p", "last"])
    carry, now = [], None
    for r in sorted(ends.collect(), key=lambda r: r["p"]):  # one row for each partition
        if now and now["k"] == r["first_key"] and now["s"] is not None:
            carry.append((r["p"], now["k"], now["s"], now["top"], *now["open"]))
        alone = now and r["first_key"] == r["last_key"] == now["k"] and r["last"]["seg"] == 1 and r["s"] == now["s"]
        first = tuple(r["open"])
        if alone:
            now = now | {"open": first if first[0] > now["top"] + tolerance else now["open"], "top": max(now["top"], r["top"])}
        else:
            now = {"k": r["last_key"], "s": r["s"], "open": first, "top": r["top"]}
    kinds = dict(rows.dtypes)
    carried = rows.sparkSession.createDataFrame(carry, f"p int, k {kinds['k']}, s string, top bigint, ob bigint, oe bigint, oi {kinds['i']}")
    front = carried.select("k", "s", F.col("ob").alias("b"), F.col("top").alias("e"), F.col("oi").alias("i"), "p", F.lit(0).alias("carried"), F.struct(F.col("ob").alias("b"), F.col("oe").alias("e"), F.col("oi").alias("i")).alias("from"))
    both = rows.withColumn("carried", F.lit(1)).withColumn("from", F.lit(None).cast(front.schema["from"].dataType)).unionByName(front)
    # single rows of a run are picked by flags, not compared as structs, so that it is hashed and not sorted again
    own = F.col("carried") == 1
    one = lambda flag, x: F.max(F.when(flag, F.col(x)))
    pieces = numbered(both).where("s is not null").groupBy("p", "k", "seg", "run", "s").agg(
        *[one(~own, f"from.{x}").alias(f"f{x}") for x in "bei"], *[one(own & F.col("opens"), x).alias(f"o{x}") for x in "bei"], *[one(own & F.col("closes"), x).alias(f"h{x}") for x in "bei"],
        F.sum("carried").alias("n"), F.max("e").alias("top"))
    # the pieces of a run over several partitions share the row that opened it
    pieces = pieces.where("n > 0").select("k", "s", *[F.when(F.col("fb").isNotNull(), F.col(f"f{x}")).otherwise(F.col(f"o{x}")).alias(f"o{x}") for x in "bei"], F.struct("hb", "he", "hi").alias("hi"), "n", "top")
    whole = pieces.groupBy("k", "s", "ob", "oe", "oi").agg(F.max("hi").alias("hi"), F.sum("n").alias("n"), F.max("top").alias("top"))
    return whole.select(F.col("k").alias(key), F.col("s").alias(state), F.col("oi").alias("first_id"), F.col("hi.hi").alias("last_id"), "n", F.col("ob").alias("start"), F.col("top").alias("end"))
