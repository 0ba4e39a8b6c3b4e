"""Intervals from state series: run-length encoding, suppression, blinks, gap merging, episodes, shares.

All functions take and give DataFrames with a key column. A null key is a key of its own; nulls in
time or state leave a row out; repeated rows and ties in time change nothing but the order among
equals; an empty table gives an empty result. The ordered scans spread a key that holds a third of
all rows over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanstone.operators.run_scan import closed_runs


def rle(df: DataFrame, key: str = "key", t: str = "t", state: str = "state") -> DataFrame:
    """State frames to intervals that tile the time: key, state, start, end, dur.

    An interval ends where the next state begins; the last one at the last frame.
    """
    return closed_runs(df, [key], state, t, t, tile=True)


def _rejoin(df: DataFrame, key: str, state: str) -> DataFrame:
    """Merge neighbours of one state in intervals that tile the time."""
    return closed_runs(df, [key], state, "start", "end")


def suppress_short(df: DataFrame, least: float, key: str = "key", state: str = "state") -> DataFrame:
    """Intervals shorter than ``least`` go to the one before them; a short first one stays.

    What is kept is encoded again; the key's last run then ends where all its intervals end.
    """
    whole = df.groupBy(key).agg(F.min("start").alias("_first"), F.max("end").alias("_last")).withColumnRenamed(key, "_k")
    marked = df.join(whole, F.col(key).eqNullSafe(F.col("_k")))
    kept = marked.where((F.col("start") == F.col("_first")) | (F.col("dur") >= least)).select(key, state, "start", "_last")
    runs = closed_runs(kept, [key], state, "start", "start", tile=True)
    # a key's last run ends at its last start so far; the end of all its intervals takes that place
    last = kept.groupBy(key).agg(F.max("start").alias("_start"), F.first("_last").alias("_end")).withColumnRenamed(key, "_k")
    runs = runs.join(last, F.col(key).eqNullSafe(F.col("_k")))
    end = F.when(F.col("end") == F.col("_start"), F.col("_end")).otherwise(F.col("end"))
    # only the last run ends at a start that opens no other run
    nxt = runs.select(F.col(key).alias("_nk"), F.col("start").alias("_ns")).distinct()
    tail = runs.join(nxt, F.col(key).eqNullSafe(F.col("_nk")) & (F.col("end") == F.col("_ns")) & (F.col("start") < F.col("end")), "left")
    runs = tail.withColumn("end", F.when(F.col("_ns").isNull(), end).otherwise(F.col("end")))
    return runs.select(key, state, "start", "end", (F.col("end") - F.col("start")).alias("dur"))


def relabel_short(df: DataFrame, short: str, to: str, least: float, key: str = "key", state: str = "state") -> DataFrame:
    """Intervals of state ``short`` under ``least`` become ``to``; then neighbours merge."""
    return _rejoin(df.withColumn(state, F.when((F.col(state) == short) & (F.col("dur") < least), to).otherwise(F.col(state))), key, state)


def resolve_blinks(df: DataFrame, blink: str, default: str, away: str, longest: float, key: str = "key", state: str = "state") -> DataFrame:
    """Short runs of ``blink`` take the state before them (at the head the one behind, else ``default``); long ones are ``away``.

    Run-length encoded intervals tile the time, so the run before a blink is the one that ends at
    its start and the run behind it the one that starts at its end: equality joins find them.
    """
    runs = rle(df, key=key, state=state)
    before = runs.where(F.col(state) != blink).select(F.col(key).alias("_bk"), F.col("end").alias("_be"), F.col(state).alias("_before"))
    behind = runs.where(F.col(state) != blink).select(F.col(key).alias("_ak"), F.col("start").alias("_as"), F.col(state).alias("_behind"))
    is_blink = F.col(state) == blink
    runs = runs.join(before, F.col(key).eqNullSafe(F.col("_bk")) & (F.col("start") == F.col("_be")) & is_blink, "left")
    runs = runs.join(behind, F.col(key).eqNullSafe(F.col("_ak")) & (F.col("end") == F.col("_as")) & is_blink, "left")
    new = F.when(is_blink & (F.col("dur") >= longest), away).when(is_blink, F.coalesce("_before", "_behind", F.lit(default))).otherwise(F.col(state))
    return _rejoin(runs.select(key, new.alias(state), "start", "end"), key, state)


def merge_gaps(df: DataFrame, gap: float, key: list[str] | str = "key", state: str = "state") -> DataFrame:
    """Neighbours in start order of one state whose gap to the latest end is at most ``gap`` become one.

    A different state in between keeps them apart.
    """
    return closed_runs(df, [key] if isinstance(key, str) else key, state, "start", "end", gap)


def episodes(df: DataFrame, least: float, gap: float, key: list[str] | str = "key", state: str = "state") -> DataFrame:
    """Merge over small gaps, drop what is shorter than ``least``, merge again over gaps up to ``least``."""
    first = merge_gaps(df, gap, key, state).where(F.col("dur") >= least)
    return merge_gaps(first, least, key, state)


def shares(df: DataFrame, keys: list[str], state: str, dur: str = "dur") -> DataFrame:
    """Share of time by state; a group without any time has share 0."""
    per = df.groupBy(*keys, state).agg(F.sum(dur).alias("sec"))
    total = F.sum("sec").over(Window.partitionBy(*keys))
    return per.withColumn("share", F.when(total == 0, 0.0).otherwise(F.col("sec") / total))
