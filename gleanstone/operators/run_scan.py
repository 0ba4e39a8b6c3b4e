"""One ordered scan that closes runs of equal states, with what is open carried from partition to partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanstone.session import range_ordered

Open = tuple  # (key, state, start, top): a run that is still open


class _Runs:
    """Running state over rows sorted by key, start, end and state."""

    def __init__(self, gap: float, tile: bool, open_run: Open | None = None):
        self.gap, self.tile, self.open = gap, tile, open_run
        self.last_break = self.whole = None  # start of the last break in the last segment; whether that is all there was

    def step(self, batch: pa.RecordBatch) -> tuple[list, list, np.ndarray, np.ndarray]:
        """The runs that close in ``batch``: keys, states, starts, ends."""
        n = batch.num_rows
        key, state = batch.column("_key"), batch.column("_state")
        start, end = batch.column("_start").to_numpy(zero_copy_only=False), batch.column("_end").to_numpy(zero_copy_only=False)
        new_key, new_seg = np.ones(n, bool), np.ones(n, bool)
        new_key[1:] = pc.not_equal(key.slice(1), key.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new_seg[1:] = new_key[1:] | pc.not_equal(state.slice(1), state.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        held = self.open
        new_key[0] = held is None or held[0] != key[0].as_py()
        new_seg[0] = new_key[0] or held[1] != state[0].as_py()
        # largest end so far in each segment: by ranks, so that segments can't reach into each other
        reach_in = np.concatenate([[held[3] if held and not new_seg[0] else -np.inf], end])
        by = np.argsort(reach_in, kind="stable")
        rank = np.empty(n + 1, np.int64)
        rank[by] = np.arange(n + 1)
        seg = np.concatenate([[0], np.cumsum(new_seg)])
        top = reach_in[by[np.maximum.accumulate(seg * (n + 1) + rank) - seg * (n + 1)]][1:]
        before = np.concatenate([[held[3] if held else -np.inf], top[:-1]])
        opens = new_seg if np.isinf(self.gap) else new_seg | (start - before > self.gap)
        at = np.flatnonzero(opens)
        # the end of the run before each opening: the next start where runs tile the time, else its own largest end
        closed = np.where(new_key[at] | (not self.tile), before[at], start[at])
        keys, states = pc.take(key, pa.array(at)).to_pylist(), pc.take(state, pa.array(at)).to_pylist()
        starts = start[at]
        runs = ([held[0]] if held else []) + keys, ([held[1]] if held else []) + states, np.concatenate([[held[2]], starts]) if held else starts
        segs = np.flatnonzero(new_seg)
        if len(segs):
            self.whole = self.whole is None and len(segs) == 1 and segs[0] == 0
            self.last_break = float(starts[-1])
        elif len(at):
            self.last_break = float(starts[-1])
        self.open = (runs[0][-1], runs[1][-1], float(runs[2][-1]), float(top[-1]))
        if not held:
            closed = closed[1:]
        return runs[0][:-1], runs[1][:-1], runs[2][:-1], closed

    def finish(self) -> tuple[list, list, np.ndarray, np.ndarray]:
        k, s, a, b = self.open
        return [k], [s], np.array([a]), np.array([b])


def _summary(gap: float, tile: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, first = _Runs(gap, tile), None
        for b in batches:
            if b.num_rows:
                first = first or (b.column("_p")[0].as_py(), b.column("_key")[0].as_py())
                runs.step(b)
        if first:
            k, s, _, top = runs.open
            yield pa.RecordBatch.from_pylist([{"p": first[0], "first_key": first[1], "key": k, "state": s, "begin": runs.last_break, "top": top, "whole": bool(runs.whole)}], schema=SUMMARY)

    return scan


SUMMARY = pa.schema([("p", pa.int32()), ("first_key", pa.string()), ("key", pa.string()), ("state", pa.string()), ("begin", pa.float64()), ("top", pa.float64()), ("whole", pa.bool_())])


def _closing(gap: float, tile: bool, carry: dict, goes_on: set):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, p = None, None

        def out(k: list, s: list, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(s, pa.string()), pa.array(a, pa.float64()), pa.array(b, pa.float64())], names=["_key", "_state", "start", "end"])

        for b in batches:
            if b.num_rows:
                if runs is None:
                    p = b.column("_p")[0].as_py()
                    runs = _Runs(gap, tile, carry.get(p))
                yield out(*runs.step(b))
        if runs is not None and p not in goes_on:
            yield out(*runs.finish())

    return scan


def closed_runs(df: DataFrame, keys: list[str], state: str, start: str, end: str, gap: float = float("inf"), tile: bool = False) -> DataFrame:
    """keys, state, start, end: runs of neighbouring rows of one state in the order of start, end and state.

    A row whose start lies more than ``gap`` behind the latest end of the run begins a new one.
    With ``tile`` a run ends where the key's next run starts. Rows without state, start or end are
    left out; a null key is a key of its own; ends before starts count as the starts.

    One range sort spreads a hot key over many tasks. A first scan sums up each partition: its
    first key and the run it leaves open. These rows, one for each partition, are combined from
    left to right, and a second scan closes the runs; nothing is shuffled after the sort.
    """
    rows = df.select(F.to_json(F.struct(*keys)).alias("_key"), F.col(state).cast("string").alias("_state"), F.col(start).cast("double").alias("_start"), F.greatest(F.col(start), F.col(end)).cast("double").alias("_end")).dropna()
    rows = range_ordered(rows, "_key", "_start", "_end", "_state").withColumn("_p", F.spark_partition_id())
    got = sorted(rows.mapInArrow(_summary(gap, tile), "p int, first_key string, key string, state string, begin double, top double, whole boolean").collect(), key=lambda r: r["p"])
    carry, now, goes_on = {}, None, set()
    for n, r in enumerate(got):  # one row for each partition
        if now and now[0] == r["first_key"]:
            carry[r["p"]] = now
        if now and r["whole"] and now[:2] == (r["key"], r["state"]):
            now = (now[0], now[1], r["begin"] if r["begin"] - now[3] > gap else now[2], max(now[3], r["top"]))
        else:
            now = (r["key"], r["state"], r["begin"], r["top"])
        if n + 1 < len(got) and got[n + 1]["first_key"] == r["key"]:
            goes_on.add(r["p"])
    out = rows.mapInArrow(_closing(gap, tile, carry, goes_on), "_key string, _state string, start double, end double")
    kinds = dict(df.dtypes)
    parsed = out.withColumn("_k", F.from_json("_key", ", ".join(f"`{k}` {kinds[k]}" for k in keys)))
    return parsed.select(*[F.col(f"_k.{k}").alias(k) for k in keys], F.col("_state").alias(state), "start", "end", (F.col("end") - F.col("start")).alias("dur"))
