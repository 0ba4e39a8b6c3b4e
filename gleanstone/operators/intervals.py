"""Overlapping and gapped intervals: continuous periods and the gaps between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanstone.session import range_ordered

NONE = np.iinfo(np.int64).min


class _Scan:
    """Running state over sorted intervals: the entity, its open period's start, its largest end."""

    def __init__(self, entity: list[str], state: tuple | None = None):
        self.entity = entity
        self.last, self.base, self.top = state or (None, NONE, NONE)

    def step(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """For each stretch of a period in ``batch``: its row, start and largest end; then for each gap its row and the end before it."""
        n = batch.num_rows
        cols = [batch.column(c) for c in self.entity]
        start, end = (batch.column(c).to_numpy() for c in ("_start", "_end"))
        new = np.zeros(n, bool)
        for c in cols:
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new[0] = tuple(c[0].as_py() for c in cols) != self.last
        begins = np.flatnonzero(new) if new[0] else np.concatenate([[0], np.flatnonzero(new)])
        before = np.empty(n, np.int64)  # largest end of the entity ahead of each row
        for a, b in zip(begins, [*begins[1:], n]):
            before[a] = NONE if new[a] else self.top
            run = np.maximum(np.maximum.accumulate(end[a:b]), before[a])
            before[a + 1 : b] = run[:-1]
            self.top = int(run[-1])
        opens = start > before  # no earlier interval of the entity reaches this one
        marks = np.union1d(np.flatnonzero(opens), [0])
        begun = np.where(opens[marks], start[marks], self.base)
        gaps = np.flatnonzero(opens & (before != NONE))
        self.base, self.last = int(begun[-1]), tuple(c[n - 1].as_py() for c in cols)
        return marks, begun, np.maximum.reduceat(end, marks), gaps, before[gaps]


def _summary(entity: list[str]):
    """One row for a partition: its number, its first and last entity and the last one's state."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanned, pid, head = _Scan(entity), None, None
        for batch in batches:
            if batch.num_rows:
                if pid is None:
                    pid, head = batch.column("_pid")[0].as_py(), [batch.column(c)[0].as_py() for c in entity]
                scanned.step(batch)
        if pid is not None:
            text = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array([pid], pa.int32()), pa.array([head], text), pa.array([list(scanned.last)], text), pa.array([scanned.base]), pa.array([scanned.top])],
                names=["pid", "head", "last", "base", "top"],
            )

    return scan


def _pieces(entity: list[str], carry: dict):
    """The rescan: sorted intervals in, pieces of periods and whole gaps out."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanned = None
        for batch in batches:
            if batch.num_rows:
                if scanned is None:
                    scanned = _Scan(entity, carry.get(batch.column("_pid")[0].as_py()))
                marks, begun, reach, gaps, ended = scanned.step(batch)
                take = pa.array(np.concatenate([marks, gaps]))
                kind = pa.array(["period"] * len(marks) + ["gap"] * len(gaps), pa.string())
                spans = np.concatenate([begun, ended]), np.concatenate([reach, batch.column("_start").to_numpy()[gaps]])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in entity), kind, *map(pa.array, spans)], names=[*entity, "kind", "start", "end"])

    return scan


def periods_and_gaps(df: DataFrame, entity: list[str], start: str, end: str, longest_gap: int | None = None) -> DataFrame:
    """Continuous periods of each entity's intervals, and the gaps between neighbours.

    ``start`` and ``end`` are whole numbers (say milliseconds); ``entity`` are STRING columns.
    Returns ``entity``, ``kind`` ('period' or 'gap'), ``start``, ``end``. Intervals that touch
    belong together; a gap longer than ``longest_gap`` is left out. Rows with a null in the
    entity, start or end and rows that end before they start are left out; repeated rows,
    ties and nested intervals change nothing; an empty table gives an empty result; other
    columns of ``df`` are ignored, whatever their names.

    One range sort by entity and start spreads a hot entity over many tasks. A partition is
    summed up by its last entity, the start of that entity's last open period and its largest
    end. These summaries, one row for each partition, combine from left to right: a later
    period start holds unless an earlier end reaches it. With the combined state of all
    partitions before it, each partition is scanned once more.
    """
    rows = (
        df.select(*[F.col(c).cast("string").alias(c) for c in entity], F.col(start).cast("bigint").alias("_start"), F.col(end).cast("bigint").alias("_end"))
        .dropna()
        .where("_end >= _start")
    )
    rows = range_ordered(rows, *entity, "_start").withColumn("_pid", F.spark_partition_id())
    summaries = rows.mapInArrow(_summary(entity), "pid int, head array<string>, last array<string>, base bigint, top bigint").collect()
    carry, state = {}, None
    for r in sorted(summaries, key=lambda r: r["pid"]):  # one row for each partition
        if state and state[0] == tuple(r["head"]):
            carry[r["pid"]] = state
        if state and state[0] == tuple(r["last"]):  # the whole partition goes on with the open entity
            state = (state[0], r["base"] if r["base"] > state[2] else state[1], max(state[2], r["top"]))
        else:
            state = (tuple(r["last"]), r["base"], r["top"])
    schema = ", ".join([*(f"`{c}` string" for c in entity), "kind string", "start bigint", "end bigint"])
    out = rows.mapInArrow(_pieces(entity, carry), schema).groupBy(*entity, "kind", "start").agg(F.max("end").alias("end"))
    return out if longest_gap is None else out.where((F.col("kind") == "period") | (F.col("end") - F.col("start") <= longest_gap))
