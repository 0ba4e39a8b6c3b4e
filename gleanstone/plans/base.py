"""The registry that query modules fill, and columns they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanstone.session import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name`` with the SQL that gives the same rows in DuckDB."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def epoch(c: str) -> Column:
    """Seconds since 1970 of a timestamp without time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c})") / 1_000_000


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events stream read as a series of states: key, t (seconds), state, value."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), epoch("ts").alias("t"), F.col("event_type").alias("state"), "value", "event_id")


FRAMES = "frames AS (SELECT user_id AS key, epoch_us(ts) / 1000000 AS t, event_type AS state, value, event_id FROM events)"


def behaviours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean visual evidence: one row for each id with key, type, value (code form), start, end, dur."""
    from gleanstone.functions.text import code_form

    e = table(spark, sf_dir, "evidence").where("type IN ('gaze', 'head', 'hand', 'face')").dropDuplicates(["evidence_id"])
    e = e.select("evidence_id", "key", "type", code_form(F.col("value")).alias("value"), "start", F.coalesce("end", F.col("start") + F.col("duration")).alias("end"))
    return e.where("value IS NOT NULL AND start IS NOT NULL AND end >= start").withColumn("dur", F.col("end") - F.col("start"))


BEHAVIOURS = """behaviours AS (
  SELECT *, "end" - start AS dur FROM (
    SELECT DISTINCT ON (evidence_id) evidence_id, key, type, regexp_replace(lower(trim(value)), '[ \\-]', '_', 'g') AS value, start, coalesce("end", start + duration) AS "end"
    FROM evidence WHERE type IN ('gaze', 'head', 'hand', 'face')) WHERE value <> '' AND start IS NOT NULL AND "end" >= start)"""
