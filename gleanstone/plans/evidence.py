"""Queries on the evidence timeline's periods and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanstone.functions.text import code_form, millis, stop_time
from gleanstone.operators.intervals import periods_and_gaps
from gleanstone.plans.base import query
from gleanstone.session import table

STATES = ("gaze", "head", "hand", "face")
LONGEST_GAP_MS = 600_000  # a longer hole is a break between takes


P1_SQL = """
WITH spans AS (
  SELECT key, type, regexp_replace(lower(trim(value)), '[ \\-]', '_', 'g') AS value,
         CAST(round(start * 1000) AS BIGINT) AS b, CAST(round(coalesce("end", start + duration) * 1000) AS BIGINT) AS e
  FROM evidence WHERE type IN ('gaze', 'head', 'hand', 'face')),
ok AS (SELECT * FROM spans WHERE value <> '' AND e >= b),
marked AS (SELECT *, max(e) OVER w AS reach FROM ok
           WINDOW w AS (PARTITION BY key, type, value ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
grouped AS (SELECT *, sum(CASE WHEN reach IS NULL OR b > reach THEN 1 ELSE 0 END)
                     OVER (PARTITION BY key, type, value ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS island FROM marked),
periods AS (SELECT key, type, value, min(b) AS s, max(e) AS t FROM grouped GROUP BY key, type, value, island),
next AS (SELECT *, lead(s) OVER (PARTITION BY key, type, value ORDER BY s) AS n FROM periods)
SELECT key, type, value, 'period' AS kind, s AS start_ms, t AS end_ms FROM periods
UNION ALL SELECT key, type, value, 'gap', t, n FROM next WHERE n - t <= 600000
"""


@query("p1_found", P1_SQL)
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods and gaps of each (clip, behaviour, value) in ``evidence``."""
    e = table(spark, sf_dir, "evidence").where(F.col("type").isin(*STATES))
    spans = e.select("key", "type", code_form(F.col("value")).alias("value"), millis(F.col("start")).alias("b"), millis(stop_time(F.col("start"), F.col("end"), F.col("duration"))).alias("e"))
    out = periods_and_gaps(spans, ["key", "type", "value"], "b", "e", LONGEST_GAP_MS)
    return out.select("key", "type", "value", "kind", F.col("start").alias("start_ms"), F.col("end").alias("end_ms"))
