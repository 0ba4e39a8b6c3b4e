"""Queries on runs of gaze states (problem 5) and claims' nearest evidence (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanstone.functions.text import millis, stop_time
from gleanstone.llm.nearest import nearest_in_time
from gleanstone.llm.runs import collapse_runs, with_states
from gleanstone.session import table

GAZE = ("eye_contact", "looking_away", "no_face", "low_lids")
TOPICS = ("gaze", "head", "hand", "face", "pause")
HALF_MICRO = 2_000_000  # moments are exact in half microseconds


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two or more gaze rows of one state."""
    g = table(spark, sf_dir, "gaze_events").where("event is not null and start is not null")
    g = with_states(g, "event", GAZE, "event").select("key", "event_id", "event", millis(F.col("start")).alias("b"), millis(stop_time(F.col("start"), F.col("end"), F.col("duration"))).alias("e"))
    r = collapse_runs(g, "key", "event", "b", "e", "event_id", 500).where("n >= 2")
    return r.select("key", "event", F.col("first_id").alias("first_event_id"), F.col("last_id").alias("last_event_id"), F.col("n").cast("int").alias("n_events"), (F.col("end") - F.col("start")).alias("duration_ms"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence row nearest in time to each claim's moment, of its clip and topic, within a second."""
    clip = F.lower(F.trim("key"))
    micros = lambda c: F.round(F.nanvl(F.col(c), F.lit(None).cast("double")) * 1_000_000).cast("bigint")
    c = table(spark, sf_dir, "hallucination_claims").where(F.col("topic").isin(*TOPICS))
    c = c.select("claim_id", clip.alias("clip"), F.col("topic").alias("what"), (micros("t0") + F.coalesce(micros("t1"), micros("t0"))).alias("moment"))
    e = table(spark, sf_dir, "evidence").where(F.col("type").isin(*TOPICS) & F.col("start").isNotNull())
    e = e.select("evidence_id", clip.alias("clip"), F.col("type").alias("what"), (micros("start") * 2).alias("moment"))
    return nearest_in_time(c, e, ["clip", "what"], "claim_id", "evidence_id", "moment", "moment", HALF_MICRO, HALF_MICRO // 8).select("claim_id", "evidence_id")


P4_SQL = """
WITH c AS (SELECT DISTINCT claim_id, lower(trim(key)) AS clip, topic,
             CAST(round(t0 * 1000000) AS BIGINT) + CAST(round(coalesce(t1, t0) * 1000000) AS BIGINT) AS m
           FROM hallucination_claims WHERE topic IN ('gaze', 'head', 'hand', 'face', 'pause')),
e AS (SELECT DISTINCT evidence_id, lower(trim(key)) AS clip, type, 2 * CAST(round(start * 1000000) AS BIGINT) AS m
      FROM evidence WHERE start IS NOT NULL),
r AS (SELECT claim_id, evidence_id, row_number() OVER (PARTITION BY claim_id ORDER BY abs(c.m - e.m), evidence_id) AS n
      FROM c JOIN e ON c.clip = e.clip AND c.topic = e.type AND abs(c.m - e.m) <= 2000000)
SELECT claim_id, evidence_id FROM r WHERE n = 1
"""

P5_SQL = """
WITH g AS (
  SELECT DISTINCT event_id, key, regexp_replace(translate(lower(event), '01', 'ol'), '[^\\p{L}\\p{Nd}]', '', 'g') AS w,
         CAST(round(start * 1000) AS BIGINT) AS b, CAST(round(coalesce("end", start + duration, start) * 1000) AS BIGINT) AS e0
  FROM gaze_events WHERE event IS NOT NULL AND start IS NOT NULL),
d AS (SELECT *, greatest(b, e0) AS e, levenshtein(w, 'eyecontact') AS d1, levenshtein(w, 'lookingaway') AS d2,
             levenshtein(w, 'noface') AS d3, levenshtein(w, 'lowlids') AS d4 FROM g),
s AS (SELECT key, event_id, b, e, CASE WHEN d1 <= 2 AND d1 < least(d2, d3, d4) THEN 'eye_contact' WHEN d2 <= 2 AND d2 < least(d1, d3, d4) THEN 'looking_away'
             WHEN d3 <= 2 AND d3 < least(d1, d2, d4) THEN 'no_face' WHEN d4 <= 2 AND d4 < least(d1, d2, d3) THEN 'low_lids' END AS event FROM d),
f AS (SELECT *, CASE WHEN event = lag(event) OVER w THEN 0 ELSE 1 END AS c FROM s WINDOW w AS (PARTITION BY key ORDER BY b, e, event_id)),
seg AS (SELECT *, sum(c) OVER (PARTITION BY key ORDER BY b, e, event_id ROWS UNBOUNDED PRECEDING) AS seg FROM f),
m AS (SELECT *, max(e) OVER (PARTITION BY key, seg ORDER BY b, e, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM seg),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR b > reach + 500 THEN 1 ELSE 0 END)
             OVER (PARTITION BY key, seg ORDER BY b, e, event_id ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT key, event, arg_min(event_id, (b, e, event_id)) AS first_event_id, arg_max(event_id, (b, e, event_id)) AS last_event_id,
       CAST(count(*) AS INTEGER) AS n_events, CAST(max(e) - min(b) AS BIGINT) AS duration_ms
FROM n WHERE event IS NOT NULL GROUP BY key, event, seg, run HAVING count(*) >= 2
"""
