"""Queries of the claim checker, the rule coach and the diagnosis."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanstone.functions import claims as C
from gleanstone.functions.draws import draw, draw_sql
from gleanstone.operators.interval_join import overlap_join
from gleanstone.operators.ranking import numbered
from gleanstone.plans.aggregates import SHARES, state_shares
from gleanstone.plans.base import BEHAVIOURS, behaviours, query
from gleanstone.plans.joins import ALERTS, CLAIMS, LABELS, POINTS, alerts, claims, matches, points, staged
from gleanstone.plans.windows import EPISODES, episodes
from gleanstone.session import cut, table

LOG = EPISODES + """, la AS (SELECT 'E' AS p, key, type, value, start, "end" FROM ep UNION ALL SELECT DISTINCT 'P', key, type, value, start, coalesce("end", start) FROM evidence WHERE type = 'pause' AND start IS NOT NULL),
log AS (SELECT key, type, value, start, "end", p || row_number() OVER (PARTITION BY key, p ORDER BY start, type, value, "end") AS id FROM la)"""


def log_items(spark: SparkSession, d: str) -> DataFrame:
    """The citable log: key, id (E1 ..., P1 ...), type, value, start, end."""
    p = table(spark, d, "evidence").where("type = 'pause' AND start IS NOT NULL").select("key", "type", "value", "start", F.coalesce("end", "start").alias("end")).distinct().withColumn("p", F.lit("P"))
    a = episodes(spark, d).select("key", "type", "value", "start", "end", F.lit("E").alias("p")).unionByName(p)
    a = a.withColumns({"v": F.col("value").isNull(), "e": F.col("end").isNull()})  # nulls last
    return numbered(a, ["key", "p"], ["start", "type", "v", "value", "e", "end"], "n").select("key", "type", "value", "start", "end", F.concat("p", "n").alias("id"))


@query("ver01")
def ver01(spark: SparkSession, d: str) -> DataFrame:
    """Claims extracted from feedback: field, sentence, time, topic, expected states, quotation."""
    f = table(spark, d, "feedback").dropDuplicates(["feedback_id"])
    i = f.select("feedback_id", F.explode("improvements").alias("i")).where("i IS NOT NULL")
    t = i.select("feedback_id", F.lit("improvements.issue_en").alias("field"), "i.dimension", F.col("i.issue_en").alias("text"))
    t = t.unionByName(i.select("feedback_id", F.lit("improvements.action_steps_en").alias("field"), "i.dimension", F.explode("i.action_steps_en").alias("text")))
    t = t.unionByName(f.select("feedback_id", F.lit("overall_summary_en").alias("field"), F.lit(None).cast("string").alias("dimension"), F.col("overall_summary_en").alias("text")))
    s = t.where("text IS NOT NULL").select("feedback_id", "field", "dimension", F.explode(C.sentences_of(F.col("text"))).alias("sentence"))
    s = s.select("*", F.explode(C.claimed_times(F.col("sentence"))).alias("t")).withColumn("topic", C.topic_at(F.col("sentence"), F.col("t.pos"), F.col("dimension")))
    return s.select("feedback_id", "field", "dimension", "sentence", F.col("t.text").alias("time_text"), "t.t0", "t.t1", "topic", F.array_join(C.expected_states(F.col("topic"), F.col("sentence")), " ").alias("expected"), F.get(C.quotes(F.col("sentence")), F.lit(0)).alias("quote"))


# Words that count as fillers, seconds around a quotation in which its words must be spoken.
FILLERS, AROUND = ("um", "uh", "er", "ah", "hmm", "erm", "like"), 3.0
TIMED = f"""{CLAIMS}, s AS (SELECT claim_id, lower(trim(key)) AS k, topic, quote, coalesce(expected, '') AS expected, clip_duration, least(t0, coalesce(t1, t0)) AS a, greatest(t0, coalesce(t1, t0)) AS b FROM c WHERE t0 IS NOT NULL)"""


@query("ver02", f"""WITH {TIMED}, {BEHAVIOURS}, w AS (SELECT DISTINCT evidence_id, lower(trim(key)) AS k, regexp_replace(lower(value), '[^a-z0-9'']', '', 'g') AS value, start, coalesce("end", start) AS "end" FROM evidence WHERE type = 'word' AND start IS NOT NULL),
e AS (SELECT evidence_id, lower(trim(key)) AS k, type, value, start, "end" FROM behaviours UNION ALL SELECT DISTINCT evidence_id, lower(trim(key)), type, value, start, coalesce("end", start) FROM evidence WHERE type = 'pause' AND start IS NOT NULL UNION ALL SELECT evidence_id, k, 'filler', value, start, "end" FROM w WHERE value IN {FILLERS}),
n AS (SELECT claim_id, count(*) AS n, bool_or(position(e.value IN s.expected) > 0) AS hit FROM s JOIN e ON e.k = s.k AND e.type = s.topic AND e.start <= s.b + 1.0 AND e."end" >= s.a - 1.0 GROUP BY 1),
q AS (SELECT claim_id, [x for x in regexp_split_to_array(regexp_replace(lower(quote), '[^a-z0-9'' ]', '', 'g'), ' +') if x <> ''] AS q FROM s WHERE topic = 'quote'),
said AS (SELECT claim_id, list(DISTINCT value) AS words FROM s JOIN w ON w.k = s.k AND w.start <= s.b + {AROUND} AND w."end" >= s.a - {AROUND} WHERE topic = 'quote' GROUP BY 1)
SELECT s.claim_id, CASE WHEN a > clip_duration + 1.0 THEN 'out_of_range' WHEN topic IS NULL THEN 'unverifiable' WHEN topic = 'quote' THEN CASE WHEN coalesce(len(q), 0) = 0 THEN 'unverifiable' WHEN len([x for x in q if list_contains(words, x)]) / len(q) >= 0.6 THEN 'supported' ELSE 'unsupported' END
WHEN n.n IS NULL THEN 'unsupported' WHEN topic = 'filler' OR expected = '' OR hit THEN 'supported' ELSE 'contradicted' END AS verdict FROM s LEFT JOIN n USING (claim_id) LEFT JOIN q USING (claim_id) LEFT JOIN said USING (claim_id)""")
def ver02(spark: SparkSession, d: str) -> DataFrame:
    """Verdict of each claim: beyond the clip, without a topic, unsupported, supported, contradicted.

    A claimed filler is supported by a filler word within a second, a quotation by six tenths of its words within three.
    """
    t1 = F.coalesce("t1", "t0")
    s = claims(spark, d).where("t0 IS NOT NULL").select("claim_id", F.lower(F.trim("key")).alias("k"), "topic", "quote", F.coalesce("expected", F.lit("")).alias("expected"), "clip_duration", F.least("t0", t1).alias("a_start"), F.greatest("t0", t1).alias("a_end"))
    p = table(spark, d, "evidence").where("type = 'pause' AND start IS NOT NULL").select("evidence_id", "key", "type", "value", "start", F.coalesce("end", "start").alias("end")).distinct()
    w = table(spark, d, "evidence").where("type = 'word' AND start IS NOT NULL").select("evidence_id", "key", F.lit("filler").alias("type"), F.regexp_replace(F.lower("value"), "[^a-z0-9']", "").alias("value"), "start", F.coalesce("end", "start").alias("end")).distinct()
    e = behaviours(spark, d).select("evidence_id", "key", "type", "value", "start", "end").unionByName(p).unionByName(w.where(F.col("value").isin(*FILLERS)))
    spans = [F.lower(F.trim("key")).alias("k"), F.col("type").alias("topic"), "value", F.col("start").alias("b_start"), F.col("end").alias("b_end")]
    n = overlap_join(s, e.select(*spans), ["k", "topic"], 1.0, 10.0).groupBy("claim_id").agg(F.max(F.expr("position(value IN expected) > 0")).alias("hit"))
    said = overlap_join(s.where("topic = 'quote'"), w.select(*spans).drop("topic"), ["k"], AROUND, 10.0).groupBy("claim_id").agg(F.collect_set("value").alias("words"))  # the words of a few seconds
    j = s.join(n.withColumn("near", F.lit(True)), "claim_id", "left").join(said, "claim_id", "left")
    share = C.quote_overlap(F.col("quote"), F.coalesce("words", F.array().cast("array<string>")))
    spoken = F.when(share.isNull(), "unverifiable").when(share >= 0.6, "supported").otherwise("unsupported")
    v = F.when(F.col("a_start") > F.col("clip_duration") + 1.0, "out_of_range").when(F.col("topic").isNull(), "unverifiable").when(F.col("topic") == "quote", spoken).when(F.col("near").isNull(), "unsupported")
    return j.select("claim_id", v.when((F.col("topic") == "filler") | (F.col("expected") == "") | F.col("hit"), "supported").otherwise("contradicted").alias("verdict"))


CITED = LOG + f", {POINTS}, cited AS (SELECT feedback_id, key, n, dimension, unnest(ids) AS id FROM pts), hits AS (SELECT c.*, l.type, l.value, l.start, l.\"end\" FROM cited c LEFT JOIN log l ON l.key = c.key AND l.id = c.id)"


def cited(spark: SparkSession, d: str) -> DataFrame:
    """One row for each cited id of each point, with the log item where there is one."""
    c = points(spark, d).select("feedback_id", "key", "n", "dimension", F.explode("ids").alias("id"))
    return c.join(log_items(spark, d), ["key", "id"], "left")


@query("ver03", CITED + """ SELECT p.feedback_id, CAST(p.n AS INTEGER) AS n, CASE WHEN coalesce(len(p.ids), 0) = 0 THEN 'no_ids' ELSE 'unknown_id' END AS problem FROM pts p LEFT JOIN (SELECT feedback_id, n, count(*) FILTER (type IS NULL AND left(id, 1) IN ('E', 'P')) AS u FROM hits GROUP BY 1, 2) h ON p.feedback_id = h.feedback_id AND p.n = h.n WHERE coalesce(len(p.ids), 0) = 0 OR u > 0""")
def ver03(spark: SparkSession, d: str) -> DataFrame:
    """Points without ids, or with ids of events and pauses that the log doesn't have."""
    return unknown_ids(points(spark, d), cited(spark, d))


def unknown_ids(points: DataFrame, hits: DataFrame) -> DataFrame:
    u = hits.where("type IS NULL AND left(id, 1) IN ('E', 'P')").select("feedback_id", "n").distinct().withColumn("u", F.lit(True))
    none = F.coalesce(F.size("ids"), F.lit(0)) <= 0
    return points.join(u, ["feedback_id", "n"], "left").where(none | F.col("u")).select("feedback_id", "n", F.when(none, "no_ids").otherwise("unknown_id").alias("problem"))


SOURCES = "CASE dimension WHEN 'eye_contact' THEN ['gaze'] WHEN 'head_pose' THEN ['head'] WHEN 'hand_gesture' THEN ['hand'] WHEN 'facial_expression' THEN ['face'] WHEN 'answer_quality' THEN ['speech', 'pause', 'transcript'] END"


@query("ver04", CITED + f" SELECT feedback_id, CAST(n AS INTEGER) AS n FROM hits WHERE type IS NOT NULL AND dimension IS NOT NULL GROUP BY feedback_id, n, dimension HAVING NOT bool_or(list_contains({SOURCES}, type))")
def ver04(spark: SparkSession, d: str) -> DataFrame:
    """Points none of whose cited items is of a kind that their dimension may cite."""
    return wrong_sources(cited(spark, d))


def wrong_sources(hits: DataFrame) -> DataFrame:
    allowed = F.create_map(*[x for k, v in C.DIMENSION_SOURCES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    h = hits.where("type IS NOT NULL AND dimension IS NOT NULL").groupBy("feedback_id", "n", "dimension").agg(F.max(F.array_contains(F.try_element_at(allowed, F.col("dimension")), F.col("type"))).alias("ok"))
    return h.where("NOT ok").select("feedback_id", "n")


@query("ver05", f"WITH {POINTS} SELECT feedback_id, CAST(n AS INTEGER) AS n FROM pts WHERE regexp_matches(issue, '(?i){C.TOPICS['filler']}')")
def ver05(spark: SparkSession, d: str) -> DataFrame:
    """Points about filler words, which aren't measured."""
    return points(spark, d).where(F.col("issue").rlike(f"(?i){C.TOPICS['filler']}")).select("feedback_id", "n")


@query("ver09", SHARES + f", {POINTS}, x AS (SELECT feedback_id, n, key, CASE WHEN regexp_matches(issue, '(?i)eye contact') THEN 'gaze' WHEN regexp_matches(issue, '(?i)smil') THEN 'face' END AS topic, CASE WHEN regexp_matches(issue, '(?i)eye contact') THEN 'eye_contact' WHEN regexp_matches(issue, '(?i)smil') THEN 'smiling' END AS state FROM pts) SELECT x.feedback_id, CAST(x.n AS INTEGER) AS n, round(coalesce(max(share) FILTER (value = state), 0), 9) AS share FROM x JOIN shares s ON s.key = x.key AND s.type = x.topic GROUP BY 1, 2 HAVING coalesce(max(share) FILTER (value = state), 0) < 0.25")
def ver09(spark: SparkSession, d: str) -> DataFrame:
    """Whole-clip statements about a state that takes under a quarter of the time."""
    x = points(spark, d).select("feedback_id", "n", "key", F.when(F.col("issue").rlike("(?i)eye contact"), "gaze").when(F.col("issue").rlike("(?i)smil"), "face").alias("type"), F.when(F.col("issue").rlike("(?i)eye contact"), "eye_contact").when(F.col("issue").rlike("(?i)smil"), "smiling").alias("state"))
    j = x.join(state_shares(spark, d), ["key", "type"]).groupBy("feedback_id", "n").agg(F.coalesce(F.max(F.when(F.col("value") == F.col("state"), F.col("share"))), F.lit(0.0)).alias("share"))
    return j.where("share < 0.25").select("feedback_id", "n", F.round("share", 9).alias("share"))


STYLE = f"WITH {POINTS} SELECT feedback_id, CAST(n AS INTEGER) AS n, len(ids) > 4 AS many_ids, len(regexp_extract_all(issue, '\\b[SEPT]\\d{{1,3}}\\b')) > 2 AS ids_in_text, length(issue) > 320 AS too_long FROM pts WHERE len(ids) > 4 OR len(regexp_extract_all(issue, '\\b[SEPT]\\d{{1,3}}\\b')) > 2 OR length(issue) > 320 OR len(ids) > 3"


@query("ver10", STYLE)
def ver10(spark: SparkSession, d: str) -> DataFrame:
    """Style: more than four ids, ids in the text, over 320 letters; points with four ids are listed too."""
    p = points(spark, d).select("feedback_id", "n", (F.size("ids") > 4).alias("many_ids"), (F.regexp_count("issue", F.lit(r"\b[SEPT]\d{1,3}\b")) > 2).alias("ids_in_text"), (F.length("issue") > 320).alias("too_long"), F.size("ids").alias("k"))
    return p.where("many_ids OR ids_in_text OR too_long OR k > 3").drop("k")


@query("ver14", CITED + f""", pr AS (SELECT feedback_id, n, 'no_ids' AS problem FROM pts WHERE coalesce(len(ids), 0) = 0 UNION ALL SELECT DISTINCT feedback_id, n, 'unknown_id' FROM hits WHERE type IS NULL AND left(id, 1) IN ('E', 'P')
UNION ALL SELECT feedback_id, n, 'wrong_source' FROM hits WHERE type IS NOT NULL AND dimension IS NOT NULL GROUP BY feedback_id, n, dimension HAVING NOT bool_or(list_contains({SOURCES}, type)) UNION ALL SELECT feedback_id, n, 'filler' FROM pts WHERE regexp_matches(issue, '(?i){C.TOPICS['filler']}'))
SELECT p.feedback_id, CAST(p.n AS INTEGER) AS n, CASE WHEN count(pr.problem) > 0 THEN 'failed' ELSE 'ok' END AS status, coalesce(string_agg(pr.problem, ' ' ORDER BY pr.problem), '') AS problems FROM pts p LEFT JOIN pr ON p.feedback_id = pr.feedback_id AND p.n = pr.n GROUP BY 1, 2""")
def ver14(spark: SparkSession, d: str) -> DataFrame:
    """Report of each point: its problems, and whether it fails."""
    hits = cut(cited(spark, d))  # the log is read once
    pr = [unknown_ids(points(spark, d), hits), wrong_sources(hits).withColumn("problem", F.lit("wrong_source")), ver05(spark, d).withColumn("problem", F.lit("filler"))]
    pr = reduce(DataFrame.unionByName, pr).groupBy("feedback_id", "n").agg(F.array_join(F.array_sort(F.collect_list("problem")), " ").alias("problems"))
    return points(spark, d).select("feedback_id", "n").join(pr, ["feedback_id", "n"], "left").select("feedback_id", "n", F.when(F.col("problems").isNull(), "ok").otherwise("failed").alias("status"), F.coalesce("problems", F.lit("")).alias("problems"))


@query("ver15", f"WITH {CLAIMS} SELECT claim_id, approach, verdict FROM (SELECT *, row_number() OVER (PARTITION BY approach ORDER BY {draw_sql('11', 'claim_id')}, claim_id) AS n FROM c WHERE verdict <> 'not_checkable') WHERE n <= 10 ORDER BY {draw_sql('12', 'claim_id')}, claim_id")
def ver15(spark: SparkSession, d: str) -> DataFrame:
    """Blind audit sample by approach, shuffled, with its hidden key."""
    w = Window.partitionBy("approach").orderBy(draw(11, F.col("claim_id")), "claim_id")
    return claims(spark, d).where("verdict <> 'not_checkable'").withColumn("n", F.row_number().over(w)).where("n <= 10").orderBy(draw(12, F.col("claim_id")), "claim_id").select("claim_id", "approach", "verdict")


@query("ver16", """WITH a AS (SELECT DISTINCT ON (audit_id) audit_id, sentence, CASE WHEN lower(trim(rater1_true_false)) IN ('true', 't', '1', 'yes', 'y') THEN 1 WHEN lower(trim(rater1_true_false)) IN ('false', 'f', '0', 'no', 'n') THEN 0 END AS a, CASE WHEN lower(trim(rater2_true_false)) IN ('true', 't', '1', 'yes', 'y') THEN 1 WHEN lower(trim(rater2_true_false)) IN ('false', 'f', '0', 'no', 'n') THEN 0 END AS b FROM hallucination_audit_sample),
k AS (SELECT sentence, min(approach) AS approach FROM hallucination_claims GROUP BY 1) SELECT approach, count(*) AS n, count(*) FILTER (a = b) AS agreed, round(avg(CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a WHEN a = b THEN a END), 9) AS rate FROM a JOIN k USING (sentence) WHERE a IS NOT NULL OR b IS NOT NULL GROUP BY 1""")
def ver16(spark: SparkSession, d: str) -> DataFrame:
    """Audit scored: ties left out, agreement and share of true claims by approach."""
    def num(c: str):
        x = F.lower(F.trim(c))
        return F.when(x.isin("true", "t", "1", "yes", "y"), 1).when(x.isin("false", "f", "0", "no", "n"), 0)

    a = table(spark, d, "hallucination_audit_sample").dropDuplicates(["audit_id"]).select("sentence", num("rater1_true_false").alias("a"), num("rater2_true_false").alias("b")).where("a IS NOT NULL OR b IS NOT NULL")
    k = table(spark, d, "hallucination_claims").groupBy("sentence").agg(F.min("approach").alias("approach"))
    v = F.when(F.col("a").isNull(), F.col("b")).when(F.col("b").isNull(), F.col("a")).when(F.col("a") == F.col("b"), F.col("a"))
    return a.join(k, "sentence").groupBy("approach").agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("agreed"), F.round(F.avg(v), 9).alias("rate"))


@query("ver18", f"WITH {POINTS} SELECT feedback_id, count(*) AS n_points, count(*) FILTER (len(ids) BETWEEN 1 AND 4) AS kept FROM (SELECT * FROM pts UNION ALL SELECT feedback_id, key, n + 100, dimension, ids[1:2], issue FROM pts WHERE len(ids) > 3) GROUP BY 1")
def ver18(spark: SparkSession, d: str) -> DataFrame:
    """Points checked again with the removed ones put back."""
    p = points(spark, d)
    back = p.where("size(ids) > 3").withColumn("n", F.col("n") + 100).withColumn("ids", F.slice("ids", 1, 2))
    return p.unionByName(back).groupBy("feedback_id").agg(F.count("*").alias("n_points"), F.count_if(F.size("ids").between(1, 4)).alias("kept"))


ALERT_SQL = EPISODES + """, dur AS (SELECT key, sum(dur) AS s FROM behaviours WHERE type = 'hand' GROUP BY key), sh AS (SELECT key, type, value, sum(dur) / nullif(sum(sum(dur)) OVER (PARTITION BY key, type), 0) AS share FROM behaviours GROUP BY 1, 2, 3),
w AS (SELECT DISTINCT evidence_id, key, start, "end" FROM evidence WHERE type = 'word'), sp AS (SELECT key, max("end") - min(start) AS span, count(*) / ((max("end") - min(start)) / 60) AS wpm FROM w GROUP BY key HAVING max("end") > min(start))
SELECT key, CASE value WHEN 'looking_away' THEN 'look_away' WHEN 'turned_down' THEN 'head_down' WHEN 'turned_up' THEN 'head_up' WHEN 'turned_left' THEN 'head_left' ELSE 'head_right' END AS alert, round(start, 3) AS start FROM ep WHERE value IN ('looking_away', 'turned_down', 'turned_up', 'turned_left', 'turned_right') AND dur >= 3
UNION ALL SELECT key, 'long_pause', round(start, 3) FROM (SELECT DISTINCT key, start, "end" FROM evidence WHERE type = 'pause' AND "end" - start >= 3)
UNION ALL SELECT key, CASE value WHEN 'hands_hidden' THEN 'hands_hidden' WHEN 'gesturing' THEN 'hands_busy' ELSE 'neutral_face' END, NULL FROM sh WHERE (value = 'hands_hidden' AND share >= 0.5) OR (value = 'gesturing' AND share >= 0.3) OR (value = 'neutral' AND share >= 0.5)
UNION ALL SELECT key, CASE WHEN span < 30 THEN 'too_short' ELSE 'too_long' END, NULL FROM sp WHERE span < 30 OR span > 150 UNION ALL SELECT sp.key, 'too_fast', NULL FROM sp JOIN (SELECT key, min(language) AS l FROM transcript GROUP BY key) t ON sp.key = t.key WHERE t.l = 'en' AND wpm > 160"""


@query("ver19", ALERT_SQL)
def ver19(spark: SparkSession, d: str) -> DataFrame:
    """Alerts over the log: long episodes and pauses, states that take too much, length, pace in English."""
    names = F.create_map(*[F.lit(x) for kv in {"looking_away": "look_away", "turned_down": "head_down", "turned_up": "head_up", "turned_left": "head_left", "turned_right": "head_right"}.items() for x in kv])
    e = episodes(spark, d).where("dur >= 3").select("key", F.try_element_at(names, F.col("value")).alias("alert"), F.round("start", 3).alias("start")).where("alert IS NOT NULL")
    p = table(spark, d, "evidence").where("type = 'pause' AND end - start >= 3").select("key", F.lit("long_pause").alias("alert"), "start", "end").distinct().select("key", "alert", F.round("start", 3).alias("start"))
    none = F.lit(None).cast("double").alias("start")
    s = state_shares(spark, d).where("value = 'hands_hidden' AND share >= 0.5 OR value = 'gesturing' AND share >= 0.3 OR value = 'neutral' AND share >= 0.5")
    s = s.select("key", F.when(F.col("value") == "gesturing", "hands_busy").when(F.col("value") == "neutral", "neutral_face").otherwise(F.col("value")).alias("alert"), none)
    w = table(spark, d, "evidence").where("type = 'word'").select("evidence_id", "key", "start", "end").distinct().groupBy("key").agg((F.max("end") - F.min("start")).alias("span"), F.count("*").alias("n")).where("span > 0")
    length = w.where("span < 30 OR span > 150").select("key", F.when(F.col("span") < 30, "too_short").otherwise("too_long").alias("alert"), none)
    lang = table(spark, d, "transcript").groupBy("key").agg(F.min("language").alias("l")).where("l = 'en'")
    fast = w.where("n / (span / 60) > 160").join(lang, "key", "left_semi").select("key", F.lit("too_fast").alias("alert"), none)
    return reduce(DataFrame.unionByName, [e, p, s, length, fast])


@query("ver20", f"WITH {LABELS}, {ALERTS}, m AS (SELECT label_id, evidence_id FROM lab JOIN alerts e USING (clip, type) WHERE a IS NULL OR (e.start <= b + 2.0 AND e.\"end\" >= a - 2.0)), r AS (SELECT type, count(*) AS labelled, count(*) FILTER (label_id IN (SELECT label_id FROM m)) AS caught FROM lab GROUP BY 1), p AS (SELECT type, count(*) AS alerts, count(*) FILTER (evidence_id IN (SELECT evidence_id FROM m)) AS matched FROM alerts GROUP BY 1) SELECT r.type, labelled, caught, round(caught / labelled, 9) AS recall, coalesce(alerts, 0) AS alerts, coalesce(matched, 0) AS matched FROM r LEFT JOIN p USING (type)")
def ver20(spark: SparkSession, d: str) -> DataFrame:
    """Recall of labels and matched alerts by type."""
    m = matches(spark, d)
    lab = staged(spark, d).join(m.select("label_id").distinct().withColumn("hit", F.lit(1)), "label_id", "left").groupBy("type").agg(F.count("*").alias("labelled"), F.count("hit").alias("caught"))
    al = alerts(spark, d).join(m.select("evidence_id").distinct().withColumn("hit", F.lit(1)), "evidence_id", "left").groupBy("type").agg(F.count("*").alias("alerts"), F.count("hit").alias("matched"))
    zero = F.lit(0).cast("bigint")
    return lab.join(al, "type", "left").select("type", "labelled", "caught", F.round(F.col("caught") / F.col("labelled"), 9).alias("recall"), F.coalesce("alerts", zero).alias("alerts"), F.coalesce("matched", zero).alias("matched"))


COACH = SHARES + """, g AS (SELECT key, max(share) FILTER (value = 'eye_contact') AS ec, max(share) FILTER (value = 'looking_away') AS away, max(share) FILTER (value = 'hands_hidden') AS hidden, max(share) FILTER (value = 'gesturing') AS busy, max(share) FILTER (value = 'smiling') AS smile, max(share) FILTER (value = 'neutral') AS neutral, sum(share) FILTER (value LIKE 'turned%') AS turned FROM shares GROUP BY key),
rules AS (SELECT key, 'eye_contact' AS dimension, 'strength' AS kind, ec AS v FROM g WHERE ec >= 0.3 AND coalesce(away, 0) < 0.3 UNION ALL SELECT key, 'eye_contact', 'issue', away FROM g WHERE away >= 0.3 UNION ALL SELECT key, 'head_pose', 'issue', turned FROM g WHERE turned >= 0.3
UNION ALL SELECT key, 'hand_gesture', 'issue', greatest(coalesce(hidden, 0), coalesce(busy, 0)) FROM g WHERE hidden >= 0.5 OR busy >= 0.6 UNION ALL SELECT key, 'facial_expression', 'strength', smile FROM g WHERE smile >= 0.3 UNION ALL SELECT key, 'facial_expression', 'issue', neutral FROM g WHERE neutral >= 0.3 AND coalesce(smile, 0) < 0.3)"""


def coach_rules(spark: SparkSession, d: str) -> DataFrame:
    """key, dimension, kind (strength or issue), v: the share that triggers the rule."""
    v, s = F.col("value"), F.col("share")
    pick = lambda x: F.max(F.when(v == x, s))
    g = state_shares(spark, d).groupBy("key").agg(
        pick("eye_contact").alias("ec"), pick("looking_away").alias("away"), pick("hands_hidden").alias("hidden"), pick("gesturing").alias("busy"), pick("smiling").alias("smile"), pick("neutral").alias("neutral"), F.sum(F.when(v.startswith("turned"), s)).alias("turned"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rule = lambda when, dim, kind, what: F.when(when, F.struct(F.lit(dim).alias("dimension"), F.lit(kind).alias("kind"), what.alias("v")))
    c = F.col
    rules = F.array(
        rule((c("ec") >= 0.3) & (zero("away") < 0.3), "eye_contact", "strength", c("ec")), rule(c("away") >= 0.3, "eye_contact", "issue", c("away")), rule(c("turned") >= 0.3, "head_pose", "issue", c("turned")),
        rule((c("hidden") >= 0.5) | (c("busy") >= 0.6), "hand_gesture", "issue", F.greatest(zero("hidden"), zero("busy"))), rule(c("smile") >= 0.3, "facial_expression", "strength", c("smile")), rule((c("neutral") >= 0.3) & (zero("smile") < 0.3), "facial_expression", "issue", c("neutral")))
    return g.select("key", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("r")).select("key", "r.*")


@query("coa01", COACH + " SELECT key, dimension, kind, round(v, 9) AS v FROM rules")
def coa01(spark: SparkSession, d: str) -> DataFrame:
    """Strengths and issues by the coach's rules."""
    return coach_rules(spark, d).select("key", "dimension", "kind", F.round("v", 9).alias("v"))


ORDER = "CASE dimension WHEN 'eye_contact' THEN 0 WHEN 'head_pose' THEN 1 WHEN 'hand_gesture' THEN 2 ELSE 3 END"


@query("coa02", COACH + f", s AS (SELECT *, CASE WHEN v >= 0.7 THEN 1 WHEN v >= 0.5 THEN 2 ELSE 3 END AS sev FROM rules WHERE kind = 'issue'), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY sev, {ORDER}) AS n FROM s) SELECT key, max(dimension) FILTER (n = 1) AS first_issue, count(*) AS issues, string_agg(CASE WHEN sev <= 1 THEN 'high' WHEN sev = 2 THEN 'medium' ELSE 'low' END, ' ' ORDER BY n) AS priorities FROM r GROUP BY key")
def coa02(spark: SparkSession, d: str) -> DataFrame:
    """Issues ranked by severity and dimension, with priorities and the first to work on."""
    s = coach_rules(spark, d).where("kind = 'issue'").withColumn("sev", F.when(F.col("v") >= 0.7, 1).when(F.col("v") >= 0.5, 2).otherwise(3)).withColumn("o", F.expr(ORDER))
    g = s.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("sev", "o", "dimension"))).alias("l"))
    name = F.transform("l", lambda x: F.when(x["sev"] <= 1, "high").when(x["sev"] == 2, "medium").otherwise("low"))
    return g.select("key", F.get("l.dimension", F.lit(0)).alias("first_issue"), F.size("l").cast("bigint").alias("issues"), F.array_join(name, " ").alias("priorities"))


@query("coa03", "SELECT DISTINCT qid, CASE qid WHEN 'q1' THEN 'Situation, task, action, result.' WHEN 'q2' THEN 'Name one strength and one proof.' ELSE 'Answer first, then one example.' END AS template FROM sft_train WHERE qid IS NOT NULL")
def coa03(spark: SparkSession, d: str) -> DataFrame:
    """Template of an improved answer by the question's focus."""
    t = F.when(F.col("qid") == "q1", "Situation, task, action, result.").when(F.col("qid") == "q2", "Name one strength and one proof.").otherwise("Answer first, then one example.")
    return table(spark, d, "sft_train").where("qid IS NOT NULL").select("qid", t.alias("template")).distinct()


@query("coa04", "SELECT c_custkey, CASE WHEN s >= 85 THEN 'Excellent' WHEN s >= 70 THEN 'Good' WHEN s >= 55 THEN 'Fair' WHEN s >= 40 THEN 'Needs Work' ELSE 'Priority' END AS overall FROM (SELECT c_custkey, coalesce(s_acctbal, c_acctbal) / 100 AS s FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey)")
def coa04(spark: SparkSession, d: str) -> DataFrame:
    """Overall band from the learned score, else from the rule score."""
    from gleanstone.functions.scoring import band

    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_acctbal")
    return table(spark, d, "customer").join(s, "c_custkey", "left").select("c_custkey", band(F.coalesce("s_acctbal", "c_acctbal") / 100).alias("overall"))


DOCTOR = "f AS (SELECT o_custkey AS id, count(*) AS words, sum(o_totalprice) / 200000 AS pauses, avg(o_totalprice) / 1000 AS wpm FROM orders GROUP BY 1), v AS (SELECT id, unnest(['too_short', 'long_pauses', 'pace', 'pace']) AS issue, unnest([(9 - words) / 9, (pauses - 7) / 7, (100 - wpm) / 100, (wpm - 180) / 180]) AS sev FROM f), m AS (SELECT id, issue, max(sev) AS sev FROM v WHERE sev > 0 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sev DESC, issue) AS n FROM m)"


@query("coa05", f"WITH {DOCTOR} SELECT f.id, coalesce(max(issue) FILTER (n = 1), 'none') AS top_issue, coalesce(max(issue) FILTER (n = 2), '') AS second_issue FROM f LEFT JOIN r ON f.id = r.id GROUP BY 1")
def coa05(spark: SparkSession, d: str) -> DataFrame:
    """Rule diagnosis: relative distance beyond each threshold, the two gravest issues."""
    f = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("words"), (F.sum("o_totalprice") / 200000).alias("pauses"), (F.avg("o_totalprice") / 1000).alias("wpm"))
    c = F.col
    pace = F.greatest((100 - c("wpm")) / 100, (c("wpm") - 180) / 180)
    rules = F.array(*[F.when(s > 0, F.struct((-s).alias("s"), F.lit(i).alias("issue"))) for i, s in (("too_short", (9 - c("words")) / 9), ("long_pauses", (c("pauses") - 7) / 7), ("pace", pace))])
    g = f.select("id", F.array_sort(F.filter(rules, lambda x: x.isNotNull())).alias("l"))
    return g.select("id", F.coalesce(F.get("l.issue", F.lit(0)), F.lit("none")).alias("top_issue"), F.coalesce(F.get("l.issue", F.lit(1)), F.lit("")).alias("second_issue"))


@query("coa06", "WITH f AS (SELECT o_custkey AS id, avg(o_totalprice) AS a, count(*)::DOUBLE AS b, max(o_totalprice) AS c FROM orders GROUP BY 1), m AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, avg(c) AS mc, stddev_pop(c) AS sc FROM f) SELECT id, round(-(0.4 * (a - ma) / sa) * 0.3, 6) AS pace, round(-(0.25 * (b - mb) / sb - 0.1 * (c - mc) / sc) * 0.3, 6) AS pauses FROM f, m")
def coa06(spark: SparkSession, d: str) -> DataFrame:
    """Model diagnosis: minus the contributions of an issue's features, times the model's weight."""
    f = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.avg("o_totalprice").alias("a"), F.count("*").cast("double").alias("b"), F.max("o_totalprice").alias("c"))
    m = f.agg(*[g(x).alias(f"{n}{x}") for x in "abc" for n, g in (("m", F.avg), ("s", F.stddev_pop))]).first().asDict()
    if m["ma"] is None:
        return f.select("id", F.lit(None).cast("double").alias("pace"), F.lit(None).cast("double").alias("pauses"))
    z = {x: (F.col(x) - m[f"m{x}"]) / m[f"s{x}"] for x in "abc"}
    return f.select("id", F.round(-(0.4 * z["a"]) * 0.3, 6).alias("pace"), F.round(-(0.25 * z["b"] - 0.1 * z["c"]) * 0.3, 6).alias("pauses"))


@query("coa07", "SELECT example_id, coalesce(lang, CASE WHEN key LIKE '%_q1%' THEN 'en' ELSE 'th' END) AS lang, coalesce(nullif(regexp_extract(key, '_q([1-6])', 1), ''), '0') AS question FROM (SELECT DISTINCT ON (example_id) * FROM sft_train) WHERE key IS NOT NULL")
def coa07(spark: SparkSession, d: str) -> DataFrame:
    """Language and question of a clip from its metadata or its key."""
    s = table(spark, d, "sft_train").dropDuplicates(["example_id"]).where("key IS NOT NULL")
    return s.select("example_id", F.coalesce("lang", F.when(F.col("key").contains("_q1"), "en").otherwise("th")).alias("lang"), F.coalesce(F.nullif(F.regexp_extract("key", "_q([1-6])", 1), F.lit("")), F.lit("0")).alias("question"))


@query("ver13", """SELECT feedback_id, len(list_distinct([x for x in regexp_extract_all(regexp_replace(t, '\\[[^\\]]*\\]', '', 'g'), '\\d+(?:\\.\\d+)?') if NOT list_contains(k, x)])) AS invented
FROM (SELECT DISTINCT ON (feedback_id) feedback_id, improved_answer.rewritten_en AS t, regexp_extract_all(coalesce(improved_answer.original_snippet, ''), '\\d+(?:\\.\\d+)?') AS k FROM feedback) WHERE t IS NOT NULL""")
def ver13(spark: SparkSession, d: str) -> DataFrame:
    """How many numbers of an improved answer its original doesn't have."""
    f = table(spark, d, "feedback").dropDuplicates(["feedback_id"]).select("feedback_id", F.col("improved_answer.rewritten_en").alias("t"), F.coalesce("improved_answer.original_snippet", F.lit("")).alias("o")).where("t IS NOT NULL")
    return f.select("feedback_id", F.size(C.invented_numbers(F.col("t"), F.regexp_extract_all("o", F.lit(r"\d+(?:\.\d+)?"), F.lit(0)))).cast("bigint").alias("invented"))
