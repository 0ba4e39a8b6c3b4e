"""Queries of the aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanstone.functions.scoring import weighted_fusion
from gleanstone.operators import states as S
from gleanstone.operators.ranking import numbered, previous
from gleanstone.plans.base import BEHAVIOURS, behaviours, query
from gleanstone.plans.joins import CLAIMS, claims, points, POINTS
from gleanstone.session import table


def _r(c, n: int = 9):
    return F.round(c, n)


@query("agg01", "SELECT o_custkey, round(avg(o_totalprice), 4) AS price, round(avg(l_q), 9) AS quantity, count(*) AS n_clips FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS l_q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY o_custkey")
def agg01(spark: SparkSession, d: str) -> DataFrame:
    """Mean of each feature and number of clips by participant; means pass over nulls."""
    l = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q"))  # noqa: E741
    return table(spark, d, "orders").join(l, "o_orderkey", "left").groupBy("o_custkey").agg(_r(F.avg("o_totalprice"), 4).alias("price"), _r(F.avg("q")).alias("quantity"), F.count("*").alias("n_clips"))


@query("agg02", "SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 9) AS quantity, round(avg(l_discount), 8) AS discount, count(*) AS n FROM lineitem GROUP BY 1, 2")
def agg02(spark: SparkSession, d: str) -> DataFrame:
    """Means of measures and sizes over two keys."""
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(_r(F.avg("l_quantity")).alias("quantity"), _r(F.avg("l_discount"), 8).alias("discount"), F.count("*").alias("n"))


VERDICTS = ("supported", "contradicted", "unsupported", "out_of_range", "not_checkable")


@query("agg03", f"""WITH {CLAIMS} SELECT approach, {', '.join(f"count(*) FILTER (verdict = '{v}') AS {v}" for v in VERDICTS)},
round(count(*) FILTER (verdict IN ('contradicted', 'unsupported', 'out_of_range')) / nullif(count(*) FILTER (verdict <> 'not_checkable'), 0), 9) AS rate FROM c GROUP BY approach""")
def agg03(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts and hallucination rate of each approach."""
    v = F.col("verdict")
    bad = F.count_if(v.isin("contradicted", "unsupported", "out_of_range"))
    return claims(spark, d).groupBy("approach").agg(*[F.count_if(v == x).alias(x) for x in VERDICTS], _r(F.try_divide(bad, F.count_if(v != "not_checkable"))).alias("rate"))


@query("agg04", f"""WITH {CLAIMS} SELECT approach, lower(trim(key)) AS key, count(*) FILTER (verdict <> 'not_checkable') AS verifiable, count(*) FILTER (verdict IN ('contradicted', 'unsupported', 'out_of_range')) AS hallucinated,
round(count(*) FILTER (verdict IN ('contradicted', 'unsupported', 'out_of_range')) / nullif(count(*) FILTER (verdict <> 'not_checkable'), 0), 9) AS rate FROM c GROUP BY 1, 2""")
def agg04(spark: SparkSession, d: str) -> DataFrame:
    """Rate of each clip; null where nothing can be verified."""
    v = F.col("verdict")
    ok, bad = F.count_if(v != "not_checkable"), F.count_if(v.isin("contradicted", "unsupported", "out_of_range"))
    return claims(spark, d).groupBy("approach", F.lower(F.trim("key")).alias("key")).agg(ok.alias("verifiable"), bad.alias("hallucinated"), _r(F.try_divide(bad, ok)).alias("rate"))


@query("agg05", "SELECT approach, count(DISTINCT lower(trim(key))) AS clips, count(DISTINCT dimension) AS dimensions FROM hallucination_claims GROUP BY approach")
def agg05(spark: SparkSession, d: str) -> DataFrame:
    """Distinct counts."""
    return table(spark, d, "hallucination_claims").groupBy("approach").agg(F.count_distinct(F.lower(F.trim("key"))).alias("clips"), F.count_distinct("dimension").alias("dimensions"))


@query("agg06", "SELECT c_mktsegment, string_agg(CAST(n AS VARCHAR), ' ' ORDER BY n) AS nations FROM (SELECT DISTINCT c_mktsegment, c_nationkey AS n FROM customer) GROUP BY 1")
def agg06(spark: SparkSession, d: str) -> DataFrame:
    """The set of values of each group."""
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.array_join(F.array_sort(F.collect_set("c_nationkey")), " ").alias("nations"))


@query("agg07", f"WITH {CLAIMS} SELECT approach, dimension, sum(CASE WHEN verdict = 'supported' THEN 1 ELSE 0 END)::BIGINT AS covered, count(*) AS labelled, round(avg(CASE WHEN verdict = 'supported' THEN 1.0 ELSE 0.0 END), 9) AS coverage FROM c GROUP BY 1, 2")
def agg07(spark: SparkSession, d: str) -> DataFrame:
    """Several named aggregates and the ratio of two of them."""
    hit = (F.col("verdict") == "supported").cast("bigint")
    g = claims(spark, d).groupBy("approach", "dimension").agg(F.coalesce(F.sum(hit), F.lit(0)).alias("covered"), F.count("*").alias("labelled"))
    return g.withColumn("coverage", _r(F.col("covered") / F.col("labelled")))


@query("agg08", "SELECT substr(clip, 1, 2) AS person, type, count(*) AS n, round(avg(\"end\" - start), 9) AS mean_sec FROM (SELECT DISTINCT ON (label_id) * FROM test_rq2_labels) GROUP BY 1, 2")
def agg08(spark: SparkSession, d: str) -> DataFrame:
    """Aggregates by an expression of the key."""
    l = table(spark, d, "test_rq2_labels").dropDuplicates(["label_id"])  # noqa: E741
    return l.groupBy(F.substring("clip", 1, 2).alias("person"), "type").agg(F.count("*").alias("n"), _r(F.avg(F.col("end") - F.col("start"))).alias("mean_sec"))


@query("agg09", "SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC")
def agg09(spark: SparkSession, d: str) -> DataFrame:
    """Counts of values, the commonest first."""
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query("agg10", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, arg_min(event_type, (-n, event_type)) AS mode FROM c GROUP BY 1")
def agg10(spark: SparkSession, d: str) -> DataFrame:
    """Most frequent value, the smallest of equals."""
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.min_by("event_type", F.struct(-F.col("n"), "event_type")).alias("mode"))


@query("agg11", "SELECT p_brand, p_size, round(avg(p_retailprice), 9) AS mean, round(stddev_samp(p_retailprice), 9) AS sd, count(*) AS n FROM part GROUP BY 1, 2")
def agg11(spark: SparkSession, d: str) -> DataFrame:
    """Mean, sample deviation and count."""
    return table(spark, d, "part").groupBy("p_brand", "p_size").agg(_r(F.avg("p_retailprice")).alias("mean"), _r(F.stddev_samp("p_retailprice")).alias("sd"), F.count("*").alias("n"))


@query("agg12", "SELECT user_id, round(sum(value) FILTER (event_type = 'view'), 4) AS view, round(sum(value) FILTER (event_type = 'click'), 4) AS click, round(sum(value) FILTER (event_type = 'purchase'), 4) AS purchase FROM events GROUP BY 1")
def agg12(spark: SparkSession, d: str) -> DataFrame:
    """Pivot with explicit values."""
    p = table(spark, d, "events").groupBy("user_id").pivot("event_type", ["view", "click", "purchase"]).agg(F.sum("value"))
    return p.select("user_id", *[_r(c, 4).alias(c) for c in ("view", "click", "purchase")])


@query("agg13", """WITH r AS (SELECT c_acctbal, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS r, count(*) OVER () AS n FROM customer)
SELECT CAST(greatest(ceil((r - 1) * 5 / (n - 1)) - 1, 0) AS INTEGER) AS stratum, count(*) AS n, min(c_acctbal) AS low, max(c_acctbal) AS high FROM r GROUP BY 1""")
def agg13(spark: SparkSession, d: str) -> DataFrame:
    """Size and range of each stratum."""
    from gleanstone.operators.ranking import quantile_bins

    q = quantile_bins(table(spark, d, "customer"), ["c_acctbal", "c_custkey"], 5, "stratum")
    return q.groupBy("stratum").agg(F.count("*").alias("n"), F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"))


@query("agg14", "SELECT count(c_acctbal) AS n, round(avg(c_acctbal), 9) AS mean, round(stddev_samp(c_acctbal), 9) AS sd, min(c_acctbal) AS low, round(quantile_cont(c_acctbal, 0.5), 9) AS middle, max(c_acctbal) AS high FROM customer")
def agg14(spark: SparkSession, d: str) -> DataFrame:
    """Description of a column."""
    c = F.col("c_acctbal")
    return table(spark, d, "customer").agg(F.count(c).alias("n"), _r(F.avg(c)).alias("mean"), _r(F.stddev_samp(c)).alias("sd"), F.min(c).alias("low"), _r(F.median(c)).alias("middle"), F.max(c).alias("high"))


SHARES = f"""WITH {BEHAVIOURS}, per_state AS (SELECT key, type, value, sum(dur) AS sec FROM behaviours GROUP BY 1, 2, 3), shares AS (SELECT *, CASE WHEN sum(sec) OVER (PARTITION BY key, type) = 0 THEN 0.0 ELSE sec / sum(sec) OVER (PARTITION BY key, type) END AS share FROM per_state)"""


def state_shares(spark: SparkSession, d: str) -> DataFrame:
    return S.shares(behaviours(spark, d), ["key", "type"], "value")


@query("agg15", SHARES + " SELECT key, type, value, round(sec, 4) AS sec, round(share, 9) AS share FROM shares")
def agg15(spark: SparkSession, d: str) -> DataFrame:
    """Share of time by state of each behaviour."""
    return state_shares(spark, d).select("key", "type", "value", _r("sec", 4).alias("sec"), _r("share").alias("share"))


@query("agg16", """WITH e AS (SELECT key, max("end") AS a FROM evidence GROUP BY key), g AS (SELECT key, max("end") AS b FROM gaze_events GROUP BY key), c AS (SELECT lower(trim(key)) AS k, max(clip_duration) AS c FROM hallucination_claims GROUP BY 1)
SELECT e.key, round(greatest(coalesce(a, 0), coalesce(b, 0), coalesce(c, 0)), 4) AS duration FROM e LEFT JOIN g ON e.key = g.key LEFT JOIN c ON lower(trim(e.key)) = c.k""")
def agg16(spark: SparkSession, d: str) -> DataFrame:
    """Duration of a clip: the largest of three sources."""
    e = table(spark, d, "evidence").groupBy("key").agg(F.max("end").alias("a"))
    g = table(spark, d, "gaze_events").groupBy("key").agg(F.max("end").alias("b"))
    c = table(spark, d, "hallucination_claims").groupBy(F.lower(F.trim("key")).alias("k")).agg(F.max("clip_duration").alias("c"))
    j = e.join(g, "key", "left").withColumn("k", F.lower(F.trim("key"))).join(c, "k", "left")
    return j.select("key", _r(F.greatest(*[F.coalesce(x, F.lit(0.0)) for x in "abc"]), 4).alias("duration"))


@query("agg17", f"""WITH {BEHAVIOURS} SELECT key, round(count(*) FILTER (value = 'eye_contact') / nullif(count(*) FILTER (value IN ('eye_contact', 'looking_away')), 0), 9) AS contact, round(stddev_pop(dur), 9) AS spread, round(avg(dur), 9) AS mean,
round(count(*) FILTER (value = 'no_face') / count(*), 9) AS no_face FROM behaviours WHERE type = 'gaze' GROUP BY key""")
def agg17(spark: SparkSession, d: str) -> DataFrame:
    """Gaze features: contact over contact and away, spread, mean, share without a face."""
    v = F.col("value")
    g = behaviours(spark, d).where("type = 'gaze'").groupBy("key")
    return g.agg(_r(F.try_divide(F.count_if(v == "eye_contact"), F.count_if(v.isin("eye_contact", "looking_away")))).alias("contact"), _r(F.stddev_pop("dur")).alias("spread"), _r(F.avg("dur")).alias("mean"), _r(F.count_if(v == "no_face") / F.count("*")).alias("no_face"))


@query("agg18", f"""WITH {BEHAVIOURS}, h AS (SELECT *, lag(start) OVER (PARTITION BY key ORDER BY start, evidence_id) AS p FROM behaviours WHERE type = 'hand')
SELECT key, round(count(*) FILTER (value <> 'hands_hidden') / count(*), 9) AS presence, round(avg(CASE WHEN start > p THEN dur / (start - p) END), 9) AS speed, round(stddev_pop(dur), 9) AS fidget FROM h GROUP BY key""")
def agg18(spark: SparkSession, d: str) -> DataFrame:
    """Hand features: presence, mean speed over positive steps, fidget."""
    h = previous(behaviours(spark, d).where("type = 'hand'"), ["key"], ["start", "evidence_id"], {"p": "start"})
    return h.groupBy("key").agg(_r(F.count_if(F.col("value") != "hands_hidden") / F.count("*")).alias("presence"), _r(F.avg(F.when(F.col("start") > F.col("p"), F.col("dur") / (F.col("start") - F.col("p"))))).alias("speed"), _r(F.stddev_pop("dur")).alias("fidget"))


@query("agg19", f"""WITH {BEHAVIOURS} SELECT key, round(sum(CASE WHEN value = 'smiling' THEN dur ELSE 0 END) / nullif(sum(dur), 0), 9) AS smile, round(avg(dur), 9) AS mean, round(stddev_pop(dur) + stddev_pop(start), 9) AS expressiveness FROM behaviours WHERE type = 'face' GROUP BY key""")
def agg19(spark: SparkSession, d: str) -> DataFrame:
    """Face features: smile share, mean, expressiveness as a sum of two spreads."""
    g = behaviours(spark, d).where("type = 'face'").groupBy("key")
    return g.agg(_r(F.try_divide(F.sum(F.when(F.col("value") == "smiling", F.col("dur")).otherwise(0.0)), F.sum("dur"))).alias("smile"), _r(F.avg("dur")).alias("mean"), _r(F.stddev_pop("dur") + F.stddev_pop("start")).alias("expressiveness"))


@query("agg20", f"""WITH {BEHAVIOURS}, h AS (SELECT key, dur, row_number() OVER (PARTITION BY key ORDER BY dur) AS r, count(*) OVER (PARTITION BY key) AS n FROM behaviours WHERE type = 'head'),
p AS (SELECT *, greatest(1.0, least(n, 0.25 * (n + 1))) AS p1, greatest(1.0, least(n, 0.75 * (n + 1))) AS p3 FROM h),
q AS (SELECT key, any_value(n) AS n, max(CASE WHEN r = floor(p1) THEN dur END) + (any_value(p1) - floor(any_value(p1))) * (max(CASE WHEN r = least(n, floor(p1) + 1) THEN dur END) - max(CASE WHEN r = floor(p1) THEN dur END)) AS q1,
 max(CASE WHEN r = floor(p3) THEN dur END) + (any_value(p3) - floor(any_value(p3))) * (max(CASE WHEN r = least(n, floor(p3) + 1) THEN dur END) - max(CASE WHEN r = floor(p3) THEN dur END)) AS q3 FROM p GROUP BY key)
SELECT h.key, round(any_value(q1), 9) AS q1, round(any_value(q3), 9) AS q3, round(median(dur), 9) AS middle, round(stddev_pop(dur) FILTER (dur BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 9) AS robust_sd, round(max(dur) - min(dur), 9) AS span FROM h JOIN q USING (key) GROUP BY h.key""")
def agg20(spark: SparkSession, d: str) -> DataFrame:
    """Head features: exclusive quartiles (position p (n + 1)), deviation within the whiskers, median, range."""
    h = numbered(behaviours(spark, d).where("type = 'head'").select("key", "dur"), ["key"], ["dur"], "r")
    n = h.groupBy("key").agg(F.count("*").alias("n"))
    at, parts = h.join(n, "key"), []
    for name, share in (("q1", 0.25), ("q3", 0.75)):
        p = F.greatest(F.lit(1.0), F.least(F.col("n").cast("double"), share * (F.col("n") + 1)))
        pick = lambda k: F.max(F.when(F.col("r") == k, F.col("dur")))
        low, high = pick(F.floor(p)), pick(F.least(F.col("n"), F.floor(p) + 1))
        parts.append((low + (F.max(p) - F.floor(F.max(p))) * (high - low)).alias(name))
    h = h.join(at.groupBy("key").agg(*parts), "key")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.when(F.col("dur").between(F.col("q1") - reach, F.col("q3") + reach), F.col("dur"))
    return h.groupBy("key").agg(_r(F.first("q1")).alias("q1"), _r(F.first("q3")).alias("q3"), _r(F.median("dur")).alias("middle"), _r(F.stddev_pop(inside)).alias("robust_sd"), _r(F.max("dur") - F.min("dur")).alias("span"))


FILLERS = ("um", "uh", "erm", "like", "well", "so", "actually", "basically", "honestly")


@query("agg21", f"""WITH w AS (SELECT DISTINCT evidence_id, key, start, "end", lower(trim(value, '.,!?"() ')) AS w FROM evidence WHERE type = 'word'),
g AS (SELECT *, start - lag("end") OVER (PARTITION BY key ORDER BY start, evidence_id) AS gap FROM w)
SELECT key, count(*) AS word_count, round(max("end"), 4) AS duration, round(count(*) / (max("end") / 60), 4) AS wpm, round(count(*) / (sum("end" - start) / 60), 4) AS articulation, count(*) FILTER (gap >= 0.5) AS pauses,
count(*) FILTER (gap >= 2.0) AS long_pauses, round(coalesce(sum(gap) FILTER (gap >= 0.5), 0), 4) AS pause_total, count(*) FILTER (w IN {FILLERS}) AS fillers, round(count(*) FILTER (w IN {FILLERS}) / count(*), 9) AS filler_ratio FROM g GROUP BY key HAVING max("end") > 0""")
def agg21(spark: SparkSession, d: str) -> DataFrame:
    """Speech features of each clip."""
    w = table(spark, d, "evidence").where("type = 'word'").select("evidence_id", "key", "start", "end", F.lower(F.expr("trim(BOTH '.,!?\"() ' FROM value)")).alias("w")).distinct()
    g = previous(w, ["key"], ["start", "evidence_id"], {"p": "end"}).withColumn("gap", F.col("start") - F.col("p"))
    long, filler = F.col("gap") >= 0.5, F.col("w").isin(*FILLERS)
    return g.groupBy("key").agg(
        F.count("*").alias("word_count"), _r(F.max("end"), 4).alias("duration"), _r(F.count("*") / (F.max("end") / 60), 4).alias("wpm"), _r(F.count("*") / (F.sum(F.col("end") - F.col("start")) / 60), 4).alias("articulation"),
        F.count_if(long).alias("pauses"), F.count_if(F.col("gap") >= 2.0).alias("long_pauses"), _r(F.coalesce(F.sum(F.when(long, F.col("gap"))), F.lit(0.0)), 4).alias("pause_total"), F.count_if(filler).alias("fillers"), _r(F.count_if(filler) / F.count("*")).alias("filler_ratio")).where("duration > 0")


@query("agg22", "SELECT user_id, round(avg(CASE WHEN value > 100 THEN value END), 9) AS pitch_mean, round(stddev_pop(CASE WHEN value > 100 THEN value END), 9) AS pitch_sd, round(count(*) FILTER (value < 50) / count(*), 9) AS silence FROM events GROUP BY 1")
def agg22(spark: SparkSession, d: str) -> DataFrame:
    """Conditional means and spreads of a signal."""
    v = F.when(F.col("value") > 100, F.col("value"))
    return table(spark, d, "events").groupBy("user_id").agg(_r(F.avg(v)).alias("pitch_mean"), _r(F.stddev_pop(v)).alias("pitch_sd"), _r(F.count_if(F.col("value") < 50) / F.count("*")).alias("silence"))


@query("agg23", """WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i, (vec_id % 3 + 1) AS w FROM embeddings), m AS (SELECT label, i, sum(v * w) / sum(w) AS m FROM x GROUP BY 1, 2)
SELECT label, CAST(i AS INTEGER) AS i, round(m / (sqrt(sum(m * m) OVER (PARTITION BY label)) + 1e-9), 9) AS v FROM m""")
def agg23(spark: SparkSession, d: str) -> DataFrame:
    """Weighted mean vector of each group, scaled to unit length."""
    x = table(spark, d, "embeddings").select("label", (F.col("vec_id") % 3 + 1).alias("w"), F.posexplode("embedding").alias("i", "v"))
    m = x.groupBy("label", "i").agg((F.sum(F.col("v").cast("double") * F.col("w")) / F.sum("w")).alias("m"))
    return m.select("label", "i", _r(F.col("m") / (F.sqrt(F.sum(F.col("m") * F.col("m")).over(Window.partitionBy("label"))) + 1e-9)).alias("v"))


@query("agg24", "SELECT l_orderkey, l_linenumber, round((0.20 * l_quantity + 0.15 * l_discount * 100 + 0.10 * l_tax * 100 + 0.15 * l_linenumber + 0.40 * least(l_extendedprice / 1000, 100)) / (0.20 + 0.15 + 0.10 + 0.15 + 0.40), 9) AS overall FROM lineitem")
def agg24(spark: SparkSession, d: str) -> DataFrame:
    """Weighted fusion of five scores, weights scaled to one."""
    s = {"eye_contact": F.col("l_quantity"), "head_pose": F.col("l_discount") * 100, "hand_gesture": F.col("l_tax") * 100, "facial_expression": F.col("l_linenumber").cast("double"), "answer_quality": F.least(F.col("l_extendedprice") / 1000, F.lit(100.0))}
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", _r(weighted_fusion(s)).alias("overall"))


@query("agg25", """WITH a AS (SELECT DISTINCT ON (audit_id) lower(trim(rater1_true_false)) IN ('true', 't', '1', 'yes', 'y') AS a, lower(trim(rater2_true_false)) IN ('true', 't', '1', 'yes', 'y') AS b FROM hallucination_audit_sample WHERE trim(rater1_true_false) <> '' AND trim(rater2_true_false) <> '')
SELECT a AS first_says, count(*) FILTER (b) AS second_true, count(*) FILTER (NOT b) AS second_false FROM a GROUP BY a""")
def agg25(spark: SparkSession, d: str) -> DataFrame:
    """Confusion matrix with fixed labels."""
    yes = lambda c: F.lower(F.trim(c)).isin("true", "t", "1", "yes", "y")
    a = table(spark, d, "hallucination_audit_sample").where("trim(rater1_true_false) <> '' AND trim(rater2_true_false) <> ''").dropDuplicates(["audit_id"]).select(yes("rater1_true_false").alias("first_says"), yes("rater2_true_false").alias("b"))
    return a.groupBy("first_says").agg(F.count_if("b").alias("second_true"), F.count_if(~F.col("b")).alias("second_false"))


@query("agg26", f"WITH {CLAIMS} SELECT lower(trim(key)) AS key, count(*) AS n, round(avg(CAST(verdict = 'supported' AS DOUBLE)), 9) AS correct, round(avg(CAST(topic = 'gaze' AS DOUBLE)), 9) AS gaze FROM c GROUP BY 1")
def agg26(spark: SparkSession, d: str) -> DataFrame:
    """Agreement by clip."""
    return claims(spark, d).groupBy(F.lower(F.trim("key")).alias("key")).agg(F.count("*").alias("n"), _r(F.avg((F.col("verdict") == "supported").cast("double"))).alias("correct"), _r(F.avg((F.col("topic") == "gaze").cast("double"))).alias("gaze"))


@query("agg27", f"WITH {POINTS}, m AS (SELECT feedback_id, count(*) AS n, round(avg(len(ids)), 9) AS ids, round(avg(length(issue)), 9) AS chars FROM pts GROUP BY 1) SELECT * FROM m")
def agg27(spark: SparkSession, d: str) -> DataFrame:
    """Measures of a feedback: points, ids and letters a point."""
    return points(spark, d).groupBy("feedback_id").agg(F.count("*").alias("n"), _r(F.avg(F.size("ids"))).alias("ids"), _r(F.avg(F.length("issue"))).alias("chars"))


@query("agg28", "SELECT approach, round(avg(coalesce(len(improvements), 0)), 9) AS points, count(DISTINCT key) AS clips FROM (SELECT DISTINCT ON (feedback_id) * FROM feedback) GROUP BY 1 ORDER BY CASE approach WHEN 'rule' THEN 0 WHEN 'grounded' THEN 1 ELSE 2 END, approach")
def agg28(spark: SparkSession, d: str) -> DataFrame:
    """Means by coach in a set order."""
    f = table(spark, d, "feedback").dropDuplicates(["feedback_id"]).groupBy("approach").agg(_r(F.avg(F.coalesce(F.nullif(F.size("improvements"), F.lit(-1)), F.lit(0)))).alias("points"), F.count_distinct("key").alias("clips"))
    return f.orderBy(F.when(F.col("approach") == "rule", 0).when(F.col("approach") == "grounded", 1).otherwise(2), "approach")


@query("agg29", "SELECT lang, keep, count(*) AS n FROM (SELECT DISTINCT ON (example_id) * FROM sft_train) GROUP BY 1, 2")
def agg29(spark: SparkSession, d: str) -> DataFrame:
    """Counts of pairs of values."""
    return table(spark, d, "sft_train").dropDuplicates(["example_id"]).groupBy("lang", "keep").agg(F.count("*").alias("n"))


BANDS = "CASE WHEN s >= 85 THEN 4 WHEN s >= 70 THEN 3 WHEN s >= 55 THEN 2 WHEN s >= 40 THEN 1 ELSE 0 END"


@query("agg30", f"WITH b AS (SELECT o_custkey, {BANDS} AS band FROM (SELECT o_custkey, o_totalprice / 5000 AS s FROM orders)) SELECT o_custkey, ['Priority', 'Needs Work', 'Fair', 'Good', 'Excellent'][CAST(round_even(avg(band), 0) AS INTEGER) + 1] AS band FROM b GROUP BY 1")
def agg30(spark: SparkSession, d: str) -> DataFrame:
    """Band of a session: the mean band index, rounded half to even."""
    from gleanstone.functions.scoring import band_index

    b = table(spark, d, "orders").select("o_custkey", band_index(F.col("o_totalprice") / 5000).alias("b")).groupBy("o_custkey").agg(F.bround(F.avg("b"), 0).cast("int").alias("i"))
    return b.select("o_custkey", F.get(F.array(*map(F.lit, ("Priority", "Needs Work", "Fair", "Good", "Excellent"))), F.col("i")).alias("band"))


@query("agg31", "SELECT p_mfgr, round(avg(p_size), 9) AS clarity, round(avg(p_retailprice), 9) AS usefulness FROM (SELECT substr(p_brand, 1, 7) AS p_mfgr, p_size, p_retailprice FROM part) GROUP BY 1")
def agg31(spark: SparkSession, d: str) -> DataFrame:
    """Average of a judge's scores by approach."""
    return table(spark, d, "part").groupBy(F.substring("p_brand", 1, 7).alias("p_mfgr")).agg(_r(F.avg("p_size")).alias("clarity"), _r(F.avg("p_retailprice")).alias("usefulness"))


@query("agg32", "SELECT l_orderkey, CAST(round_even(avg(l_quantity), 0) AS INTEGER) AS rating, round((avg(l_quantity) + avg(l_linenumber)) / 2, 9) AS overall FROM lineitem GROUP BY 1")
def agg32(spark: SparkSession, d: str) -> DataFrame:
    """Mean of raters, rounded half to even, and the mean over dimensions."""
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bround(F.avg("l_quantity"), 0).cast("int").alias("rating"), _r((F.avg("l_quantity") + F.avg("l_linenumber")) / 2).alias("overall"))


@query("agg33", f"WITH {BEHAVIOURS} SELECT key, count(*) FILTER (type = 'face') AS faces, count(*) FILTER (type = 'hand') AS hands, count(*) FILTER (type = 'head') AS heads FROM behaviours GROUP BY key")
def agg33(spark: SparkSession, d: str) -> DataFrame:
    """Detections of each kind by clip."""
    t = F.col("type")
    return behaviours(spark, d).groupBy("key").agg(F.count_if(t == "face").alias("faces"), F.count_if(t == "hand").alias("hands"), F.count_if(t == "head").alias("heads"))


@query("agg34", f"WITH {CLAIMS} SELECT approach, round(count(*) FILTER (verdict IN ('contradicted', 'unsupported')) / nullif(count(*) FILTER (verdict <> 'not_checkable'), 0), 9) AS rate FROM c WHERE lower(trim(key)) LIKE 'app%' GROUP BY approach")
def agg34(spark: SparkSession, d: str) -> DataFrame:
    """Rate of the documents of one kind of clip."""
    v = F.col("verdict")
    return claims(spark, d).where(F.lower(F.trim("key")).startswith("app")).groupBy("approach").agg(_r(F.try_divide(F.count_if(v.isin("contradicted", "unsupported")), F.count_if(v != "not_checkable"))).alias("rate"))


@query("agg35", "SELECT e.key, round(greatest(max(e.\"end\"), coalesce(max(m.dur), 0)), 4) AS duration FROM gaze_events e LEFT JOIN (SELECT key, max(\"end\") AS dur FROM evidence WHERE type = 'word' GROUP BY key) m ON e.key = m.key GROUP BY e.key")
def agg35(spark: SparkSession, d: str) -> DataFrame:
    """Length of a clip: last event or metadata."""
    m = table(spark, d, "evidence").where("type = 'word'").groupBy("key").agg(F.max("end").alias("dur"))
    g = table(spark, d, "gaze_events").groupBy("key").agg(F.max("end").alias("e"))
    return g.join(m, "key", "left").select("key", _r(F.greatest("e", F.coalesce("dur", F.lit(0.0))), 4).alias("duration"))


