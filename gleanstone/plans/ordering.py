"""Queries of sorts, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanstone.plans.aggregates import SHARES, state_shares
from gleanstone.plans.base import BEHAVIOURS, behaviours, query
from gleanstone.plans.joins import CLAIMS, claims
from gleanstone.plans.windows import EPISODES, episodes
from gleanstone.session import table

GOOD = "('eye_contact', 'centered', 'hands_still', 'smiling')"


@query("top01", 'SELECT evidence_id, key, start, category, type FROM (SELECT DISTINCT ON (evidence_id) * FROM evidence) ORDER BY key, start, category, type, evidence_id')
def top01(spark: SparkSession, d: str) -> DataFrame:
    """The timeline in order of start, category and type."""
    return table(spark, d, "evidence").dropDuplicates(["evidence_id"]).select("evidence_id", "key", "start", "category", "type").orderBy("key", "start", "category", "type", "evidence_id")


@query("top02", EPISODES + " SELECT key, type, value, round(start, 3) AS start FROM ep ORDER BY key, start, type")
def top02(spark: SparkSession, d: str) -> DataFrame:
    """Episodes in order of start and type."""
    return episodes(spark, d).select("key", "type", "value", F.round("start", 3).alias("start")).orderBy("key", "start", "type")


@query("top03", EPISODES + f""", r AS (SELECT *, value IN {GOOD} AS good, row_number() OVER (PARTITION BY key, type, value IN {GOOD} ORDER BY dur DESC, start) AS n FROM ep)
SELECT key, type, value, good, round(start, 3) AS start, round(dur, 3) AS dur FROM r WHERE n <= CASE WHEN good THEN 2 ELSE 5 END""")
def top03(spark: SparkSession, d: str) -> DataFrame:
    """The five longest problem episodes and the two longest good ones of each behaviour."""
    w = Window.partitionBy("key", "type", "good").orderBy(F.desc("dur"), "start")
    e = episodes(spark, d).withColumn("good", F.expr(f"value IN {GOOD}")).withColumn("n", F.row_number().over(w))
    return e.where("n <= 5").where("n <= 2 OR NOT good").select("key", "type", "value", "good", F.round("start", 3).alias("start"), F.round("dur", 3).alias("dur"))


@query("top04", EPISODES + " SELECT key, round(max(dur), 3) AS dur, round(arg_max(start, (dur, -start)), 3) AS start FROM ep WHERE value IN ('looking_away', 'no_face') GROUP BY key")
def top04(spark: SparkSession, d: str) -> DataFrame:
    """The longest episode of given values, the first of equals."""
    e = episodes(spark, d).where("value IN ('looking_away', 'no_face')")
    return e.groupBy("key").agg(F.round(F.max("dur"), 3).alias("dur"), F.round(F.max_by("start", F.struct("dur", -F.col("start"))), 3).alias("start"))


@query("top05", SHARES + " SELECT key, type, string_agg(value, ' ' ORDER BY share DESC, value) AS ordered FROM shares GROUP BY key, type")
def top05(spark: SparkSession, d: str) -> DataFrame:
    """States of a behaviour by their share, the largest first."""
    g = state_shares(spark, d).groupBy("key", "type").agg(F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("s"), "value"))).alias("l"))
    return g.select("key", "type", F.array_join(F.col("l.value"), " ").alias("ordered"))


@query("top06", SHARES + " SELECT key, arg_max(value, (share, value)) AS dominant, round(max(share), 9) AS share FROM shares WHERE type = 'head' AND value <> 'centered' GROUP BY key")
def top06(spark: SparkSession, d: str) -> DataFrame:
    """The head position off centre with the largest share."""
    s = state_shares(spark, d).where("type = 'head' AND value <> 'centered'")
    return s.groupBy("key").agg(F.max_by("value", F.struct("share", "value")).alias("dominant"), F.round(F.max("share"), 9).alias("share"))


SEVERITY = "CASE verdict WHEN 'contradicted' THEN 0 WHEN 'unsupported' THEN 1 WHEN 'out_of_range' THEN 2 ELSE 3 END"


@query("top07", f"WITH {CLAIMS}, r AS (SELECT claim_id, lower(trim(key)) AS key, row_number() OVER (PARTITION BY lower(trim(key)) ORDER BY {SEVERITY}, dimension NULLS LAST, claim_id) AS n FROM c) SELECT key, claim_id, CAST(n AS INTEGER) AS n FROM r WHERE n <= 3")
def top07(spark: SparkSession, d: str) -> DataFrame:
    """The three gravest issues of each clip."""
    w = Window.partitionBy("key").orderBy("s", F.asc_nulls_last("dimension"), "claim_id")
    c = claims(spark, d).select("claim_id", F.lower(F.trim("key")).alias("key"), F.expr(SEVERITY).alias("s"), "dimension").withColumn("n", F.row_number().over(w))
    return c.where("n <= 3").select("key", "claim_id", "n")


@query("top08", """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS up, row_number() OVER (PARTITION BY vec_id ORDER BY v, i) AS down FROM x)
SELECT vec_id, string_agg(CAST(i AS VARCHAR), ' ' ORDER BY up) FILTER (up <= 2 AND v > 0.01) AS raised, string_agg(CAST(i AS VARCHAR), ' ' ORDER BY down) FILTER (down <= 2 AND v < -0.01) AS lowered FROM r GROUP BY vec_id""")
def top08(spark: SparkSession, d: str) -> DataFrame:
    """The two largest and two smallest contributions beyond a small cut."""
    x = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v, i: F.struct(v.cast("double").alias("v"), i.alias("i"))).alias("x"))
    pick = lambda s, keep: F.nullif(F.array_join(F.transform(F.slice(F.array_sort(F.transform(F.filter("x", keep), lambda y: F.struct((s * y["v"]).alias("k"), y["i"].alias("i")))), 1, 2), lambda y: y["i"]), " "), F.lit(""))
    return x.select("vec_id", pick(-1, lambda y: y["v"] > 0.01).alias("raised"), pick(1, lambda y: y["v"] < -0.01).alias("lowered"))


@query("top09", """WITH s AS (SELECT user_id, event_type, sum(value) AS v FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, event_type) AS n FROM s WHERE v > 3000)
SELECT u.user_id, coalesce(max(event_type) FILTER (n = 1), 'none') AS top, coalesce(max(event_type) FILTER (n = 2), 'none') AS second FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN r ON u.user_id = r.user_id GROUP BY 1""")
def top09(spark: SparkSession, d: str) -> DataFrame:
    """First and second issue above a threshold, else none."""
    s = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("v"))
    big = F.when(F.col("v") > 3000, F.struct((-F.col("v")).alias("v"), "event_type"))
    g = s.groupBy("user_id").agg(F.array_sort(F.collect_list(big)).alias("l"))
    return g.select("user_id", F.coalesce(F.get("l.event_type", F.lit(0)), F.lit("none")).alias("top"), F.coalesce(F.get("l.event_type", F.lit(1)), F.lit("none")).alias("second"))


@query("top10", "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 10")
def top10(spark: SparkSession, d: str) -> DataFrame:
    """The ten largest coefficients by size."""
    return table(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc(F.abs("c_acctbal")), "c_custkey").limit(10)


@query("top11", """WITH s AS (SELECT user_id, event_type, avg(value) / 2.5 AS score FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score, event_type) AS n FROM s WHERE score < 70)
SELECT user_id, event_type, round(score, 9) AS score FROM r WHERE n <= 2""")
def top11(spark: SparkSession, d: str) -> DataFrame:
    """The two weakest dimensions that are at most fair."""
    s = table(spark, d, "events").groupBy("user_id", "event_type").agg((F.avg("value") / 2.5).alias("score")).where("score < 70")
    return s.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("score", "event_type"))).where("n <= 2").select("user_id", "event_type", F.round("score", 9).alias("score"))


@query("top12", f"WITH {BEHAVIOURS} SELECT evidence_id, dur FROM behaviours WHERE type = 'head' ORDER BY abs(dur) DESC, evidence_id LIMIT 5")
def top12(spark: SparkSession, d: str) -> DataFrame:
    """The five frames of the largest angle."""
    return behaviours(spark, d).where("type = 'head'").select("evidence_id", "dur").orderBy(F.desc(F.abs("dur")), "evidence_id").limit(5)


@query("top13", "SELECT DISTINCT key FROM sft_train WHERE key LIKE 'app%' ORDER BY key DESC")
def top13(spark: SparkSession, d: str) -> DataFrame:
    """History, the latest key first."""
    return table(spark, d, "sft_train").where("key LIKE 'app%'").select("key").distinct().orderBy(F.desc("key"))


@query("top14", "SELECT s.key, g.key IS NOT NULL AS has_video FROM (SELECT DISTINCT key FROM evidence) s LEFT JOIN (SELECT DISTINCT key FROM transcript) g ON s.key = g.key ORDER BY has_video DESC, s.key")
def top14(spark: SparkSession, d: str) -> DataFrame:
    """Clips that have the other source first."""
    g = table(spark, d, "transcript").select("key").distinct().withColumn("hit", F.lit(True))
    return table(spark, d, "evidence").select("key").distinct().join(g, "key", "left").select("key", F.col("hit").isNotNull().alias("has_video")).orderBy(F.desc("has_video"), "key")


@query("top15", "SELECT p_brand, round(avg(p_retailprice), 9) AS cv_mean FROM part GROUP BY 1 ORDER BY cv_mean DESC, p_brand")
def top15(spark: SparkSession, d: str) -> DataFrame:
    """Models by their mean, the best first."""
    return table(spark, d, "part").groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 9).alias("cv_mean")).orderBy(F.desc("cv_mean"), "p_brand")


@query("top16", "SELECT doc_id, left(text, 80) AS head FROM documents WHERE text IS NOT NULL ORDER BY doc_id LIMIT 20")
def top16(spark: SparkSession, d: str) -> DataFrame:
    """A limit, and texts cut for display."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.left("text", F.lit(80)).alias("head")).orderBy("doc_id").limit(20)


@query("set01", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, 'customer' AS split FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL, 'supplier' FROM supplier")
def set01(spark: SparkSession, d: str) -> DataFrame:
    """Union of tables with unequal columns."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), F.lit("customer").alias("split"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("split"))
    return c.unionByName(s, allowMissingColumns=True)


@query("set02", """SELECT key, 'visual' AS category, type, start, value FROM (SELECT DISTINCT key, type, start, event AS value FROM gaze_events WHERE start IS NOT NULL) UNION ALL SELECT DISTINCT key, category, type, start, value FROM evidence WHERE type IN ('pause', 'word') AND start IS NOT NULL""")
def set02(spark: SparkSession, d: str) -> DataFrame:
    """Typed event streams united in one timeline."""
    g = table(spark, d, "gaze_events").where("start IS NOT NULL").select("key", F.lit("visual").alias("category"), "type", "start", F.col("event").alias("value")).distinct()
    return g.unionByName(table(spark, d, "evidence").where("type IN ('pause', 'word') AND start IS NOT NULL").select("key", "category", "type", "start", "value").distinct())


@query("set03", """SELECT 'union' AS op, k FROM (SELECT key AS k FROM transcript UNION SELECT key FROM sft_train) UNION ALL SELECT 'difference', k FROM (SELECT key AS k FROM transcript EXCEPT SELECT key FROM sft_train) UNION ALL SELECT 'intersection', k FROM (SELECT key AS k FROM transcript INTERSECT SELECT key FROM sft_train)""")
def set03(spark: SparkSession, d: str) -> DataFrame:
    """Union, difference and intersection of id sets."""
    a, b = (table(spark, d, t).select(F.col("key").alias("k")) for t in ("transcript", "sft_train"))
    parts = {"union": a.union(b).distinct(), "difference": a.subtract(b), "intersection": a.intersect(b)}
    u, v, w = (df.select(F.lit(name).alias("op"), "k") for name, df in parts.items())
    return u.unionByName(v).unionByName(w)


@query("set04", "SELECT key, arg_min(src, p) AS src FROM (SELECT DISTINCT key, 'intro' AS src, 0 AS p FROM transcript WHERE key LIKE 'own%' UNION ALL SELECT DISTINCT key, 'random', 1 FROM evidence) GROUP BY key")
def set04(spark: SparkSession, d: str) -> DataFrame:
    """Union of two sources in which the first one wins."""
    a = table(spark, d, "transcript").where("key LIKE 'own%'").select("key", F.lit("intro").alias("src"), F.lit(0).alias("p")).distinct()
    b = table(spark, d, "evidence").select("key", F.lit("random").alias("src"), F.lit(1).alias("p")).distinct()
    return a.unionByName(b).groupBy("key").agg(F.min_by("src", "p").alias("src"))


DIMS = "WITH x AS (SELECT DISTINCT lower(trim(key)) AS k, approach, dimension FROM hallucination_claims WHERE dimension IS NOT NULL)"


@query("set05", DIMS + """, a AS (SELECT k, approach, list_sort(list(dimension)) AS l FROM x GROUP BY 1, 2)
SELECT p.k AS key, p.approach AS run_a, q.approach AS run_b, round(len(list_intersect(p.l, q.l)) / len(list_distinct(list_concat(p.l, q.l))), 9) AS jaccard FROM a p JOIN a q ON p.k = q.k AND p.approach < q.approach""")
def set05(spark: SparkSession, d: str) -> DataFrame:
    """Jaccard index of the runs' dimension sets; two empty sets are equal."""
    x = table(spark, d, "hallucination_claims").where("dimension IS NOT NULL").groupBy(F.lower(F.trim("key")).alias("key"), "approach").agg(F.collect_set("dimension").alias("a"))
    y = x.withColumnsRenamed({"approach": "run_b", "a": "b"})
    size = F.size(F.array_union("a", "b"))
    return x.withColumnRenamed("approach", "run_a").join(y, "key").where("run_a < run_b").select("key", "run_a", "run_b", F.round(F.when(size == 0, 1.0).otherwise(F.size(F.array_intersect("a", "b")) / size), 9).alias("jaccard"))


@query("set06", "SELECT lower(trim(key)) AS key FROM hallucination_claims GROUP BY 1 HAVING count(DISTINCT approach) >= 3")
def set06(spark: SparkSession, d: str) -> DataFrame:
    """Keys that occur in enough runs."""
    return table(spark, d, "hallucination_claims").groupBy(F.lower(F.trim("key")).alias("key")).agg(F.count_distinct("approach").alias("n")).where("n >= 3").select("key")


@query("set07", "WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents WHERE text IS NOT NULL), f AS (SELECT doc_id, w, min(i) AS i FROM w GROUP BY 1, 2) SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS words FROM f GROUP BY 1")
def set07(spark: SparkSession, d: str) -> DataFrame:
    """Distinct words of a text in order of first occurrence."""
    w = F.array_distinct(F.split("text", " "))
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.size(w).cast("bigint").alias("n"), F.array_join(w, " ").alias("words"))
