"""Queries of the join operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanstone.functions.text import code_form
from gleanstone.operators.interval_join import overlap_join
from gleanstone.operators.ranking import global_row_number
from gleanstone.plans.base import BEHAVIOURS, behaviours, query
from gleanstone.session import table

ORDERS_BY_CUSTOMER = "o AS (SELECT o_custkey AS c_custkey, avg(o_totalprice) AS mean_price, count(*) AS n_clips FROM orders GROUP BY o_custkey)"


def orders_by_customer(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("mean_price"), F.count("*").alias("n_clips"))


@query("jn01", f"WITH {ORDERS_BY_CUSTOMER} SELECT c_custkey, round(mean_price, 4) AS mean_price, n_clips, c_acctbal FROM o JOIN customer USING (c_custkey) WHERE c_acctbal IS NOT NULL")
def jn01(spark: SparkSession, d: str) -> DataFrame:
    """Participant features with their labels."""
    return orders_by_customer(spark, d).join(table(spark, d, "customer"), "c_custkey").where("c_acctbal IS NOT NULL").select("c_custkey", F.round("mean_price", 4).alias("mean_price"), "n_clips", "c_acctbal")


@query("jn02", "SELECT o_orderkey, o_totalprice, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def jn02(spark: SparkSession, d: str) -> DataFrame:
    """Scores with labels."""
    return table(spark, d, "orders").join(table(spark, d, "customer").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey").select("o_orderkey", "o_totalprice", "c_mktsegment")


CLAIMS = "c AS (SELECT DISTINCT ON (claim_id) * FROM hallucination_claims)"


def claims(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hallucination_claims").dropDuplicates(["claim_id"])


@query("jn03", f"""WITH {CLAIMS}, k AS (SELECT DISTINCT key FROM evidence), v AS (SELECT lower(trim(key)) AS lk, count(*) AS n FROM c WHERE verdict = 'contradicted' GROUP BY 1)
SELECT k.key, coalesce(n, 0) AS contradicted FROM k LEFT JOIN v ON lower(trim(k.key)) = v.lk""")
def jn03(spark: SparkSession, d: str) -> DataFrame:
    """All clips with their count of contradicted claims, none counting as 0."""
    v = claims(spark, d).where("verdict = 'contradicted'").groupBy(F.lower(F.trim("key")).alias("lk")).agg(F.count("*").alias("n"))
    k = table(spark, d, "evidence").select("key").distinct().withColumn("lk", F.lower(F.trim("key")))
    return k.join(v, "lk", "left").select("key", F.coalesce("n", F.lit(0)).alias("contradicted"))


@query("jn04", """WITH a AS (SELECT DISTINCT ON (audit_id) * FROM hallucination_audit_sample), c AS (SELECT sentence, min(verdict) AS verdict, min(topic) AS topic FROM hallucination_claims GROUP BY sentence)
SELECT audit_id, rater1_id, verdict, topic FROM a JOIN c USING (sentence)""")
def jn04(spark: SparkSession, d: str) -> DataFrame:
    """Audit rows with the hidden key of their sentences."""
    c = table(spark, d, "hallucination_claims").groupBy("sentence").agg(F.min("verdict").alias("verdict"), F.min("topic").alias("topic"))
    return table(spark, d, "hallucination_audit_sample").dropDuplicates(["audit_id"]).join(c, "sentence").select("audit_id", "rater1_id", "verdict", "topic")


RATED = "r AS (SELECT DISTINCT item_id, rater_id, type FROM test_rq2_labels WHERE type IS NOT NULL)"


@query("jn05", f"WITH {RATED} SELECT a.item_id, a.rater_id AS rater_a, b.rater_id AS rater_b, a.type AS type_a, b.type AS type_b FROM r a JOIN r b ON a.item_id = b.item_id AND a.rater_id < b.rater_id")
def jn05(spark: SparkSession, d: str) -> DataFrame:
    """Two raters' labels of one item side by side."""
    r = table(spark, d, "test_rq2_labels").where("type IS NOT NULL").select("item_id", "rater_id", "type").distinct()
    a, b = r.withColumnsRenamed({"rater_id": "rater_a", "type": "type_a"}), r.withColumnsRenamed({"rater_id": "rater_b", "type": "type_b"})
    return a.join(b, "item_id").where("rater_a < rater_b").select("item_id", "rater_a", "rater_b", "type_a", "type_b")


@query("jn06", """WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS n FROM customer), b AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS n FROM orders)
SELECT n AS position, c_custkey, o_orderkey FROM a JOIN b USING (n)""")
def jn06(spark: SparkSession, d: str) -> DataFrame:
    """Two sheets joined by row position."""
    a = global_row_number(table(spark, d, "customer").select("c_custkey"), ["c_custkey"], "position")
    b = global_row_number(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"], "position")
    return a.join(b, "position")


@query("jn07", "SELECT p_partkey, p_size, s_acctbal FROM part JOIN supplier ON p_partkey = s_suppkey")
def jn07(spark: SparkSession, d: str) -> DataFrame:
    """Features with the targets of a sample, on their index."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("p_partkey"), "s_acctbal")
    return table(spark, d, "part").join(s, "p_partkey").select("p_partkey", "p_size", "s_acctbal")


@query("jn08", """SELECT c_custkey, c_acctbal, list_extract(embedding, 1) AS txt_0, s_acctbal AS rating FROM customer LEFT JOIN embeddings ON c_custkey = vec_id LEFT JOIN supplier ON c_custkey = s_suppkey""")
def jn08(spark: SparkSession, d: str) -> DataFrame:
    """Clip rows with an embedding and a rating where there are any."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("c_custkey"), F.get("embedding", F.lit(0)).alias("txt_0"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("rating"))
    return table(spark, d, "customer").select("c_custkey", "c_acctbal").join(e, "c_custkey", "left").join(s, "c_custkey", "left")


@query("jn09", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def jn09(spark: SparkSession, d: str) -> DataFrame:
    """Enrichment from small lookup tables; Catalyst broadcasts them by their size."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name", F.col("n_regionkey").alias("r_regionkey"))
    return table(spark, d, "customer").join(n, "c_nationkey", "left").join(table(spark, d, "region"), "r_regionkey", "left").select("c_custkey", "n_name", "r_name")


@query("jn10", f"WITH {ORDERS_BY_CUSTOMER}, l AS (SELECT o_custkey AS c_custkey, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1) SELECT c_custkey, n_clips, q AS quantity, c_acctbal FROM o JOIN l USING (c_custkey) JOIN customer USING (c_custkey)")
def jn10(spark: SparkSession, d: str) -> DataFrame:
    """Only those that all three tables know."""
    l = table(spark, d, "lineitem").join(table(spark, d, "orders").withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("l_quantity").alias("quantity"))  # noqa: E741
    return orders_by_customer(spark, d).join(l, "c_custkey").join(table(spark, d, "customer"), "c_custkey").select("c_custkey", "n_clips", "quantity", "c_acctbal")


@query("jn11", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def jn11(spark: SparkSession, d: str) -> DataFrame:
    """Semi join with a manifest of ids."""
    ids = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(ids, "o_custkey", "left_semi").select("o_orderkey", "o_custkey")


@query("jn12", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def jn12(spark: SparkSession, d: str) -> DataFrame:
    """Anti join: those not yet used."""
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


CLAIM_SPANS = f"""{CLAIMS}, s AS (SELECT claim_id, lower(trim(key)) AS k, topic, least(t0, coalesce(t1, t0)) AS a, greatest(t0, coalesce(t1, t0)) AS b FROM c WHERE t0 IS NOT NULL)"""


def claim_spans(spark: SparkSession, d: str) -> DataFrame:
    c = claims(spark, d).where("t0 IS NOT NULL")
    t1 = F.coalesce("t1", "t0")
    return c.select("claim_id", F.lower(F.trim("key")).alias("k"), "topic", "expected", F.least("t0", t1).alias("a_start"), F.greatest("t0", t1).alias("a_end"))


@query("jn13", f"""WITH {CLAIM_SPANS}, {BEHAVIOURS} SELECT claim_id, evidence_id FROM s JOIN behaviours e ON lower(trim(e.key)) = s.k AND e.type = s.topic AND e.start <= s.b + 1.0 AND e."end" >= s.a - 1.0""")
def jn13(spark: SparkSession, d: str) -> DataFrame:
    """Claims with the events of their topic that overlap them within a second."""
    e = behaviours(spark, d).select("evidence_id", F.lower(F.trim("key")).alias("k"), F.col("type").alias("topic"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    return overlap_join(claim_spans(spark, d), e, ["k", "topic"], 1.0, 10.0).select("claim_id", "evidence_id")


@query("jn14", f"""WITH {CLAIM_SPANS}, w AS (SELECT DISTINCT evidence_id, lower(trim(key)) AS k, start, "end" FROM evidence WHERE type = 'word')
SELECT claim_id, count(*) AS n_words FROM s JOIN w ON w.k = s.k AND w.start <= s.b + 3.0 AND w."end" >= s.a - 3.0 GROUP BY claim_id""")
def jn14(spark: SparkSession, d: str) -> DataFrame:
    """Words spoken within three tolerances of a claim."""
    w = table(spark, d, "evidence").where("type = 'word'").select("evidence_id", F.lower(F.trim("key")).alias("k"), F.col("start").alias("b_start"), F.col("end").alias("b_end")).distinct()
    return overlap_join(claim_spans(spark, d), w, ["k"], 3.0, 10.0).groupBy("claim_id").agg(F.count("*").alias("n_words"))


LABELS = "l AS (SELECT DISTINCT ON (label_id) * FROM test_rq2_labels), lab AS (SELECT label_id, lower(trim(clip)) AS clip, type, least(start, \"end\") AS a, greatest(start, \"end\") AS b FROM l WHERE type IS NOT NULL AND occurred)"
ALERTS = f"""{BEHAVIOURS}, alerts AS (SELECT evidence_id, lower(trim(key)) AS clip, CASE value WHEN 'looking_away' THEN 'look_away' WHEN 'turned_down' THEN 'head_down' WHEN 'turned_left' THEN 'head_left' WHEN 'turned_right' THEN 'head_right' WHEN 'hands_hidden' THEN 'hands_hidden' END AS type, start, "end"
  FROM behaviours WHERE value IN ('looking_away', 'turned_down', 'turned_left', 'turned_right', 'hands_hidden') AND dur >= 3.0)"""
ALERT_OF = {"looking_away": "look_away", "turned_down": "head_down", "turned_left": "head_left", "turned_right": "head_right", "hands_hidden": "hands_hidden"}


def staged(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "test_rq2_labels").dropDuplicates(["label_id"]).where("type IS NOT NULL AND occurred")  # noqa: E741
    return l.select("label_id", F.lower(F.trim("clip")).alias("clip"), "type", F.least("start", "end").alias("a_start"), F.greatest("start", "end").alias("a_end"))


def alerts(spark: SparkSession, d: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for kv in ALERT_OF.items() for x in kv])
    b = behaviours(spark, d).where(F.col("value").isin(*ALERT_OF) & (F.col("dur") >= 3.0))
    return b.select("evidence_id", F.lower(F.trim("key")).alias("clip"), names[F.col("value")].alias("type"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))


def matches(spark: SparkSession, d: str) -> DataFrame:
    """label_id, evidence_id: same clip and type, overlapping within two seconds or without a time on either side."""
    lab, al = staged(spark, d), alerts(spark, d)
    timed = overlap_join(lab.where("a_start IS NOT NULL"), al, ["clip", "type"], 2.0, 10.0).select("label_id", "evidence_id")
    whole = lab.where("a_start IS NULL").join(al, ["clip", "type"]).select("label_id", "evidence_id")
    return timed.unionByName(whole)


@query("jn15", f"WITH {LABELS}, {ALERTS} SELECT label_id, count(*) AS n_alerts FROM lab JOIN alerts e USING (clip, type) WHERE a IS NULL OR (e.start <= b + 2.0 AND e.\"end\" >= a - 2.0) GROUP BY label_id")
def jn15(spark: SparkSession, d: str) -> DataFrame:
    """Labels that some alert of their type meets; no time stands for the whole clip."""
    return matches(spark, d).groupBy("label_id").agg(F.count("*").alias("n_alerts"))


@query("jn16", f"""WITH {LABELS}, x AS (SELECT l.item_id, lab.* FROM lab JOIN l USING (label_id)) SELECT p.label_id AS label_a, q.label_id AS label_b, coalesce(p.a <= q.b + 2.0 AND p.b >= q.a - 2.0, true) AS overlap
FROM x p JOIN x q ON p.item_id = q.item_id AND p.label_id < q.label_id AND p.type = q.type""")
def jn16(spark: SparkSession, d: str) -> DataFrame:
    """Whether two annotators' times of one item overlap within two seconds."""
    items = table(spark, d, "test_rq2_labels").dropDuplicates(["label_id"]).select("label_id", "item_id")
    x = staged(spark, d).join(items, "label_id").select("item_id", "type", "label_id", "a_start", "a_end")
    y = x.withColumnsRenamed({"label_id": "label_b", "a_start": "c_start", "a_end": "c_end"})
    p = x.withColumnRenamed("label_id", "label_a").join(y, ["item_id", "type"]).where("label_a < label_b")
    return p.select("label_a", "label_b", F.coalesce((F.col("a_start") <= F.col("c_end") + 2.0) & (F.col("a_end") >= F.col("c_start") - 2.0), F.lit(True)).alias("overlap"))


POINTS = """f AS (SELECT DISTINCT ON (feedback_id) * FROM feedback), p AS (SELECT feedback_id, key, unnest(improvements) AS i, generate_subscripts(improvements, 1) AS n FROM f),
pts AS (SELECT feedback_id, key, n, i.dimension AS dimension, i.evidence_ids AS ids, i.issue_en AS issue FROM p WHERE i IS NOT NULL)"""


def points(spark: SparkSession, d: str) -> DataFrame:
    """One row for each improvement of each feedback: feedback_id, key, n (from 1), dimension, ids, issue."""
    f = table(spark, d, "feedback").dropDuplicates(["feedback_id"]).select("feedback_id", "key", F.posexplode("improvements").alias("p", "i")).where("i IS NOT NULL")
    return f.select("feedback_id", "key", (F.col("p") + 1).alias("n"), F.col("i.dimension").alias("dimension"), F.col("i.evidence_ids").alias("ids"), F.col("i.issue_en").alias("issue"))


@query("jn17", f"""WITH {POINTS}, c AS (SELECT feedback_id, n, unnest(ids) AS id FROM pts), known AS (SELECT DISTINCT 'E' || evidence_id AS id FROM evidence WHERE type = 'gaze')
SELECT feedback_id, CAST(n AS INTEGER) AS n, c.id, k.id IS NULL AS unknown FROM c LEFT JOIN known k ON c.id = k.id""")
def jn17(spark: SparkSession, d: str) -> DataFrame:
    """Cited ids with their log items; unknown ones stay visible."""
    known = table(spark, d, "evidence").where("type = 'gaze'").select(F.concat(F.lit("E"), F.col("evidence_id")).alias("id")).distinct().withColumn("hit", F.lit(True))
    c = points(spark, d).select("feedback_id", "n", F.explode("ids").alias("id"))
    return c.join(known, "id", "left").select("feedback_id", "n", "id", F.col("hit").isNull().alias("unknown"))


@query("jn18", f"""WITH {CLAIM_SPANS}, {BEHAVIOURS} SELECT claim_id, EXISTS (SELECT 1 FROM behaviours e WHERE lower(trim(e.key)) = s.k AND e.type = s.topic AND e.start <= s.b + 1.0 AND e."end" >= s.a - 1.0) AS matched FROM s""")
def jn18(spark: SparkSession, d: str) -> DataFrame:
    """Whether a claimed time falls into an item of its topic within a second."""
    hit = jn13(spark, d).select("claim_id").distinct().withColumn("hit", F.lit(True))
    return claim_spans(spark, d).join(hit, "claim_id", "left").select("claim_id", F.col("hit").isNotNull().alias("matched"))


@query("jn19", f"""WITH {CLAIM_SPANS}, {BEHAVIOURS} SELECT claim_id FROM s WHERE NOT EXISTS (SELECT 1 FROM behaviours e WHERE lower(trim(e.key)) = s.k AND e.type = s.topic AND e.start <= s.b + 1.0 AND e."end" >= s.a - 1.0)""")
def jn19(spark: SparkSession, d: str) -> DataFrame:
    """Claims whose time matches no item of their topic."""
    return claim_spans(spark, d).join(jn13(spark, d).select("claim_id").distinct(), "claim_id", "left_anti").select("claim_id")


WINDOWS = """c AS (SELECT key, max("end") AS dur FROM gaze_events GROUP BY key), win AS (SELECT key, unnest(generate_series(0, CAST(floor(dur / 2) AS BIGINT))) * 2.0::DOUBLE AS ws FROM c),
g AS (SELECT DISTINCT ON (event_id) event_id, key, regexp_replace(lower(trim(event)), '[ \\-]', '_', 'g') AS event, start, "end" FROM gaze_events WHERE event IS NOT NULL AND start < "end")"""


@query("jn20", f"""WITH {WINDOWS}, o AS (SELECT win.key, ws, event, sum(least("end", ws + 2) - greatest(start, ws)) AS ov FROM win JOIN g ON win.key = g.key AND start < ws + 2 AND "end" > ws GROUP BY 1, 2, 3)
SELECT key, ws AS start, arg_max(event, (round(ov, 6), event)) AS event, round(max(ov), 6) AS sec FROM o GROUP BY key, ws""")
def jn20(spark: SparkSession, d: str) -> DataFrame:
    """The state that fills most of each two-second window."""
    g = table(spark, d, "gaze_events").dropDuplicates(["event_id"]).where("event IS NOT NULL AND start < end").select("key", code_form(F.col("event")).alias("event"), "start", "end")
    g = g.withColumn("i", F.explode(F.sequence(F.floor(F.col("start") / 2), F.ceil(F.col("end") / 2) - 1))).withColumn("ws", F.col("i") * F.lit(2.0))
    o = g.groupBy("key", "ws", "event").agg(F.sum(F.least(F.col("end"), F.col("ws") + 2) - F.greatest("start", "ws")).alias("ov"))
    return o.groupBy("key", F.col("ws").alias("start")).agg(F.max_by("event", F.struct(F.round("ov", 6), "event")).alias("event"), F.round(F.max("ov"), 6).alias("sec"))


@query("jn21", "SELECT n_name, r_name FROM nation CROSS JOIN region")
def jn21(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of two vocabularies (languages and questions): the product is the result asked for."""
    return table(spark, d, "nation").select("n_name").crossJoin(table(spark, d, "region").select("r_name"))


@query("jn22", """WITH r AS (SELECT DISTINCT lower(trim(key)) AS k, approach FROM hallucination_claims WHERE key IS NOT NULL) SELECT a.k AS key, a.approach AS run_a, b.approach AS run_b FROM r a JOIN r b ON a.k = b.k AND a.approach < b.approach""")
def jn22(spark: SparkSession, d: str) -> DataFrame:
    """Unordered pairs of the runs of one clip; runs are a small vocabulary, clips many."""
    r = table(spark, d, "hallucination_claims").select(F.lower(F.trim("key")).alias("key"), "approach").distinct()
    return r.withColumnRenamed("approach", "run_a").join(r.withColumnRenamed("approach", "run_b"), "key").where("run_a < run_b")


@query("jn23")
def jn23(spark: SparkSession, d: str) -> DataFrame:
    """Improvements that repeat an earlier one of the same dimension, and the first that they repeat."""
    from gleanstone.functions.similarity import similarity

    p = points(spark, d).where("issue IS NOT NULL")
    q = p.select("feedback_id", "dimension", F.col("n").alias("earlier"), F.col("issue").alias("before"))
    pairs = p.join(q, ["feedback_id", "dimension"]).where("earlier < n").withColumn("ratio", similarity(F.lower("issue"), F.lower("before")))
    return pairs.where("ratio > 0.6").groupBy("feedback_id", "n").agg(F.min("earlier").alias("repeats"))


TOPIC_WORDS = ["eye", "head", "hand", "smil", "pause"]


@query("jn24", """WITH s AS (SELECT DISTINCT claim_id, sentence, position('second' IN sentence) AS pos FROM hallucination_claims WHERE position('second' IN sentence) > 0),
k AS (SELECT unnest(['eye', 'head', 'hand', 'smil', 'pause']) AS w, unnest([0, 1, 2, 3, 4]) AS o), m AS (SELECT claim_id, w, o, abs(position(w IN lower(sentence)) - pos) AS dist FROM s, k WHERE position(w IN lower(sentence)) > 0)
SELECT claim_id, arg_min(w, (dist, o)) AS topic, min(dist) AS distance FROM m GROUP BY claim_id""")
def jn24(spark: SparkSession, d: str) -> DataFrame:
    """The keyword nearest to a position; the first topic wins ties."""
    s = table(spark, d, "hallucination_claims").select("claim_id", "sentence").distinct().withColumn("pos", F.expr("position('second' IN sentence)")).where("pos > 0")
    words = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(i).alias("o")) for i, w in enumerate(TOPIC_WORDS)])
    m = s.withColumn("k", F.explode(words)).withColumn("at", F.expr("position(k.w IN lower(sentence))")).where("at > 0").withColumn("dist", F.abs(F.col("at") - F.col("pos")).cast("bigint"))
    return m.groupBy("claim_id").agg(F.min_by("k.w", F.struct("dist", "k.o")).alias("topic"), F.min("dist").alias("distance"))


@query("jn25", "SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, c_name FROM customer b WHERE NOT EXISTS (SELECT 1 FROM customer n WHERE n.c_custkey = b.c_custkey AND n.c_custkey % 3 <> 0)")
def jn25(spark: SparkSession, d: str) -> DataFrame:
    """A current table completed by the rows of a backup whose key it lacks."""
    backup = table(spark, d, "customer").select("c_custkey", "c_name")
    now = backup.where("c_custkey % 3 <> 0")
    return now.unionByName(backup.join(now.select("c_custkey"), "c_custkey", "left_anti"))


@query("jn26", "SELECT s.key, t.language, t.key IS NULL AS missing FROM (SELECT DISTINCT key FROM sft_train WHERE key IS NOT NULL) s LEFT JOIN (SELECT key, min(language) AS language FROM transcript GROUP BY key) t ON s.key = t.key")
def jn26(spark: SparkSession, d: str) -> DataFrame:
    """Lookup that keeps the misses."""
    t = table(spark, d, "transcript").groupBy("key").agg(F.min("language").alias("language")).withColumn("hit", F.lit(True))
    return table(spark, d, "sft_train").where("key IS NOT NULL").select("key").distinct().join(t, "key", "left").select("key", "language", F.col("hit").isNull().alias("missing"))


