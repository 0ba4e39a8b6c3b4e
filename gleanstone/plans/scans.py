"""Queries of sources, sinks, external models, streams and the whole pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanstone.functions import external as X
from gleanstone.functions import scoring as G
from gleanstone.plans.aggregates import SHARES, state_shares
from gleanstone.plans.base import FRAMES, epoch, frames, query
from gleanstone.plans.joins import CLAIMS, claims
from gleanstone.session import table
from gleanstone.sources import files as S
from gleanstone.streaming import states as St


def _through(df: DataFrame, name: str, fmt: str, **options) -> DataFrame:
    """``df`` written below the shared folder and read again with its schema."""
    place = S.shared_folder(df.sparkSession, name)
    df.write.options(**options).format(fmt).save(place)
    return df.sparkSession.read.schema(df.schema).options(**options).format(fmt).load(place)


@query("src01", "SELECT vec_id, len(embedding) AS points, round(list_max(embedding)::DOUBLE, 5) AS top FROM embeddings")
def src01(spark: SparkSession, d: str) -> DataFrame:
    """Landmark documents: written as JSON, scanned with their schema."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("key"), F.array(F.struct(F.lit(0.0).alias("timestamp"), F.transform("embedding", lambda x: F.struct(x.cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))).alias("face"))).alias("frames"))
    f = F.get("frames", F.lit(0))["face"]
    got = _through(e, "landmarks", "json")
    return got.select(F.col("key").cast("bigint").alias("vec_id"), F.size(f).cast("bigint").alias("points"), F.round(F.array_max(F.transform(f, lambda p: p["x"])), 5).alias("top"))


EVENT_DOCS = "ARRAY<STRUCT<type:STRING,start:DOUBLE,value:STRING>>"


@query("src02", "SELECT key, count(*) AS n FROM (SELECT DISTINCT evidence_id, key FROM evidence WHERE type = 'gaze') GROUP BY key")
def src02(spark: SparkSession, d: str) -> DataFrame:
    """Evidence documents: one JSON text for each clip, parsed leniently; corrupt ones count nothing."""
    g = table(spark, d, "evidence").where("type = 'gaze'").dropDuplicates(["evidence_id"]).groupBy("key").agg(F.to_json(F.collect_list(F.struct("type", "start", "value"))).alias("doc"))
    return g.select("key", F.size(F.from_json("doc", EVENT_DOCS, {"mode": "PERMISSIVE"})).cast("bigint").alias("n"))


@query("src03", "SELECT DISTINCT regexp_replace(key, '_(generic|personality)$', '') AS clip FROM evidence WHERE NOT regexp_matches(key, '_evidence$') ORDER BY clip")
def src03(spark: SparkSession, d: str) -> DataFrame:
    """Keys found by cutting known suffixes off."""
    return table(spark, d, "evidence").where(~F.col("key").rlike("_evidence$")).select(F.regexp_replace("key", "_(generic|personality)$", "").alias("clip")).distinct().orderBy("clip")


@query("src04", "SELECT DISTINCT key FROM (SELECT key FROM evidence UNION SELECT key FROM gaze_events UNION SELECT key FROM transcript) WHERE key IS NOT NULL")
def src04(spark: SparkSession, d: str) -> DataFrame:
    """Keys over several stores."""
    a, b, c = (table(spark, d, t).select("key") for t in ("evidence", "gaze_events", "transcript"))
    return a.union(b).union(c).where("key IS NOT NULL").distinct()


@query("src05", "SELECT c_custkey AS id, c_name AS name, CASE c_custkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM customer")
def src05(spark: SparkSession, d: str) -> DataFrame:
    """Label sheets of three splits, each a CSV with a header."""
    c, place = table(spark, d, "customer"), S.shared_folder(spark, "labels")
    names = {"train": 0, "val": 1, "test": 2}
    for n, k in names.items():
        c.where(F.col("c_custkey") % 3 == k).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).write.option("header", True).csv(f"{place}/{n}")
    return S.splits(spark, {n: f"{place}/{n}" for n in names}, "id BIGINT, name STRING")


@query("src06", "SELECT DISTINCT participant FROM (SELECT split_part(key, '_', 1) AS participant FROM sft_train WHERE key IS NOT NULL)")
def src06(spark: SparkSession, d: str) -> DataFrame:
    """Distinct ids of the manifests."""
    return table(spark, d, "sft_train").where("key IS NOT NULL").select(F.split_part("key", F.lit("_"), F.lit(1)).alias("participant")).distinct()


@query("src07", "SELECT doc_id, lang, length(text) AS letters FROM documents WHERE text IS NOT NULL")
def src07(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines."""
    return _through(table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "lang", "text"), "lines", "json").select("doc_id", "lang", F.length("text").cast("bigint").alias("letters"))


@query("src08", "SELECT example_id, prompt_version FROM (SELECT DISTINCT ON (example_id) * FROM sft_train)")
def src08(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines of synthetic answers."""
    return _through(table(spark, d, "sft_train").dropDuplicates(["example_id"]).select("example_id", "prompt_version"), "answers", "json")


@query("src09", "SELECT vec_id, label, len(embedding) AS size FROM embeddings")
def src09(spark: SparkSession, d: str) -> DataFrame:
    """The embedding store, Parquet with an array column."""
    return _through(table(spark, d, "embeddings"), "vectors", "parquet").select("vec_id", "label", F.size("embedding").cast("bigint").alias("size"))


@query("src10", "SELECT DISTINCT ON (label_id) label_id, CASE WHEN starts_with(trim(label, ' '), 'ก้ม') THEN 'head_down' WHEN starts_with(trim(label, ' '), 'หยุด') THEN 'long_pause' END AS type, occurred FROM test_rq2_labels")
def src10(spark: SparkSession, d: str) -> DataFrame:
    """A label sheet: codes by the beginning of the Thai label."""
    t = F.trim("label")
    return table(spark, d, "test_rq2_labels").dropDuplicates(["label_id"]).select("label_id", F.when(t.startswith("ก้ม"), "head_down").when(t.startswith("หยุด"), "long_pause").alias("type"), "occurred")


@query("src11", "SELECT key, arg_min(event_id, event_id) AS event_id FROM gaze_events GROUP BY key")
def src11(spark: SparkSession, d: str) -> DataFrame:
    """A clip list in which the first row of a clip counts."""
    return table(spark, d, "gaze_events").groupBy("key").agg(F.min("event_id").alias("event_id"))


@query("src14", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN round(p_size / 10, 6) WHEN p_size % 3 = 1 THEN round(p_retailprice / 1000, 6) ELSE round(16 / 9, 6) END AS aspect FROM part")
def src14(spark: SparkSession, d: str) -> DataFrame:
    """Frame aspect from metadata, else from the cache, else 16 : 9."""
    p = table(spark, d, "part")
    meta = p.where("p_size % 3 = 0").select("p_partkey", (F.col("p_size") / 10).alias("m"))
    cache = p.where("p_size % 3 = 1").select("p_partkey", (F.col("p_retailprice") / 1000).alias("c"))
    return p.select("p_partkey").join(meta, "p_partkey", "left").join(cache, "p_partkey", "left").select("p_partkey", F.round(F.coalesce("m", "c", F.lit(16 / 9)), 6).alias("aspect"))


@query("src17", "SELECT feedback_id, approach, len(improvements) AS n FROM (SELECT DISTINCT ON (feedback_id) * FROM feedback) WHERE improvements IS NOT NULL UNION ALL SELECT feedback_id, approach || '_draft', 0 FROM (SELECT DISTINCT ON (feedback_id) * FROM feedback) WHERE approach = 'grounded'")
def src17(spark: SparkSession, d: str) -> DataFrame:
    """Feedback of every approach, and drafts as an approach of their own."""
    f = table(spark, d, "feedback").dropDuplicates(["feedback_id"])
    a = f.where("improvements IS NOT NULL").select("feedback_id", "approach", F.size("improvements").cast("bigint").alias("n"))
    return a.unionByName(f.where("approach = 'grounded'").select("feedback_id", F.concat("approach", F.lit("_draft")).alias("approach"), F.lit(0).cast("bigint").alias("n")))


@query("src18", "SELECT event_id, value AS rating FROM events WHERE value IS NOT NULL AND value >= 1")
def src18(spark: SparkSession, d: str) -> DataFrame:
    """Ratings, only where they are numbers."""
    return table(spark, d, "events").where("value IS NOT NULL AND value >= 1").select("event_id", F.col("value").alias("rating"))


@query("src20", "SELECT type, label_en AS text, 'en' AS lang FROM label_vocab UNION ALL SELECT type, label_th, 'th' FROM label_vocab")
def src20(spark: SparkSession, d: str) -> DataFrame:
    """A bilingual bank as rows."""
    return table(spark, d, "label_vocab").unpivot("type", ["label_en", "label_th"], "lang", "text").select("type", "text", F.right("lang", F.lit(2)).alias("lang"))


@query("src21", "SELECT key, nullif(regexp_extract(key, '^([0-9a-f]{24})_q', 1), '') AS participant, count(*) AS rows FROM evidence WHERE regexp_matches(key, '^[0-9a-f]{24}_q') GROUP BY 1, 2")
def src21(spark: SparkSession, d: str) -> DataFrame:
    """Rows by clip and participant, other keys left out."""
    return table(spark, d, "evidence").where(F.col("key").rlike("^[0-9a-f]{24}_q")).groupBy("key", F.regexp_extract("key", "^([0-9a-f]{24})_q", 1).alias("participant")).agg(F.count("*").alias("rows"))


@query("src22", "SELECT approach, count(*) AS n, count(*) FILTER (improved_answer IS NULL) AS without FROM (SELECT DISTINCT ON (feedback_id) * FROM feedback) GROUP BY 1")
def src22(spark: SparkSession, d: str) -> DataFrame:
    """Documents and how many lack a part."""
    return table(spark, d, "feedback").dropDuplicates(["feedback_id"]).groupBy("approach").agg(F.count("*").alias("n"), F.count_if(F.col("improved_answer").isNull()).alias("without"))


@query("src23", "SELECT event_id, coalesce(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 5 END, 3) AS band FROM events")
def src23(spark: SparkSession, d: str) -> DataFrame:
    """Band numbers by label, 3 where it is unknown."""
    m = F.create_map(*[F.lit(x) for kv in {"view": 1, "click": 2, "purchase": 5}.items() for x in kv])
    return table(spark, d, "events").select("event_id", F.coalesce(F.try_element_at(m, F.col("event_type")), F.lit(3)).alias("band"))


@query("src24", 'SELECT e.key, round(max("end"), 4) AS duration, any_value(l.language) AS language FROM evidence e LEFT JOIN (SELECT key, min(language) AS language FROM transcript GROUP BY key) l ON e.key = l.key GROUP BY e.key')
def src24(spark: SparkSession, d: str) -> DataFrame:
    """Evidence with its duration."""
    l = table(spark, d, "transcript").groupBy("key").agg(F.min("language").alias("language"))  # noqa: E741
    return table(spark, d, "evidence").groupBy("key").agg(F.round(F.max("end"), 4).alias("duration")).join(l, "key", "left")


@query("src25", "SELECT DISTINCT approach, CASE WHEN regexp_matches(approach, '_(draft|video)$') THEN regexp_replace(approach, '_(draft|video)$', '') ELSE approach END AS base FROM hallucination_claims")
def src25(spark: SparkSession, d: str) -> DataFrame:
    """Run folders and their base."""
    return table(spark, d, "hallucination_claims").select("approach", F.regexp_replace("approach", "_(draft|video)$", "").alias("base")).distinct()


@query("src26", "SELECT k.key, count(*) FILTER (approach = 'rule') AS rule, count(*) FILTER (approach = 'mllm') AS mllm, count(*) FILTER (approach = 'hybrid') AS hybrid FROM (SELECT DISTINCT key FROM evidence) k LEFT JOIN (SELECT DISTINCT ON (feedback_id) * FROM feedback) f ON f.key = k.key GROUP BY 1")
def src26(spark: SparkSession, d: str) -> DataFrame:
    """Feedback of three approaches side by side, none where missing."""
    f = table(spark, d, "feedback").dropDuplicates(["feedback_id"]).groupBy("key").pivot("approach", ["rule", "mllm", "hybrid"]).count()
    return table(spark, d, "evidence").select("key").distinct().join(f, "key", "left").fillna(0)


@query("src27", "SELECT k.key, t.n AS segments, g.n AS gaze FROM (SELECT DISTINCT key FROM feedback WHERE key IS NOT NULL) k LEFT JOIN (SELECT key, max(len(segments)) AS n FROM transcript GROUP BY key) t ON t.key = k.key LEFT JOIN (SELECT key, count(DISTINCT event_id) AS n FROM gaze_events GROUP BY key) g ON g.key = k.key")
def src27(spark: SparkSession, d: str) -> DataFrame:
    """A report's parts joined to its key."""
    t = table(spark, d, "transcript").groupBy("key").agg(F.max(F.when(F.col("segments").isNotNull(), F.size("segments"))).cast("bigint").alias("segments"))
    g = table(spark, d, "gaze_events").groupBy("key").agg(F.count_distinct("event_id").alias("gaze"))
    return table(spark, d, "feedback").where("key IS NOT NULL").select("key").distinct().join(t, "key", "left").join(g, "key", "left")


@query("src28", "SELECT key, count(*) AS n FROM (SELECT DISTINCT ON (example_id) * FROM sft_train) WHERE key IN (SELECT key FROM transcript) GROUP BY key")
def src28(spark: SparkSession, d: str) -> DataFrame:
    """Rows of chosen clips."""
    return table(spark, d, "sft_train").dropDuplicates(["example_id"]).join(table(spark, d, "transcript").select("key"), "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"))


# sinks -------------------------------------------------------------------------------------------


@query("snk01", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def snk01(spark: SparkSession, d: str) -> DataFrame:
    """JSON partitioned by a column, read back with it."""
    o, place = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), S.shared_folder(spark, "json")
    o.write.partitionBy("o_orderstatus").json(place)
    return spark.read.schema(o.schema).json(place).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("snk02", "SELECT p_partkey, p_name, p_retailprice FROM part")
def snk02(spark: SparkSession, d: str) -> DataFrame:
    """CSV report with a header."""
    return _through(table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice"), "csv", "csv", header="true", escape='"')


@query("snk03", "SELECT count(*) AS n, count(*) FILTER (CAST('0x' || substr(md5(id), 1, 8) AS BIGINT) % 10 = 0) AS val FROM (SELECT DISTINCT ON (example_id) * FROM sft_train) WHERE keep AND id IS NOT NULL AND prompt IS NOT NULL")
def snk03(spark: SparkSession, d: str) -> DataFrame:
    """Chat lines by split, rows marked not to keep left out."""
    s = table(spark, d, "sft_train").dropDuplicates(["example_id"]).where("keep AND id IS NOT NULL AND prompt IS NOT NULL")
    s = s.withColumn("split", F.when(F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("bigint") % 10 == 0, "val").otherwise("train"))
    place = S.shared_folder(spark, "chat")
    S.chat_lines(s, "prompt", "lang").select("split", "value").write.partitionBy("split").text(place)
    return spark.read.text(place).agg(F.count("*").alias("n"), F.count_if(F.col("split") == "val").alias("val"))


@query("snk04", "SELECT lang, count(*) AS n FROM (SELECT DISTINCT ON (example_id) * FROM sft_train) s JOIN (SELECT DISTINCT example_id FROM feedback WHERE len(improvements) >= 2) f USING (example_id) GROUP BY 1")
def snk04(spark: SparkSession, d: str) -> DataFrame:
    """Export of pairs with enough items."""
    f = table(spark, d, "feedback").where("size(improvements) >= 2").select("example_id").distinct()
    return table(spark, d, "sft_train").dropDuplicates(["example_id"]).join(f, "example_id").groupBy("lang").agg(F.count("*").alias("n"))


@query("snk05", "SELECT vec_id, label FROM embeddings ORDER BY vec_id")
def snk05(spark: SparkSession, d: str) -> DataFrame:
    """The vector store, written in order of its keys."""
    return _through(table(spark, d, "embeddings").orderBy("vec_id"), "sorted", "parquet").select("vec_id", "label").orderBy("vec_id")


@query("snk06", "SELECT 'first' AS written, n_nationkey FROM nation UNION ALL SELECT 'second', n_nationkey FROM nation WHERE n_nationkey < 5")
def snk06(spark: SparkSession, d: str) -> DataFrame:
    """A second write leaves the first in place and goes beside it."""
    n, place = table(spark, d, "nation").select("n_nationkey"), S.shared_folder(spark, "sheet")
    a, b = S.write_once(n, place), S.write_once(n.where("n_nationkey < 5"), place)
    return spark.read.parquet(a).select(F.lit("first").alias("written"), "n_nationkey").unionByName(spark.read.parquet(b).select(F.lit("second").alias("written"), "n_nationkey"))


@query("snk07", "SELECT DISTINCT key FROM evidence WHERE key NOT IN (SELECT key FROM transcript WHERE key IS NOT NULL)")
def snk07(spark: SparkSession, d: str) -> DataFrame:
    """Keys still to do."""
    return S.new_only(table(spark, d, "evidence").select("key").distinct(), table(spark, d, "transcript"), "key")


@query("snk09", "SELECT approach, '## ' || approach || chr(10) || string_agg(CAST(n AS VARCHAR) || ' x ' || dimension, chr(10) ORDER BY dimension) AS report FROM (SELECT approach, dimension, count(DISTINCT claim_id) AS n FROM hallucination_claims WHERE dimension IS NOT NULL GROUP BY 1, 2) GROUP BY approach")
def snk09(spark: SparkSession, d: str) -> DataFrame:
    """Markdown report of each approach."""
    c = table(spark, d, "hallucination_claims").where("dimension IS NOT NULL").groupBy("approach", "dimension").agg(F.count_distinct("claim_id").alias("n"))
    g = c.groupBy("approach").agg(F.array_sort(F.collect_list(F.struct("dimension", F.concat("n", F.lit(" x "), "dimension").alias("line")))).alias("l"))
    return g.select("approach", F.concat(F.lit("## "), "approach", F.lit("\n"), F.array_join(F.col("l.line"), "\n")).alias("report"))


@query("snk12", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE 'old' END AS state FROM customer")
def snk12(spark: SparkSession, d: str) -> DataFrame:
    """Upsert by key."""
    old = table(spark, d, "customer").select("c_custkey", F.lit("old").alias("state"))
    return S.upsert(old, old.where("c_custkey % 4 = 0").select("c_custkey", F.lit("new").alias("state")), "c_custkey")


@query("snk13", "SELECT feedback_id, improved_answer.why_better_en AS why, 'skipped' AS snippet FROM (SELECT DISTINCT ON (feedback_id) * FROM feedback) WHERE improved_answer IS NOT NULL")
def snk13(spark: SparkSession, d: str) -> DataFrame:
    """A field of a stored document replaced."""
    f = table(spark, d, "feedback").dropDuplicates(["feedback_id"]).where("improved_answer IS NOT NULL").withColumn("improved_answer", F.col("improved_answer").withField("original_snippet", F.lit("skipped")))
    return f.select("feedback_id", F.col("improved_answer.why_better_en").alias("why"), F.col("improved_answer.original_snippet").alias("snippet"))


@query("snk14", "SELECT count(*) AS planned, count(t.key) AS there, count(*) - count(t.key) AS missing FROM (SELECT DISTINCT key FROM evidence) e LEFT JOIN (SELECT DISTINCT key FROM transcript) t ON e.key = t.key")
def snk14(spark: SparkSession, d: str) -> DataFrame:
    """Planned against existing files of a sample."""
    t = table(spark, d, "transcript").select("key").distinct().withColumn("hit", F.lit(1))
    return table(spark, d, "evidence").select("key").distinct().join(t, "key", "left").agg(F.count("*").alias("planned"), F.count("hit").alias("there"), F.count_if(F.col("hit").isNull()).alias("missing"))


# external models ---------------------------------------------------------------------------------


@query("ext03", "WITH v AS (SELECT p_partkey, p_size * 3 AS n, CASE WHEN p_size % 2 = 0 THEN 30.0 ELSE 15.0 END AS fps FROM part), s AS (SELECT *, greatest(1, CAST(round(fps / 10) AS INTEGER)) AS step FROM v) SELECT p_partkey, CAST(unnest(range(0, n, step)) AS INTEGER) AS frame FROM s")
def ext03(spark: SparkSession, d: str) -> DataFrame:
    """Frames kept of each video at a target rate."""
    v = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 3).alias("n"), F.when(F.col("p_size") % 2 == 0, 30.0).otherwise(15.0).alias("fps"))
    return X.sampled_frames(v, "n", "fps", 10.0).select("p_partkey", "frame")


@query("ext08")
def ext08(spark: SparkSession, d: str) -> DataFrame:
    """Sentence vectors of documents from the encoder's stand-in."""
    t = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")
    v = X.apply_model(t, X.hashed_encoder, "text", "vector", "array<double>")
    return v.select("doc_id", F.size("vector").alias("size"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x), 3).alias("norm"))


@query("ext09", "SELECT doc_id, CAST(least(10, 1 + len([x for x in regexp_split_to_array(text, '\\s+') if x <> '']) // 40) AS INTEGER) AS rating FROM documents WHERE text IS NOT NULL")
def ext09(spark: SparkSession, d: str) -> DataFrame:
    """Ratings as schema-constrained JSON from the rater's stand-in."""
    t = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")
    r = X.apply_model(t, X.length_rater, "text", "answer", "string")
    return r.select("doc_id", F.from_json("answer", "rating INT, reason STRING")["rating"].alias("rating"))


@query("ext10")
def ext10(spark: SparkSession, d: str) -> DataFrame:
    """Texts written by the writer's stand-in."""
    t = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")
    return X.apply_model(t, X.first_sentence, "text", "written", "string").select("doc_id", "written")


@query("ext12", "SELECT DISTINCT s.qid, coalesce(v.label_en, 'Tell me about yourself.') AS question FROM sft_train s LEFT JOIN label_vocab v ON v.type = s.qid WHERE s.qid IS NOT NULL")
def ext12(spark: SparkSession, d: str) -> DataFrame:
    """Questions with a fallback from the bank."""
    v = table(spark, d, "label_vocab").select(F.col("type").alias("qid"), "label_en")
    return table(spark, d, "sft_train").where("qid IS NOT NULL").select("qid").distinct().join(v, "qid", "left").select("qid", F.coalesce("label_en", F.lit("Tell me about yourself.")).alias("question"))


@query("ext16")
def ext16(spark: SparkSession, d: str) -> DataFrame:
    """Write, check, revise once, drop: drafts of documents, failing where nothing was written."""
    t = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")
    out = X.write_check_revise(t, lambda x: X.apply_model(x, X.first_sentence, "text", "written", "string"), lambda x: x.where("written IS NULL OR length(written) < 10"), "doc_id")
    return out.select("doc_id", "written")


@query("ext17", "SELECT feedback_id, n, dimension, CASE WHEN n % 2 = 1 THEN 'low' ELSE priority END AS priority, CASE WHEN n % 2 = 1 AND priority <> 'low' THEN priority END AS mismatch FROM (SELECT feedback_id, CAST(generate_subscripts(improvements, 1) AS INTEGER) AS n, unnest(improvements).dimension AS dimension, unnest(improvements).priority AS priority FROM (SELECT DISTINCT ON (feedback_id) * FROM feedback)) WHERE dimension IS NOT NULL")
def ext17(spark: SparkSession, d: str) -> DataFrame:
    """Measured values overwrite the model's copy, the difference is kept."""
    x = table(spark, d, "feedback").dropDuplicates(["feedback_id"]).select("feedback_id", F.posexplode("improvements").alias("p", "i")).where("i.dimension IS NOT NULL").select("feedback_id", (F.col("p") + 1).alias("n"), "i.dimension", "i.priority")
    measured = F.when(F.col("n") % 2 == 1, "low").otherwise(F.col("priority"))
    return x.select("feedback_id", "n", "dimension", measured.alias("priority"), F.when(F.col("priority") != measured, F.col("priority")).alias("mismatch"))


# streams -----------------------------------------------------------------------------------------


def _stream(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a stream of state frames, in files of one day's order."""
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), epoch("ts").alias("t"), F.col("event_type").alias("state"))
    place = S.shared_folder(spark, "stream")
    e.write.parquet(place)
    return spark.readStream.schema(e.schema).parquet(place)


@query("stm01", "SELECT event_id FROM events")
def stm01(spark: SparkSession, d: str) -> DataFrame:
    """Resumable batches: a stream of files taken in once, a second call adds nothing."""
    src, place = S.shared_folder(spark, "in"), S.shared_folder(spark, "resume")
    e = table(spark, d, "events").select("event_id")
    e.write.parquet(src)
    for _ in range(2):
        out = St.run_once(spark.readStream.schema(e.schema).parquet(src), place)
    return spark.read.parquet(out)


@query("stm02", f"WITH {FRAMES}, g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY key, state ORDER BY t) <= 43200 THEN 0 ELSE 1 END AS c FROM frames), s AS (SELECT *, sum(c) OVER (PARTITION BY key, state ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT CAST(key AS VARCHAR) AS key, state, round(min(t), 3) AS start, count(*) AS n FROM s GROUP BY key, state, s")
def stm02(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of one state with gaps of up to twelve hours."""
    f = frames(spark, d).select(F.col("key").cast("string").alias("key"), "state", F.timestamp_micros((F.col("t") * 1_000_000).cast("bigint")).alias("ts"))
    s = St.sessions(f, "12 hours 1 microsecond", "1 day")
    return s.select("key", "state", F.round(F.unix_micros("start") / 1_000_000, 3).alias("start"), "n")


@query("stm03")
def stm03(spark: SparkSession, d: str) -> DataFrame:
    """Run-length encoding with stored state, over a stream."""
    place = S.shared_folder(spark, "rle")
    return spark.read.schema(St.INTERVAL).parquet(St.run_once(St.stream_rle(_stream(spark, d).select("key", "t", "state")), place))


@query("stm05", f"WITH {FRAMES} SELECT CAST(key AS VARCHAR) AS key, state, CAST(floor(t / 172800) * 172800 AS DOUBLE) AS start, count(*) AS n FROM frames GROUP BY 1, 2, 3")
def stm05(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows of two days."""
    f = frames(spark, d).select(F.col("key").cast("string").alias("key"), "state", F.timestamp_micros((F.col("t") * 1_000_000).cast("bigint")).alias("ts"))
    return St.tumbling(f, "2 days", "1 day").select("key", "state", (F.unix_micros("start") / 1_000_000).alias("start"), "n")


# the pipeline ------------------------------------------------------------------------------------


PIPELINE = SHARES + f""", p AS (SELECT key, coalesce(max(share) FILTER (value = 'eye_contact'), 0) AS contact, coalesce(max(share) FILTER (value = 'gesturing'), 0) AS presence, coalesce(max(share) FILTER (value = 'smiling'), 0) AS smile FROM shares GROUP BY key),
s AS (SELECT key, {G.piecewise_sql('contact', G.KNOTS['contact'])} AS eye, {G.piecewise_sql('presence', G.KNOTS['hand_presence'])} AS hand, {G.piecewise_sql('smile', G.KNOTS['smile'])} AS face FROM p),
f AS (SELECT *, (0.2 * eye + 0.1 * hand + 0.15 * face) / 0.45 AS overall FROM s)"""


@query("ctl01", PIPELINE + " SELECT key, round(eye, 6) AS eye, round(hand, 6) AS hand, round(face, 6) AS face, round(overall, 6) AS overall, CASE WHEN overall >= 85 THEN 'Excellent' WHEN overall >= 70 THEN 'Good' WHEN overall >= 55 THEN 'Fair' WHEN overall >= 40 THEN 'Needs Work' ELSE 'Priority' END AS band FROM f")
def ctl01(spark: SparkSession, d: str) -> DataFrame:
    """The whole batch: evidence to shares, scores, fusion and band of each clip, in one lazy plan."""
    v, s = F.col("value"), F.col("share")
    share = lambda x: F.coalesce(F.max(F.when(v == x, s)), F.lit(0.0))
    p = state_shares(spark, d).groupBy("key").agg(share("eye_contact").alias("contact"), share("gesturing").alias("presence"), share("smiling").alias("smile"))
    eye, hand, face = (G.piecewise(F.col(c), G.KNOTS[k]) for c, k in (("contact", "contact"), ("presence", "hand_presence"), ("smile", "smile")))
    x = p.select("key", eye.alias("eye"), hand.alias("hand"), face.alias("face"))
    overall = G.weighted_fusion({"eye_contact": F.col("eye"), "hand_gesture": F.col("hand"), "facial_expression": F.col("face")})
    x = x.withColumn("overall", overall)
    return x.select("key", *[F.round(c, 6).alias(c) for c in ("eye", "hand", "face", "overall")], G.band(F.col("overall")).alias("band"))


@query("ctl05", "SELECT count(*) AS todo FROM (SELECT DISTINCT key FROM evidence WHERE key NOT IN (SELECT key FROM transcript WHERE key IS NOT NULL))")
def ctl05(spark: SparkSession, d: str) -> DataFrame:
    """What a resumed batch still has to do."""
    return snk07(spark, d).agg(F.count("*").alias("todo"))


@query("ctl14", f"WITH {CLAIMS} SELECT approach, count(*) AS n, min(claim_id) AS first, max(claim_id) AS last FROM c GROUP BY 1")
def ctl14(spark: SparkSession, d: str) -> DataFrame:
    """One row for each approach that ran."""
    return claims(spark, d).groupBy("approach").agg(F.count("*").alias("n"), F.min("claim_id").alias("first"), F.max("claim_id").alias("last"))


