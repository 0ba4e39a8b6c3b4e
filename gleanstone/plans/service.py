"""Queries of reports, model stores, signals and the pipelines' variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanstone.functions import external as X
from gleanstone.functions import scoring as G
from gleanstone.operators import regression as R
from gleanstone.plans.aggregates import agg21
from gleanstone.plans.base import BEHAVIOURS, behaviours, query
from gleanstone.plans.models import FEATURES, people
from gleanstone.plans.scans import PIPELINE, ctl01
from gleanstone.session import table
from gleanstone.sources import files as S


@query("src12", "SELECT p_partkey, round(CASE WHEN p_size % 2 = 0 THEN p_size / 4 ELSE p_retailprice / 100 END, 6) AS seconds FROM part")
def src12(spark: SparkSession, d: str) -> DataFrame:
    """Duration by a WAV header, else by metadata, else 0."""
    from gleanstone.functions.signal import wav_length

    le = lambda c: F.concat(*[F.expr(f"unhex(lpad(hex(({c} div {256**i}) % 256), 2, '0'))") for i in range(4)])
    head = F.concat(F.encode(F.lit("RIFF"), "UTF-8"), le("36"), F.encode(F.lit("WAVEfmt "), "UTF-8"), F.unhex(F.lit("100000000100010080BB00000077010002001000")), F.encode(F.lit("data"), "UTF-8"), le("p_size * 24000"))
    p = table(spark, d, "part").withColumn("wav", F.when(F.col("p_size") % 2 == 0, head))
    return p.select("p_partkey", F.round(F.coalesce(wav_length("wav"), F.col("p_retailprice") / 100, F.lit(0.0)), 6).alias("seconds"))


@query("src15", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS text FROM documents WHERE text IS NOT NULL")
def src15(spark: SparkSession, d: str) -> DataFrame:
    """Text of attachments by their kind, empty for kinds that can't be read."""
    t = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "bin").otherwise("txt").alias("kind"), F.encode("text", "UTF-8").alias("content"))
    return t.select("doc_id", F.when(F.col("kind") == "txt", F.decode("content", "UTF-8")).otherwise("").alias("text"))


@query("src16")
def src16(spark: SparkSession, d: str) -> DataFrame:
    """Signals as arrays of samples: one tone for each part."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 5 + 100).alias("hz"))
    return p.select("p_partkey", "hz", F.size(_tone()).alias("samples"))


def _tone():
    return F.transform(F.sequence(F.lit(0), F.lit(3999)), lambda i: 0.1 * F.sin(2 * 3.141592653589793 * F.col("hz") * i / 8000))


@query("ext07")
def ext07(spark: SparkSession, d: str) -> DataFrame:
    """Pitch, intensity and silence of each part's tone."""
    from gleanstone.functions.signal import prosody

    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 5 + 100).alias("hz"))
    m = p.select("p_partkey", "hz", prosody(_tone(), F.lit(8000)).alias("m"))
    return m.select("p_partkey", "hz", F.round("m.pitch_mean_hz", 1).alias("pitch"), F.round("m.intensity_mean_db", 1).alias("intensity"), F.round("m.silence_ratio", 3).alias("silence"))


@query("src19")
def src19(spark: SparkSession, d: str) -> DataFrame:
    """A model stored and loaded again gives the same scores."""
    p = people(spark, d)
    m = R.fit(p, "id", FEATURES, "target", 1.0)
    if m is None:
        return spark.createDataFrame([], "id bigint, score double, same boolean")
    place = S.shared_folder(spark, "model")
    spark.createDataFrame([(m.to_json(),)], "value string").write.text(place)
    again = R.Ridge.from_json(spark.read.text(place, wholetext=True).first()["value"].strip())
    return p.select("id", F.round(again.predict(), 6).alias("score"), (again.predict() == m.predict()).alias("same"))


@query("snk08", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' [' || upper(event_type) || '] user ' || user_id AS line FROM events")
def snk08(spark: SparkSession, d: str) -> DataFrame:
    """Log lines with their time."""
    return table(spark, d, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" ["), F.upper("event_type"), F.lit("] user "), "user_id").alias("line"))


TIMELINE = f"WITH {BEHAVIOURS}, m AS (SELECT key, max(\"end\") AS whole FROM behaviours GROUP BY key) SELECT evidence_id, round(60 + start / whole * 900, 4) AS x, round((\"end\" - start) / whole * 900, 4) AS width, CASE type WHEN 'gaze' THEN 10 WHEN 'head' THEN 34 WHEN 'hand' THEN 58 ELSE 82 END AS y FROM behaviours JOIN m USING (key) WHERE whole > 0"


@query("snk10", TIMELINE)
def snk10(spark: SparkSession, d: str) -> DataFrame:
    """Rectangles of a timeline drawing."""
    b = behaviours(spark, d)
    m = b.groupBy("key").agg(F.max("end").alias("whole")).where("whole > 0")
    t = F.col("type")
    return b.join(m, "key").select("evidence_id", F.round(60 + F.col("start") / F.col("whole") * 900, 4).alias("x"), F.round((F.col("end") - F.col("start")) / F.col("whole") * 900, 4).alias("width"), F.when(t == "gaze", 10).when(t == "head", 34).when(t == "hand", 58).otherwise(82).alias("y"))


@query("snk11", "SELECT 'latest' AS place, feedback_id FROM (SELECT DISTINCT feedback_id FROM feedback) UNION ALL SELECT 'history', feedback_id FROM (SELECT DISTINCT feedback_id FROM feedback)")
def snk11(spark: SparkSession, d: str) -> DataFrame:
    """One result written to two places."""
    f, place = table(spark, d, "feedback").select("feedback_id").distinct(), S.shared_folder(spark, "dual")
    for name in ("latest", "history"):
        f.write.parquet(f"{place}/place={name}")
    return spark.read.parquet(place).select(F.col("place").cast("string").alias("place"), "feedback_id")


@query("ext13", "SELECT approach, round(avg(least(10, 1 + len([x for x in regexp_split_to_array(coalesce(overall_summary_en, ''), '\\s+') if x <> '']) // 40)), 9) AS clarity FROM (SELECT DISTINCT ON (feedback_id) * FROM feedback) GROUP BY 1")
def ext13(spark: SparkSession, d: str) -> DataFrame:
    """A judge's mean score by approach, from the rater's stand-in."""
    f = table(spark, d, "feedback").dropDuplicates(["feedback_id"]).select("approach", F.coalesce("overall_summary_en", F.lit("")).alias("text"))
    r = X.apply_model(f, X.length_rater, "text", "answer", "string")
    return r.groupBy("approach").agg(F.round(F.avg(F.from_json("answer", "rating INT")["rating"]), 9).alias("clarity"))


@query("ext14", "SELECT CASE WHEN CAST('0x' || substr(md5(id), 1, 8) AS BIGINT) % 10 = 0 THEN 'val' ELSE 'train' END AS split, count(*) AS n FROM (SELECT DISTINCT ON (example_id) * FROM sft_train) WHERE id IS NOT NULL AND length(prompt) >= 10 GROUP BY 1")
def ext14(spark: SparkSession, d: str) -> DataFrame:
    """Examples generated, checked and split by a hash of the id."""
    s = table(spark, d, "sft_train").dropDuplicates(["example_id"]).where("id IS NOT NULL AND prompt IS NOT NULL").select("id", F.col("prompt").alias("text"))
    out = X.write_check_revise(s, lambda x: X.apply_model(x, _echo, "text", "written", "string"), lambda x: x.where("length(written) < 10"), "id")
    h = F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("bigint") % 10
    return out.groupBy(F.when(h == 0, "val").otherwise("train").alias("split")).agg(F.count("*").alias("n"))


def _echo():
    return lambda texts: list(texts)


@query("ext15", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS answer FROM events")
def ext15(spark: SparkSession, d: str) -> DataFrame:
    """A call that is tried three times; where it never passes its check the answer is null."""
    e = table(spark, d, "events").select("event_id", F.concat(F.col("event_id") % 3, F.lit(" "), "event_type").alias("text"))
    return X.apply_model(e, _flaky, "text", "answer", "string").select("event_id", "answer")


def _flaky():
    def call(x: str) -> str:
        n, word = x.split(" ", 1)
        if n == "0":
            raise RuntimeError("busy")
        return word

    safe = X.with_tries(call, bool)
    return lambda texts: [safe(t) for t in texts]


@query("coa08", "SELECT key, arg_min(approach, (CASE approach WHEN 'grounded' THEN 0 WHEN 'hybrid' THEN 1 ELSE 2 END, approach)) AS coach FROM feedback WHERE key IS NOT NULL AND improvements IS NOT NULL GROUP BY key")
def coa08(spark: SparkSession, d: str) -> DataFrame:
    """The coach whose feedback is there, by preference."""
    order = F.struct(F.when(F.col("approach") == "grounded", 0).when(F.col("approach") == "hybrid", 1).otherwise(2), "approach")
    return table(spark, d, "feedback").where("key IS NOT NULL AND improvements IS NOT NULL").groupBy("key").agg(F.min_by("approach", order).alias("coach"))


BODY = PIPELINE + " SELECT key, CASE WHEN overall >= 85 THEN 'Excellent' WHEN overall >= 70 THEN 'Good' WHEN overall >= 55 THEN 'Fair' WHEN overall >= 40 THEN 'Needs Work' ELSE 'Priority' END AS band, round(overall, 6) AS overall FROM f"


@query("coa09", f"SELECT key, '<h1>' || key || '</h1><p>' || band || '</p>' AS html FROM ({BODY})")
def coa09(spark: SparkSession, d: str) -> DataFrame:
    """A clip's report as HTML."""
    return ctl01(spark, d).select("key", F.concat(F.lit("<h1>"), "key", F.lit("</h1><p>"), "band", F.lit("</p>")).alias("html"))


_P, _K = G.piecewise_sql, G.KNOTS


@query("ctl02", "WITH w AS (SELECT DISTINCT evidence_id, key, start, \"end\", lower(trim(value, '.,!?\"() ')) AS w FROM evidence WHERE type = 'word'), g AS (SELECT *, start - lag(\"end\") OVER (PARTITION BY key ORDER BY start, evidence_id) AS gap FROM w), "
       "s AS (SELECT key, count(*) / (max(\"end\") / 60) AS wpm, count(*) FILTER (w IN ('um', 'uh', 'erm', 'like', 'well', 'so', 'actually', 'basically', 'honestly')) / count(*) AS fr, count(*) FILTER (gap >= 0.5) / (max(\"end\") / 60) AS ppm, count(*) FILTER (gap >= 2.0) / nullif(count(*) FILTER (gap >= 0.5), 0) AS lp FROM g GROUP BY key HAVING max(\"end\") > 0) "
       f"SELECT key, round(0.30 * ({_P('wpm', _K['wpm'])}) + 0.30 * ({_P('fr', _K['filler_ratio'])}) + 0.25 * ({_P('ppm', _K['pauses_per_min'])}) + 0.15 * ({_P('coalesce(lp, 0)', _K['long_pause_share'])}), 2) AS answer FROM s")  # fmt: skip
def ctl02(spark: SparkSession, d: str) -> DataFrame:
    """The speech-only pipeline: words to the answer score of each clip."""
    s = agg21(spark, d)
    minutes = F.col("duration") / 60
    p = lambda x, k: G.piecewise(x, G.KNOTS[k])
    score = 0.30 * p(F.col("wpm"), "wpm") + 0.30 * p(F.col("filler_ratio"), "filler_ratio") + 0.25 * p(F.col("pauses") / minutes, "pauses_per_min") + 0.15 * p(F.coalesce(F.try_divide("long_pauses", "pauses"), F.lit(0.0)), "long_pause_share")
    return s.select("key", F.round(score, 2).alias("answer"))


@query("ctl03", f"SELECT key, band, overall FROM ({BODY}) WHERE key LIKE 'rv_%'")
def ctl03(spark: SparkSession, d: str) -> DataFrame:
    """The pipeline on the second dataset's clips."""
    return ctl01(spark, d).where("key LIKE 'rv_%'").select("key", "band", "overall")


@query("ctl04", f"SELECT key, band, overall FROM ({BODY}) WHERE key = (SELECT min(key) FROM evidence WHERE key LIKE 'app%')")
def ctl04(spark: SparkSession, d: str) -> DataFrame:
    """The pipeline for one clip."""
    one = table(spark, d, "evidence").where("key LIKE 'app%'").agg(F.min("key").alias("key"))
    return ctl01(spark, d).join(one, "key", "left_semi").select("key", "band", "overall")


@query("ctl04b", "SELECT type AS step, count(DISTINCT key) AS clips FROM evidence GROUP BY 1 UNION ALL SELECT 'transcript file', count(DISTINCT key) FROM transcript")
def ctl04b(spark: SparkSession, d: str) -> DataFrame:
    """Which steps have output for how many clips."""
    e = table(spark, d, "evidence").groupBy(F.col("type").alias("step")).agg(F.count_distinct("key").alias("clips"))
    return e.unionByName(table(spark, d, "transcript").agg(F.lit("transcript file").alias("step"), F.count_distinct("key").alias("clips")))


@query("ctl09", "SELECT DISTINCT key FROM evidence WHERE key LIKE 'test%' AND key NOT IN (SELECT key FROM feedback WHERE key IS NOT NULL AND approach = 'rule')")
def ctl09(spark: SparkSession, d: str) -> DataFrame:
    """Clips of a run: only some, done ones skipped."""
    done = table(spark, d, "feedback").where("approach = 'rule'")
    return S.new_only(table(spark, d, "evidence").where("key LIKE 'test%'").select("key").distinct(), done, "key")


@query("ctl10", "SELECT approach, count(*) AS n, count(DISTINCT key) AS clips, count(*) FILTER (improvements IS NULL) AS failed FROM (SELECT DISTINCT ON (feedback_id) * FROM feedback) GROUP BY 1")
def ctl10(spark: SparkSession, d: str) -> DataFrame:
    """What each coach's batch produced."""
    f = table(spark, d, "feedback").dropDuplicates(["feedback_id"])
    return f.groupBy("approach").agg(F.count("*").alias("n"), F.count_distinct("key").alias("clips"), F.count_if(F.col("improvements").isNull()).alias("failed"))


@query("ctl12", "SELECT label, count(*) AS frames, round(avg(abs(embedding[1]::DOUBLE)), 6) AS mean_pitch, count(*) FILTER (abs(embedding[1]::DOUBLE) > 0.2) AS outliers FROM embeddings GROUP BY 1")
def ctl12(spark: SparkSession, d: str) -> DataFrame:
    """Diagnosis of poses: frames, mean size, outliers."""
    v = F.abs(F.get("embedding", F.lit(0)).cast("double"))
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("frames"), F.round(F.avg(v), 6).alias("mean_pitch"), F.count_if(v > 0.2).alias("outliers"))


@query("ctl15", "SELECT prompt_version, count(*) AS n, min(id) AS first_id FROM (SELECT DISTINCT ON (example_id) * FROM sft_train) GROUP BY 1")
def ctl15(spark: SparkSession, d: str) -> DataFrame:
    """Provenance: rows by the version that made them."""
    return table(spark, d, "sft_train").dropDuplicates(["example_id"]).groupBy("prompt_version").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
