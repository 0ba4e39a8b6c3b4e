"""The checker's whole report: every statement of a feedback against the log items that it cites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanstone.functions import claims as C
from gleanstone.functions.similarity import similarity
from gleanstone.operators.interval_join import overlap_join
from gleanstone.plans.base import query
from gleanstone.plans.checker import log_items, state_shares
from gleanstone.session import cut, table

ITEM = ["feedback_id", "section", "n"]
VISUAL = ["gaze", "head", "hand", "face"]
# Fixed values of the checker.
TOLERANCE, SHARE, MOST_IDS, MOST_CHARS, ALIKE, SPOKEN = 1.0, 0.25, 4, 320, 0.6, 0.6


def whole_log(spark: SparkSession, d: str) -> DataFrame:
    """The citable log: key, id, kind, type, value, start, end, text, share; summaries S, events E, pauses P, transcript lines T."""
    none = lambda kind: F.lit(None).cast(kind)
    e = log_items(spark, d).select("key", "id", F.when(F.col("type") == "pause", "pause").otherwise("event").alias("kind"), "type", "value", "start", "end", F.concat_ws(" ", "type", "value").alias("text"), none("map<string,double>").alias("share"))
    s = state_shares(spark, d).groupBy("key", "type").agg(F.map_from_entries(F.collect_list(F.struct("value", "share"))).alias("share"))
    order = F.array_position(F.array(*map(F.lit, VISUAL)), F.col("type"))
    s = s.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "type", F.map_entries("share").alias("share")))).alias("s"))  # four types at most
    s = s.select("key", F.posexplode("s").alias("i", "s")).select("key", F.concat(F.lit("S"), F.col("i") + 1).alias("id"), F.lit("summary").alias("kind"), "s.type", none("string").alias("value"), none("double").alias("start"), none("double").alias("end"), none("string").alias("text"), F.map_from_entries("s.share").alias("share"))
    t = table(spark, d, "transcript").where("key IS NOT NULL").dropDuplicates(["key"]).select("key", F.posexplode("segments").alias("i", "x")).where("trim(x.text) <> ''")
    t = t.select("key", F.concat(F.lit("T"), F.col("i") + 1).alias("id"), F.lit("transcript").alias("kind"), F.lit("transcript").alias("type"), none("string").alias("value"), "x.start", "x.end", F.trim("x.text").alias("text"), none("map<string,double>").alias("share"))
    return e.unionByName(s).unionByName(t)


def feedback_items(feedback: DataFrame) -> DataFrame:
    """feedback_id, key, section, n (from 0), dimension, ids, text, steps, others (texts in Thai) of every strength and improvement."""
    f = feedback.dropDuplicates(["feedback_id"])
    empty = F.array().cast("array<string>")
    cols = lambda section, text, steps, others: [F.lit(section).alias("section"), F.col("n"), F.col("i.dimension").alias("dimension"), F.col("i.evidence_ids").alias("ids"), F.col(text).alias("text"), steps.alias("steps"), F.filter(others, lambda x: x.isNotNull()).alias("others")]
    s = f.select("feedback_id", "key", F.posexplode("strengths").alias("n", "i")).where("i IS NOT NULL").select("feedback_id", "key", *cols("strengths", "i.text_en", empty, F.array("i.text_th")))
    steps = lambda c: F.coalesce(c, empty)
    i = f.select("feedback_id", "key", F.posexplode("improvements").alias("n", "i")).where("i IS NOT NULL")
    return s.unionByName(i.select("feedback_id", "key", *cols("improvements", "i.issue_en", steps(F.col("i.action_steps_en")), F.concat(F.array("i.issue_th"), steps(F.col("i.action_steps_th"))))))


def with_cited(items: DataFrame, log: DataFrame) -> DataFrame:
    """Items with ``video`` (cites the video), ``ids`` without it and ``cited``: the log's items of these ids, kind null where it has none."""
    clean = F.transform(F.filter(F.coalesce("ids", F.array().cast("array<string>")), lambda x: x.isNotNull()), lambda x: F.regexp_replace(F.trim(x), r"^\[+|\]+$", ""))
    items = items.withColumn("all", clean).withColumn("video", F.exists("all", lambda x: F.upper(x) == "VIDEO")).withColumn("ids", F.filter("all", lambda x: F.upper(x) != "VIDEO")).drop("all")
    one = items.select(*ITEM, "key", F.explode(F.array_distinct("ids")).alias("id")).join(log, ["key", "id"], "left")
    cited = one.groupBy(*ITEM).agg(F.collect_list(F.struct("id", "kind", "type", "value", "start", "end", "text", "share")).alias("cited"))
    return items.join(cited, ITEM, "left").withColumn("cited", F.coalesce("cited", F.array().cast(cited.schema["cited"].dataType)))


def _near(start: Column, end: Column, t0: Column, t1: Column) -> Column:
    return (start - TOLERANCE <= t1) & (end + TOLERANCE >= t0)


def item_problems(items: DataFrame, allow_video: bool = False) -> DataFrame:
    """feedback_id, section, n, problem of items as ``with_cited`` gives them; a code may come several times."""
    known = F.filter("cited", lambda c: c["kind"].isNotNull())
    x = items.withColumn("known", known).withColumn("said", C.plain_words(F.concat_ws(" ", F.transform(F.filter("cited", lambda c: c["kind"] == "transcript"), lambda c: c["text"]))))
    allowed = F.create_map(*[y for k, v in C.DIMENSION_SOURCES.items() for y in (F.lit(k), F.array(*map(F.lit, v)))])
    sources = F.try_element_at(allowed, F.col("dimension"))
    texts = F.filter(F.concat(F.array("text"), "steps", "others"), lambda t: t.isNotNull())
    code = lambda when, name: F.when(when, F.lit(name))
    nothing = F.size("known") == 0
    own = F.array(
        code((F.size("ids") == 0) & ~F.col("video"), "no_ids"), code(F.exists("cited", lambda c: c["kind"].isNull()), "unknown_id"), code(nothing & F.col("video") & F.lit(not allow_video), "no_video"),
        code(~nothing & sources.isNotNull() & ~F.exists("known", lambda c: F.array_contains(sources, c["type"])), "wrong_source"),
        code(F.size("ids") > MOST_IDS, "too_many_ids"), code(F.exists(texts, lambda t: F.regexp_count(t, F.lit(r"\b[SEPT]\d{1,3}\b")) > 2), "ids_in_text"), code(F.exists(texts, lambda t: F.length(t) > MOST_CHARS), "too_long"))
    out = [x.select(*ITEM, F.explode(F.filter(own, lambda p: p.isNotNull())).alias("problem"))]

    # one row for each sentence of what is said in English about the clip
    s = x.where("size(known) > 0").select(*ITEM, "dimension", "known", "said", F.explode(F.concat(F.array(F.struct(F.lit(False).alias("step"), F.col("text").alias("text"))), F.transform("steps", lambda t: F.struct(F.lit(True).alias("step"), t.alias("text"))))).alias("t")).where("t.text IS NOT NULL")
    s = s.select(*ITEM, "dimension", "known", "said", "t.step", F.explode(C.sentences_of(F.col("t.text"))).alias("sentence"))
    s = s.withColumn("topic", C.topic_at(F.col("sentence"), F.lit(0), F.col("dimension"))).withColumn("times", C.claimed_times(F.col("sentence")))
    out.append(s.where("topic = 'filler'").select(*ITEM, F.lit("filler").alias("problem")))
    s = s.where("topic IS NULL OR topic <> 'filler'")
    unsaid = F.exists(C.quotes(F.col("sentence"), 6), lambda q: C.quote_overlap(q, F.col("said")) < SPOKEN)
    out.append(s.where(unsaid).select(*ITEM, F.lit("quote").alias("problem")))
    whole = s.where("NOT step AND size(times) = 0").where(F.col("topic").isin(VISUAL)).withColumn("expected", C.expected_states(F.col("topic"), F.col("sentence"))).where("size(expected) > 0")
    total = lambda share: F.aggregate("expected", F.lit(0.0), lambda a, v: a + F.coalesce(F.try_element_at(share, v), F.lit(0.0)))
    out.append(whole.where(F.exists("known", lambda c: (c["kind"] == "summary") & (c["type"] == F.col("topic")) & (F.size(c["share"]) > 0) & (total(c["share"]) < SHARE))).select(*ITEM, F.lit("share").alias("problem")))
    t = s.select(*ITEM, "dimension", "known", "sentence", F.explode("times").alias("t"))
    t = t.withColumn("hit", F.filter("known", lambda c: (c["kind"] != "summary") & _near(c["start"], c["end"], F.col("t.t0"), F.col("t.t1"))))
    out.append(t.where("size(hit) = 0").select(*ITEM, F.lit("time_mismatch").alias("problem")))
    t = t.where("size(hit) > 0").withColumn("topic", C.topic_at(F.col("sentence"), F.col("t.pos"), F.col("dimension"))).where(F.col("topic").isin(VISUAL))
    t = t.withColumn("expected", C.expected_states(F.col("topic"), F.col("sentence"))).withColumn("same", F.filter("hit", lambda c: c["type"] == F.col("topic"))).where("size(expected) > 0 AND size(same) > 0")
    out.append(t.where(~F.exists("same", lambda c: F.coalesce(F.array_contains("expected", c["value"]), F.lit(False)))).select(*ITEM, F.lit("contradicted").alias("problem")))

    # an improvement that repeats an earlier one of the feedback
    i = x.where("section = 'improvements'").select("feedback_id", "n", "dimension", F.coalesce("text", F.lit("")).alias("text"))
    j = i.select("feedback_id", F.col("n").alias("earlier"), F.col("dimension").alias("of"), F.col("text").alias("before"))
    pairs = i.join(j, "feedback_id").where("earlier < n AND dimension <=> of").withColumn("ratio", similarity("before", "text"))
    out.append(pairs.where(F.col("ratio") > ALIKE).select("feedback_id", F.lit("improvements").alias("section"), "n", F.lit("duplicate").alias("problem")))
    return reduce(DataFrame.unionByName, out)


def text_problems(feedback: DataFrame, log: DataFrame) -> DataFrame:
    """feedback_id, section (summary, answer), n = 0, problem: times and fillers of summaries, invented numbers of answers."""
    f = feedback.dropDuplicates(["feedback_id"])
    s = f.where("overall_summary_en IS NOT NULL").select("feedback_id", "key", F.explode(C.sentences_of(F.col("overall_summary_en"))).alias("sentence"))
    of = lambda df, section, problem: df.select("feedback_id", F.lit(section).alias("section"), F.lit(0).alias("n"), F.lit(problem).alias("problem")).distinct()
    nobody = F.lit(None).cast("string")
    filler = of(s.where(C.topic_at(F.col("sentence"), F.lit(0), nobody) == "filler"), "summary", "filler")
    t = s.select("feedback_id", "key", "sentence", F.explode(C.claimed_times(F.col("sentence"))).alias("t"))
    t = t.select("feedback_id", "key", C.topic_at(F.col("sentence"), F.col("t.pos"), nobody).alias("topic"), F.col("t.t0").alias("a_start"), F.col("t.t1").alias("a_end")).distinct()
    e = log.where("kind <> 'summary' AND start IS NOT NULL").select("key", F.col("type").alias("b_type"), F.col("start").alias("b_start"), F.coalesce("end", "start").alias("b_end"))
    met = overlap_join(t, e, ["key"], TOLERANCE, 10.0).where("topic IS NULL OR topic = 'quote' OR topic = b_type").select("feedback_id", "topic", "a_start", "a_end").distinct()
    same = [t[c].eqNullSafe(met[c]) for c in ("feedback_id", "topic", "a_start", "a_end")]
    late = of(t.join(met, reduce(Column.__and__, same), "left_anti"), "summary", "time_mismatch")
    numbers = lambda c: F.regexp_extract_all(c, F.lit(C.NUMBER), F.lit(0))
    said = log.where("kind = 'transcript'").select("key", F.explode(numbers("text")).alias("number")).distinct()
    bare = F.regexp_replace(F.concat_ws(" \n ", "improved_answer.rewritten_en", "improved_answer.rewritten_th"), r"\[[^\]]*\]", " ")
    told = f.select("feedback_id", "key", F.explode(numbers(bare)).alias("number")).distinct()
    invented = of(told.join(said, ["key", "number"], "left_anti"), "answer", "invented_number")
    return filler.unionByName(late).unionByName(invented)


def report(feedback: DataFrame, log: DataFrame, allow_video: bool = False) -> DataFrame:
    """feedback_id, section, n, status, problems: one row for each strength and improvement, and one for each summary and answer with problems.

    ``status`` is failed where there are problems, else video_only (nothing but the video is cited,
    and that is allowed), ok+video or ok; ``problems`` are the different codes in order, joined by
    blanks. The log's items are looked up once; an item's sentences are read beside the items that
    it cites. Null sections, items and texts have no statements; an unknown clip has an empty log.
    """
    items = cut(with_cited(feedback_items(feedback), log))
    problems = item_problems(items, allow_video).unionByName(text_problems(feedback, log))
    problems = problems.groupBy(*ITEM).agg(F.array_join(F.array_sort(F.collect_set("problem")), " ").alias("problems"))
    status = F.when(F.col("problems").isNotNull(), "failed").when(~F.exists("cited", lambda c: c["kind"].isNotNull()), "video_only").when(F.col("video"), "ok+video").otherwise("ok")
    rows = items.join(problems, ITEM, "left").select(*ITEM, status.alias("status"), F.coalesce("problems", F.lit("")).alias("problems"))
    rest = problems.where("section IN ('summary', 'answer')").select(*ITEM, F.lit("failed").alias("status"), "problems")
    return rows.unionByName(rest)


def _one(spark: SparkSession, d: str, problem: str) -> DataFrame:
    items = cut(with_cited(feedback_items(table(spark, d, "feedback")), whole_log(spark, d)))
    return item_problems(items).where(F.col("problem") == problem).select(*ITEM).distinct()


@query("ver06")
def ver06(spark: SparkSession, d: str) -> DataFrame:
    """Points with a quotation of whose words under 60 % are in the cited transcript lines."""
    return _one(spark, d, "quote")


@query("ver07")
def ver07(spark: SparkSession, d: str) -> DataFrame:
    """Points that mention a time which no cited item covers within a second."""
    return _one(spark, d, "time_mismatch")


@query("ver08")
def ver08(spark: SparkSession, d: str) -> DataFrame:
    """Points whose cited items at a time show none of the states that the wording expects."""
    return _one(spark, d, "contradicted")


@query("ver11")
def ver11(spark: SparkSession, d: str) -> DataFrame:
    """Improvements that repeat an earlier one of the same feedback and dimension."""
    return _one(spark, d, "duplicate")


@query("ver12")
def ver12(spark: SparkSession, d: str) -> DataFrame:
    """Problems of summaries: times that no log item of the topic meets within a second, fillers."""
    return text_problems(table(spark, d, "feedback"), cut(whole_log(spark, d))).where("section = 'summary'").select("feedback_id", "problem")


@query("ver14_report")
def ver14_report(spark: SparkSession, d: str) -> DataFrame:
    """The checker's report on every feedback, with all its problem codes."""
    return report(table(spark, d, "feedback"), cut(whole_log(spark, d)))


@query("ver14_kept")
def ver14_kept(spark: SparkSession, d: str) -> DataFrame:
    """What is left of a feedback when failed points and an answer with invented facts are taken out."""
    r = ver14_report(spark, d)
    bad = F.col("status") == "failed"
    counts = [F.count_if((F.col("section") == s) & (bad if failed else ~bad)).alias(f"{s}_{'removed' if failed else 'kept'}") for s in ("strengths", "improvements") for failed in (False, True)]
    return r.groupBy("feedback_id").agg(*counts, F.coalesce(F.max(bad & (F.col("section") == "answer")), F.lit(False)).alias("answer_removed"))
