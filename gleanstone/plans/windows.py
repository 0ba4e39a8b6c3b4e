"""Queries of the window and sequence operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanstone.operators import states as S
from gleanstone.operators.ranking import numbered, previous
from gleanstone.operators.run_scan import closed_runs
from gleanstone.plans.base import BEHAVIOURS, FRAMES, behaviours, frames, query
from gleanstone.session import table

HOUR = 3600.0

RLE = f"""WITH {FRAMES},
m AS (SELECT *, CASE WHEN state IS NOT DISTINCT FROM lag(state) OVER (PARTITION BY key ORDER BY t) THEN 0 ELSE 1 END AS n FROM frames),
i AS (SELECT *, sum(n) OVER (PARTITION BY key ORDER BY t ROWS UNBOUNDED PRECEDING) AS isl FROM m),
r AS (SELECT key, isl, any_value(state) AS state, min(t) AS start, max(t) AS last FROM i GROUP BY key, isl),
runs AS (SELECT key, state, start, coalesce(lead(start) OVER (PARTITION BY key ORDER BY start), last) AS "end" FROM r),
rle AS (SELECT *, "end" - start AS dur FROM runs)"""

REJOIN = """m2 AS (SELECT *, CASE WHEN state IS NOT DISTINCT FROM lag(state) OVER (PARTITION BY key ORDER BY start) THEN 0 ELSE 1 END AS n FROM changed),
i2 AS (SELECT *, sum(n) OVER (PARTITION BY key ORDER BY start ROWS UNBOUNDED PRECEDING) AS isl FROM m2),
out AS (SELECT key, any_value(state) AS state, min(start) AS start, max("end") AS "end", max("end") - min(start) AS dur FROM i2 GROUP BY key, isl)"""

COLS = 'SELECT key, state, round(start, 3) AS start, round("end", 3) AS "end", round(dur, 3) AS dur FROM '


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*(keys or ("key",)), "state", *[F.round(c, 3).alias(c) for c in ("start", "end", "dur")])


@query("win01", RLE + COLS + "rle")
def win01(spark: SparkSession, d: str) -> DataFrame:
    """Run-length encoding of states into intervals."""
    return _rounded(S.rle(frames(spark, d)))


@query("win02", RLE.replace("FROM events)", "FROM events WHERE event_type <> 'error')") + COLS + "rle")
def win02(spark: SparkSession, d: str) -> DataFrame:
    """Run-length encoding that skips frames of unknown state."""
    return _rounded(S.rle(frames(spark, d).where("state <> 'error'")))


SUPPRESS = RLE + f""", k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY start) AS rn, max("end") OVER (PARTITION BY key) AS last FROM rle),
kept AS (SELECT * FROM k WHERE rn = 1 OR dur >= {8 * HOUR}),
m2 AS (SELECT *, CASE WHEN state IS NOT DISTINCT FROM lag(state) OVER (PARTITION BY key ORDER BY start) THEN 0 ELSE 1 END AS n FROM kept),
i2 AS (SELECT *, sum(n) OVER (PARTITION BY key ORDER BY start ROWS UNBOUNDED PRECEDING) AS isl FROM m2),
g AS (SELECT key, any_value(state) AS state, min(start) AS start, max(last) AS last FROM i2 GROUP BY key, isl),
e AS (SELECT key, state, start, coalesce(lead(start) OVER (PARTITION BY key ORDER BY start), last) AS "end" FROM g),
out AS (SELECT *, "end" - start AS dur FROM e) """


@query("win03", SUPPRESS + COLS + "out")
def win03(spark: SparkSession, d: str) -> DataFrame:
    """Suppression of short intervals."""
    return _rounded(S.suppress_short(S.rle(frames(spark, d)), 8 * HOUR))


@query("win04", RLE + f""", changed AS (SELECT key, CASE WHEN state = 'error' AND dur < {12 * HOUR} THEN 'view' ELSE state END AS state, start, "end" FROM rle), {REJOIN} """ + COLS + "out")
def win04(spark: SparkSession, d: str) -> DataFrame:
    """Short intervals of one state relabelled, neighbours merged."""
    return _rounded(S.relabel_short(S.rle(frames(spark, d)), "error", "view", 12 * HOUR))


@query("win05", RLE + f""", b AS (SELECT *, last_value(CASE WHEN state <> 'error' THEN state END IGNORE NULLS) OVER (PARTITION BY key ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
  first_value(CASE WHEN state <> 'error' THEN state END IGNORE NULLS) OVER (PARTITION BY key ORDER BY start ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM rle),
changed AS (SELECT key, CASE WHEN state = 'error' AND dur >= {10 * HOUR} THEN 'away' WHEN state = 'error' THEN coalesce(prev, nxt, 'view') ELSE state END AS state, start, "end" FROM b), {REJOIN} """ + COLS + "out")
def win05(spark: SparkSession, d: str) -> DataFrame:
    """Blink resolution: short runs take the neighbour's state, long ones are a state of their own."""
    return _rounded(S.resolve_blinks(frames(spark, d), "error", "view", "away", 10 * HOUR))


def _merge_sql(source: str, gap: float, name: str) -> str:
    return f"""{name}_a AS (SELECT *, CASE WHEN value IS NOT DISTINCT FROM lag(value) OVER w THEN 0 ELSE 1 END AS n FROM {source} WINDOW w AS (PARTITION BY key, type ORDER BY start, "end", value)),
{name}_b AS (SELECT *, sum(n) OVER (PARTITION BY key, type ORDER BY start, "end", value ROWS UNBOUNDED PRECEDING) AS isl FROM {name}_a),
{name}_c AS (SELECT *, max("end") OVER (PARTITION BY key, type, isl ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {name}_b),
{name}_d AS (SELECT *, sum(CASE WHEN reach IS NULL OR start - reach > {gap} THEN 1 ELSE 0 END) OVER (PARTITION BY key, type, isl ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS part FROM {name}_c),
{name} AS (SELECT key, type, any_value(value) AS value, min(start) AS start, max("end") AS "end", max("end") - min(start) AS dur FROM {name}_d GROUP BY key, type, isl, part)"""


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return behaviours(spark, d).select("key", "type", "value", "start", "end", "dur").distinct()


SEGMENTS = f"{BEHAVIOURS}, seg AS (SELECT DISTINCT key, type, value, start, \"end\", dur FROM behaviours)"
EPISODES = f"WITH {SEGMENTS}, {_merge_sql('seg', 0.5, 'm1')}, long AS (SELECT * FROM m1 WHERE dur >= 1.0), {_merge_sql('long', 1.0, 'ep')}"


def episodes(spark: SparkSession, d: str) -> DataFrame:
    """Episodes of the visual evidence: merged at 0.5 s, at least 1 s, merged again at 1 s."""
    return S.episodes(_segments(spark, d), 1.0, 0.5, ["key", "type"], "value")


@query("win06", f"WITH {SEGMENTS}, {_merge_sql('seg', 0.5, 'm1')} SELECT key, type, value, round(start, 3) AS start, round(\"end\", 3) AS \"end\" FROM m1")
def win06(spark: SparkSession, d: str) -> DataFrame:
    """Merge of neighbours of one value over gaps of up to half a second."""
    return S.merge_gaps(_segments(spark, d), 0.5, ["key", "type"], "value").select("key", "type", "value", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"))


@query("win07", EPISODES + " SELECT key, type, value, round(start, 3) AS start, round(\"end\", 3) AS \"end\", round(dur, 3) AS dur FROM ep")
def win07(spark: SparkSession, d: str) -> DataFrame:
    """Episodes a viewer would notice."""
    return episodes(spark, d).select("key", "type", "value", *[F.round(c, 3).alias(c) for c in ("start", "end", "dur")])


WORDS = """words AS (SELECT DISTINCT evidence_id, key, start, "end", value FROM evidence WHERE type = 'word')"""


def words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evidence").where("type = 'word'").select("evidence_id", "key", "start", "end", "value").distinct()


@query("win08", f"""WITH {WORDS}, g AS (SELECT key, start, lag("end") OVER (PARTITION BY key ORDER BY start, evidence_id) AS prev FROM words)
SELECT key, round(coalesce(prev, 0.0), 3) AS start, round(start, 3) AS "end", round(start - coalesce(prev, 0.0), 3) AS pause, prev IS NULL AS leading, start - coalesce(prev, 0.0) >= 2.0 AS is_long FROM g WHERE start - coalesce(prev, 0.0) >= CASE WHEN prev IS NULL THEN 1.0 ELSE 0.5 END""")
def win08(spark: SparkSession, d: str) -> DataFrame:
    """Pauses between words of half a second or more, and leading silence of a second or more."""
    g = previous(words(spark, d), ["key"], ["start", "evidence_id"], {"prev": "end"}).withColumn("from", F.coalesce("prev", F.lit(0.0))).withColumn("gap", F.col("start") - F.col("from"))
    return g.where(F.col("gap") >= F.when(F.col("prev").isNull(), 1.0).otherwise(0.5)).select("key", F.round("from", 3).alias("start"), F.round("start", 3).alias("end"), F.round("gap", 3).alias("pause"), F.col("prev").isNull().alias("leading"), (F.col("gap") >= 2.0).alias("is_long"))


@query("win09", f"""WITH {FRAMES}, g AS (SELECT key, event_id, value, t, lag(value) OVER (PARTITION BY key ORDER BY t) AS pv, lag(t) OVER (PARTITION BY key ORDER BY t) AS pt FROM frames)
SELECT key, event_id, CASE WHEN t - pt > 0 AND t - pt < 86400 THEN round(abs(value - pv) / ((t - pt) / 3600), 6) END AS speed FROM g""")
def win09(spark: SparkSession, d: str) -> DataFrame:
    """Speed from frame to frame, only where the step in time is positive and short."""
    g = previous(frames(spark, d), ["key"], ["t"], {"pt": "t", "pv": "value"}).withColumn("dt", F.col("t") - F.col("pt")).withColumn("dv", F.abs(F.col("value") - F.col("pv")))
    return g.select("key", "event_id", F.when((F.col("dt") > 0) & (F.col("dt") < 86400), F.round(F.col("dv") / (F.col("dt") / 3600), 6)).alias("speed"))


@query("win10", f"""WITH {FRAMES}, n AS (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM frames)
SELECT key, event_id, round(CASE WHEN n < 5 THEN value ELSE median(value) OVER (PARTITION BY key ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) END, 6) AS smooth FROM n""")
def win10(spark: SparkSession, d: str) -> DataFrame:
    """Centred moving median of five frames, shrinking at the edges; short series stay.

    Every frame goes to the five positions whose window it is in.
    """
    f = numbered(frames(spark, d), ["key"], ["t"], "n").select("key", "event_id", "value", "n")
    at = f.select("key", "value", F.explode(F.sequence(F.col("n") - 2, F.col("n") + 2)).alias("n")).groupBy("key", "n").agg(F.median("value").alias("m"))
    size = f.groupBy("key").agg(F.count("*").alias("size"))
    return f.join(at, ["key", "n"]).join(size, "key").select("key", "event_id", F.round(F.when(F.col("size") < 5, F.col("value")).otherwise(F.col("m")), 6).alias("smooth"))


@query("win11", f"""WITH {FRAMES}, q AS (SELECT *, value < greatest(50, avg(value) OVER (PARTITION BY key) - 15) AS quiet FROM frames),
m AS (SELECT *, CASE WHEN quiet IS NOT DISTINCT FROM lag(quiet) OVER (PARTITION BY key ORDER BY t) THEN 0 ELSE 1 END AS n FROM q),
i AS (SELECT *, sum(n) OVER (PARTITION BY key ORDER BY t ROWS UNBOUNDED PRECEDING) AS isl FROM m)
SELECT key, round(min(t), 3) AS start, round(max(t), 3) AS "end", count(*) AS n FROM i WHERE quiet GROUP BY key, isl HAVING max(t) - min(t) >= 1800""")
def win11(spark: SparkSession, d: str) -> DataFrame:
    """Islands of values under an adaptive threshold."""
    f = frames(spark, d)
    mean = f.groupBy("key").agg(F.avg("value").alias("mean"))
    q = f.join(mean, "key").select("key", "t", (F.col("value") < F.greatest(F.lit(50.0), F.col("mean") - 15)).cast("string").alias("state"))
    runs = closed_runs(q, ["key"], "state", "t", "t").where("state = 'true' AND dur >= 1800")
    n = q.where("state = 'true'").join(runs.withColumnRenamed("key", "k"), (F.col("key") == F.col("k")) & F.col("t").between(F.col("start"), F.col("end")))
    return n.groupBy("key", F.round("start", 3).alias("start"), F.round("end", 3).alias("end")).agg(F.count("*").alias("n"))


@query("win12", EPISODES + """ , a AS (SELECT 'E' AS p, key, type, value, start FROM ep UNION ALL SELECT DISTINCT 'P', key, type, value, start FROM evidence WHERE type = 'pause' AND start IS NOT NULL)
SELECT key, type, value, round(start, 3) AS start, p || row_number() OVER (PARTITION BY key, p ORDER BY start, type, value) AS id FROM a""")
def win12(spark: SparkSession, d: str) -> DataFrame:
    """Ids of episodes (E1 ...) and pauses (P1 ...) in order of start and type."""
    p = table(spark, d, "evidence").where("type = 'pause' AND start IS NOT NULL").select("key", "type", "value", "start").distinct().withColumn("p", F.lit("P"))
    a = episodes(spark, d).select("key", "type", "value", "start", F.lit("E").alias("p")).unionByName(p)
    return numbered(a, ["key", "p"], ["start", "type", "value"], "n").select("key", "type", "value", F.round("start", 3).alias("start"), F.concat("p", "n").alias("id"))


@query("win13", """SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS first_rank, rank() OVER (ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_acctbal) - 1) / 2 AS average_rank,
row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS segment_rank FROM customer""")
def win13(spark: SparkSession, d: str) -> DataFrame:
    """Ranks by first occurrence, averaged over ties, and descending in groups."""
    from gleanstone.operators.ranking import average_rank, global_row_number

    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    c = numbered(c, ["c_mktsegment"], ["-c_acctbal", "c_custkey"], "segment_rank")
    out = average_rank(global_row_number(c, ["c_acctbal", "c_custkey"], "first_rank"), "c_acctbal", "average_rank")
    return out.select("c_custkey", "first_rank", "average_rank", "segment_rank")


@query("win14", """WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS r, count(*) OVER () AS n FROM customer)
SELECT c_custkey, CAST(greatest(ceil((r - 1) * 5 / (n - 1)) - 1, 0) AS INTEGER) AS stratum FROM r""")
def win14(spark: SparkSession, d: str) -> DataFrame:
    """Five quantile bins of the rank (edges 1 + (n - 1) k / 5, closed on the right)."""
    from gleanstone.operators.ranking import quantile_bins

    return quantile_bins(table(spark, d, "customer"), ["c_acctbal", "c_custkey"], 5, "stratum").select("c_custkey", "stratum")


@query("win15", f"""WITH {WORDS} SELECT key, arg_min(value, (start, evidence_id)) AS first_word, arg_max(value, (start, evidence_id)) AS last_word, round(max("end") - min(start), 3) AS span,
round(count(*) / ((max("end") - min(start)) / 60), 3) AS wpm FROM words GROUP BY key HAVING max("end") > min(start)""")
def win15(spark: SparkSession, d: str) -> DataFrame:
    """First and last word, spoken span and words a minute."""
    at = F.struct("start", "evidence_id")
    g = words(spark, d).groupBy("key").agg(F.min_by("value", at).alias("first_word"), F.max_by("value", at).alias("last_word"), (F.max("end") - F.min("start")).alias("s"), F.count("*").alias("n")).where("s > 0")
    return g.select("key", "first_word", "last_word", F.round("s", 3).alias("span"), F.round(F.col("n") / (F.col("s") / 60), 3).alias("wpm"))


@query("win16", """WITH w AS (SELECT doc_id, unnest([x for x in regexp_split_to_array(text, '[ \\n\\t]+') if x <> '']) AS w, generate_subscripts([x for x in regexp_split_to_array(text, '[ \\n\\t]+') if x <> ''], 1) - 1 AS i FROM documents)
SELECT doc_id, CAST(i // 180 AS INTEGER) AS chunk, CAST(count(*) AS INTEGER) AS n_words, string_agg(w, ' ' ORDER BY i) AS text FROM w GROUP BY doc_id, i // 180""")
def win16(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of 180 words."""
    w = F.filter(F.split("text", "[ \\n\\t]+"), lambda x: x != "")
    t = table(spark, d, "documents").select("doc_id", w.alias("w")).where("size(w) > 0")
    t = t.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.floor((F.size("w") - 1) / 180).cast("int"))).alias("chunk"))
    part = F.slice("w", F.col("chunk") * 180 + 1, 180)
    return t.select("doc_id", "chunk", F.size(part).alias("n_words"), F.array_join(part, " ").alias("text"))


@query("win17", """WITH c AS (SELECT key, max("end") AS dur FROM gaze_events GROUP BY key), w AS (SELECT key, dur, unnest(generate_series(0, CAST(floor(dur / 2) AS BIGINT))) * 2.0 AS s FROM c)
SELECT key, CAST(s AS DOUBLE) AS start, CAST(round(least(s + 2.0, dur), 3) AS DOUBLE) AS "end" FROM w WHERE least(s + 2.0, dur) - s >= 0.5""")
def win17(spark: SparkSession, d: str) -> DataFrame:
    """Labelling windows of two seconds; a last one under half a second is dropped."""
    c = table(spark, d, "gaze_events").where("end IS NOT NULL").groupBy("key").agg(F.max("end").alias("dur"))
    w = c.select("key", "dur", F.explode(F.sequence(F.lit(0), F.floor(F.col("dur") / 2).cast("int"))).alias("i")).withColumn("start", F.col("i") * F.lit(2.0))
    return w.withColumn("end", F.least(F.col("start") + 2.0, F.col("dur"))).where("end - start >= 0.5").select("key", "start", F.round("end", 3).alias("end"))


@query("win18", f"""WITH {FRAMES}, s AS (SELECT key, list_sort(list(value)) AS l, count(*) AS n FROM frames GROUP BY key), o AS (SELECT key, l[CAST(floor(n * 0.75) AS BIGINT) + 1] AS level FROM s)
SELECT key, round(any_value(level), 6) AS open_level, round(median(CASE WHEN value >= greatest(0.12, 0.65 * level) THEN value END), 6) AS usual FROM frames JOIN o USING (key) GROUP BY key""")
def win18(spark: SparkSession, d: str) -> DataFrame:
    """Open level (the element at three quarters of the sorted values) and the median above its threshold."""
    f = numbered(frames(spark, d), ["key"], ["value"], "r")
    n = f.groupBy("key").agg((F.floor(F.count("*") * 0.75) + 1).alias("r"))
    f = f.join(f.join(n, ["key", "r"]).select("key", F.col("value").alias("level")), "key")
    return f.groupBy("key").agg(F.round(F.first("level"), 6).alias("open_level"), F.round(F.median(F.when(F.col("value") >= F.greatest(F.lit(0.12), F.col("level") * 0.65), F.col("value"))), 6).alias("usual"))


@query("win19", """WITH s AS (SELECT DISTINCT key, segments FROM transcript), g AS (SELECT key, unnest(segments) AS s, generate_subscripts(segments, 1) AS seg FROM s),
w AS (SELECT key, seg, s.start AS b, s."end" AS e, [x for x in regexp_split_to_array(trim(s.text), '[ \\n]+') if x <> ''] AS w FROM g WHERE trim(s.text) <> ''),
x AS (SELECT key, seg, b, e, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM w)
SELECT key, CAST(seg AS INTEGER) AS seg, CAST(i AS INTEGER) AS i, word, round(b + (e - b) * i / n, 9) AS start FROM x""")
def win19(spark: SparkSession, d: str) -> DataFrame:
    """Word times spread evenly inside each segment."""
    t = table(spark, d, "transcript").dropDuplicates(["key"]).select("key", F.posexplode("segments").alias("p", "s"))
    t = t.select("key", (F.col("p") + 1).alias("seg"), "s.start", "s.end", F.filter(F.split(F.trim("s.text"), "[ \\n]+"), lambda x: x != "").alias("w")).where("size(w) > 0")
    t = t.select("key", "seg", "start", "end", F.size("w").alias("n"), F.posexplode("w").alias("i", "word"))
    return t.select("key", "seg", "i", "word", F.round(F.col("start") + (F.col("end") - F.col("start")) * F.col("i") / F.col("n"), 9).alias("start"))


@query("win20", f"""WITH {FRAMES}, m AS (SELECT *, sum(CASE WHEN state <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY t ROWS UNBOUNDED PRECEDING) AS g FROM frames)
SELECT key, max(c) AS worst, bool_or(c >= 3) AS stopped FROM (SELECT key, sum(CASE WHEN state = 'error' THEN 1 ELSE 0 END)::BIGINT AS c FROM m GROUP BY key, g) GROUP BY key""")
def win20(spark: SparkSession, d: str) -> DataFrame:
    """Consecutive failures, counted anew after each success; whether a limit of three was met."""
    f = frames(spark, d).select("key", "t", F.when(F.col("state") == "error", "error").otherwise("ok").alias("state"))
    runs = closed_runs(f, ["key"], "state", "t", "t").where("state = 'error'").withColumnRenamed("key", "k")
    c = f.where("state = 'error'").join(runs.drop("state"), (F.col("key") == F.col("k")) & F.col("t").between(F.col("start"), F.col("end"))).groupBy("key", "start").agg(F.count("*").alias("c"))
    worst = c.groupBy("key").agg(F.max("c").alias("worst"))
    return f.select("key").distinct().join(worst, "key", "left").select("key", F.coalesce("worst", F.lit(0)).alias("worst"), (F.coalesce("worst", F.lit(0)) >= 3).alias("stopped"))


@query("win21", """SELECT p_partkey, p_brand, row_number() OVER w > 1 AS seen_before, first_value(p_partkey) OVER w AS first_seen FROM part WINDOW w AS (PARTITION BY p_brand, p_type ORDER BY p_partkey)""")
def win21(spark: SparkSession, d: str) -> DataFrame:
    """Ordered scan that remembers what was seen."""
    w = Window.partitionBy("p_brand", "p_type").orderBy("p_partkey")
    return table(spark, d, "part").select("p_partkey", "p_brand", (F.row_number().over(w) > 1).alias("seen_before"), F.first("p_partkey").over(w).alias("first_seen"))
