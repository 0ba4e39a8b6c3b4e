"""Queries of scalar functions: text, math, arrays and JSON, projections and filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanstone.functions import claims as C
from gleanstone.functions import scoring as G
from gleanstone.functions.similarity import similarity
from gleanstone.functions.text import code_form
from gleanstone.plans.aggregates import SHARES, state_shares
from gleanstone.plans.base import BEHAVIOURS, behaviours, query
from gleanstone.plans.joins import CLAIMS, POINTS, claims, points
from gleanstone.session import table

PUNCT = ".,!?;:\"'()…ๆฯ"
PUNCT_SQL = PUNCT.replace("'", "''")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text", "lang", "source", "key")


# text ------------------------------------------------------------------------------------------


@query("str01", f"SELECT evidence_id, trim(lower(value), '{PUNCT_SQL}') AS token FROM (SELECT DISTINCT evidence_id, value FROM evidence WHERE type = 'word')")
def str01(spark: SparkSession, d: str) -> DataFrame:
    """Tokens in lower case without marks at either end."""
    w = table(spark, d, "evidence").where("type = 'word'").select("evidence_id", "value").distinct()
    return w.select("evidence_id", F.btrim(F.lower("value"), F.lit(PUNCT)).alias("token"))


@query("str02", "SELECT evidence_id, regexp_replace(lower(value), '[^a-z0-9'']', '', 'g') AS token FROM (SELECT DISTINCT evidence_id, value FROM evidence WHERE type = 'word')")
def str02(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of letters, digits and apostrophes only."""
    w = table(spark, d, "evidence").where("type = 'word'").select("evidence_id", "value").distinct()
    return w.select("evidence_id", F.regexp_replace(F.lower("value"), "[^a-z0-9']", "").alias("token"))


# Single and two-word fillers.
SINGLE = ("um", "uh", "erm", "like", "well", "so", "actually", "basically", "honestly")
DOUBLE = ("you know", "kind of", "sort of", "i mean")


@query("str03", f"""WITH w AS (SELECT doc_id, trim(lower(w), '{PUNCT_SQL}') AS w, i FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents WHERE text IS NOT NULL)),
p AS (SELECT *, w || ' ' || lead(w) OVER (PARTITION BY doc_id ORDER BY i) IN {DOUBLE} AS pair FROM w), q AS (SELECT *, coalesce(lag(pair) OVER (PARTITION BY doc_id ORDER BY i), false) AS used FROM p)
SELECT doc_id, count(*) FILTER (pair AND NOT used) AS doubles, count(*) FILTER (w IN {SINGLE} AND NOT used AND NOT coalesce(pair, false)) AS singles FROM q GROUP BY doc_id""")
def str03(spark: SparkSession, d: str) -> DataFrame:
    """Fillers from left to right, two-word ones first; no listed pair begins with another's second word."""
    w = F.transform(F.split("text", " "), lambda x: F.btrim(F.lower(x), F.lit(PUNCT)))
    t = docs(spark, d).select("doc_id", w.alias("w")).withColumn("pair", F.transform("w", lambda x, i: F.coalesce(F.concat(x, F.lit(" "), F.get("w", i + 1)).isin(*DOUBLE), F.lit(False))))
    used = lambda i: F.coalesce(F.get("pair", i - 1), F.lit(False))
    t = t.withColumn("d", F.filter(F.transform("pair", lambda p, i: p & ~used(i)), lambda x: x)).withColumn("s", F.filter(F.transform("w", lambda x, i: x.isin(*SINGLE) & ~used(i) & ~F.get("pair", i)), lambda x: x))
    return t.select("doc_id", F.size("d").cast("bigint").alias("doubles"), F.size("s").cast("bigint").alias("singles"))


@query("str04", f"SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS n, unnest(s) AS sentence FROM (SELECT doc_id, {C.sentences_sql('text')} AS s FROM documents WHERE text IS NOT NULL)")
def str04(spark: SparkSession, d: str) -> DataFrame:
    """Simple sentences: split behind a stop before a capital, quotation or bracket."""
    return docs(spark, d).select("doc_id", F.posexplode(C.sentences_of(F.col("text"))).alias("n", "sentence"))


@query("str05", f"WITH {CLAIMS}, x AS (SELECT claim_id, unnest({C.claimed_times_sql('sentence')}) AS t FROM c WHERE sentence IS NOT NULL) SELECT claim_id, t.t0 AS t0, t.t1 AS t1, t.pos AS pos, t.text AS text FROM x")
def str05(spark: SparkSession, d: str) -> DataFrame:
    """Times that claims mention, with their positions."""
    c = claims(spark, d).select("claim_id", F.explode(C.claimed_times(F.col("sentence"))).alias("t"))
    return c.select("claim_id", "t.t0", "t.t1", "t.pos", "t.text")


@query("str06", f"""WITH {CLAIMS}, x AS (SELECT claim_id, sentence, dimension, unnest(coalesce(nullif([t.pos for t in {C.claimed_times_sql('sentence')}], []), [0])) AS pos FROM c) SELECT claim_id, pos, {C.topic_at_sql('sentence', 'pos', 'dimension')} AS topic FROM x""")
def str06(spark: SparkSession, d: str) -> DataFrame:
    """Topic of a claim by the wording nearest to each of its times; from its beginning where it has none."""
    at = F.transform(C.claimed_times(F.col("sentence")), lambda t: t["pos"])
    c = claims(spark, d).select("claim_id", "sentence", "dimension", F.explode(F.when(F.size(at) > 0, at).otherwise(F.array(F.lit(0)))).alias("pos"))
    return c.select("claim_id", "pos", C.topic_at(F.col("sentence"), F.col("pos"), F.col("dimension")).alias("topic"))


@query("str07", f"WITH {CLAIMS} SELECT claim_id, {C.expected_states_sql('topic', 'sentence')} AS expected FROM c")
def str07(spark: SparkSession, d: str) -> DataFrame:
    """States that a claim's wording expects."""
    return claims(spark, d).select("claim_id", F.array_join(C.expected_states(F.col("topic"), F.col("sentence")), " ").alias("expected"))


@query("str08", "SELECT doc_id, len(regexp_extract_all(text, '[\"“]([^\"“”]{3,})[\"”]', 1)) AS n, array_to_string(regexp_extract_all(text, '[\"“]([^\"“”]{3,})[\"”]', 1), ' | ') AS quotes FROM documents WHERE text IS NOT NULL")
def str08(spark: SparkSession, d: str) -> DataFrame:
    """Quotations of three letters or more."""
    q = C.quotes(F.col("text"))
    return docs(spark, d).select("doc_id", F.size(q).cast("bigint").alias("n"), F.array_join(q, " | ").alias("quotes"))


@query("str09", f"""WITH {CLAIMS}, w AS (SELECT lower(trim(key)) AS k, list(DISTINCT regexp_replace(lower(value), '[^a-z0-9'']', '', 'g')) AS words FROM evidence WHERE type = 'word' GROUP BY 1),
q AS (SELECT claim_id, lower(trim(key)) AS k, [x for x in regexp_split_to_array(regexp_replace(lower(quote), '[^a-z0-9'' ]', '', 'g'), ' +') if x <> ''] AS q FROM c WHERE quote IS NOT NULL)
SELECT claim_id, round(len([x for x in q if list_contains(words, x)]) / nullif(len(q), 0), 9) AS overlap FROM q JOIN w USING (k)""")
def str09(spark: SparkSession, d: str) -> DataFrame:
    """Share of a quotation's words that the clip speaks."""
    w = table(spark, d, "evidence").where("type = 'word'").groupBy(F.lower(F.trim("key")).alias("k")).agg(F.collect_set(F.regexp_replace(F.lower("value"), "[^a-z0-9']", "")).alias("words"))
    c = claims(spark, d).where("quote IS NOT NULL").select("claim_id", F.lower(F.trim("key")).alias("k"), "quote")
    return c.join(w, "k").select("claim_id", F.round(C.quote_overlap(F.col("quote"), F.col("words")), 9).alias("overlap"))


@query("str10", "SELECT doc_id, len(regexp_extract_all(text, '\\b[SEPT]\\d{1,3}\\b')) AS ids, len(regexp_extract_all(text, '\\b[SEPT]\\d{1,3}\\b')) > 2 AS too_many FROM documents WHERE text IS NOT NULL")
def str10(spark: SparkSession, d: str) -> DataFrame:
    """Evidence ids mentioned in a text."""
    n = F.regexp_count("text", F.lit(r"\b[SEPT]\d{1,3}\b")).cast("bigint")
    return docs(spark, d).select("doc_id", n.alias("ids"), (n > 2).alias("too_many"))


@query("str11", """SELECT feedback_id, array_to_string(list_sort(list_distinct([x for x in regexp_extract_all(regexp_replace(t, '\\[[^\\]]*\\]', '', 'g'), '\\d+(?:\\.\\d+)?') if NOT list_contains(k, x)])), ' ') AS invented
FROM (SELECT DISTINCT ON (feedback_id) feedback_id, improved_answer.rewritten_en AS t, regexp_extract_all(coalesce(improved_answer.original_snippet, ''), '\\d+(?:\\.\\d+)?') AS k FROM feedback) WHERE t IS NOT NULL""")
def str11(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of a rewritten answer that its original doesn't have."""
    f = table(spark, d, "feedback").dropDuplicates(["feedback_id"]).select("feedback_id", F.col("improved_answer.rewritten_en").alias("t"), F.coalesce("improved_answer.original_snippet", F.lit("")).alias("o")).where("t IS NOT NULL")
    known = F.regexp_extract_all("o", F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    return f.select("feedback_id", F.array_join(F.array_sort(C.invented_numbers(F.col("t"), known)), " ").alias("invented"))


@query("str12", f"WITH {POINTS} SELECT feedback_id, CAST(n AS INTEGER) AS n, length(issue) > 320 AS too_long, left(issue, 80) AS label FROM pts WHERE issue IS NOT NULL")
def str12(spark: SparkSession, d: str) -> DataFrame:
    """Length limit and shortened label."""
    return points(spark, d).where("issue IS NOT NULL").select("feedback_id", "n", (F.length("issue") > 320).alias("too_long"), F.left("issue", F.lit(80)).alias("label"))


@query("str13")
def str13(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of an answer and its original."""
    f = table(spark, d, "feedback").dropDuplicates(["feedback_id"]).select("feedback_id", F.col("improved_answer.rewritten_en").alias("a"), F.col("improved_answer.original_snippet").alias("b"))
    return f.select("feedback_id", F.round(similarity("a", "b"), 6).alias("ratio"))


@query("str14", "SELECT doc_id, TRY_CAST(regexp_extract(text, '(\\d+(?:\\.\\d+)?) hours', 1) AS DOUBLE) AS hours, TRY_CAST(regexp_extract(text, '(\\d+) minutes', 1) AS INTEGER) AS minutes FROM documents WHERE text IS NOT NULL")
def str14(spark: SparkSession, d: str) -> DataFrame:
    """Numbers read back out of sentences."""
    return docs(spark, d).select("doc_id", F.expr(r"try_cast(regexp_extract(text, '(\\d+(?:\\.\\d+)?) hours', 1) AS DOUBLE)").alias("hours"), F.expr(r"try_cast(regexp_extract(text, '(\\d+) minutes', 1) AS INT)").alias("minutes"))


@query("str15", SHARES + " SELECT key, type, value, CAST(CAST(round_even(share * 100, 0) AS INTEGER) AS VARCHAR) || '%' AS pct, CAST(floor(sec / 60) AS INTEGER) || ':' || lpad(CAST(CAST(floor(sec) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS clock FROM shares")
def str15(spark: SparkSession, d: str) -> DataFrame:
    """Percentages and minutes with seconds."""
    s = state_shares(spark, d)
    return s.select("key", "type", "value", F.concat(F.bround(F.col("share") * 100, 0).cast("int"), F.lit("%")).alias("pct"), F.concat(F.floor(F.col("sec") / 60).cast("int"), F.lit(":"), F.lpad((F.floor("sec") % 60).cast("string"), 2, "0")).alias("clock"))


@query("str16", "SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS html FROM documents WHERE text IS NOT NULL")
def str16(spark: SparkSession, d: str) -> DataFrame:
    """Text escaped for HTML."""
    t = F.col("text")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return docs(spark, d).select("doc_id", t.alias("html"))


@query("str17", f"WITH {BEHAVIOURS}, l AS (SELECT key, start, evidence_id, 'E' || evidence_id || ' ' || type || ' ' || value AS line FROM behaviours WHERE dur >= 5) SELECT key, string_agg(line, chr(10) ORDER BY start, evidence_id) AS log FROM l GROUP BY key")
def str17(spark: SparkSession, d: str) -> DataFrame:
    """The log of a clip as lines for a prompt."""
    b = behaviours(spark, d).where("dur >= 5").select("key", F.struct("start", "evidence_id", F.concat_ws(" ", F.concat(F.lit("E"), "evidence_id"), "type", "value").alias("line")).alias("l"))
    return b.groupBy("key").agg(F.array_join(F.array_sort(F.collect_list("l"))["line"], "\n").alias("log"))


@query("str18", "SELECT claim_id, time_text, TRY_CAST(regexp_extract(time_text, '(\\d+\\.\\d+)s', 1) AS DOUBLE) AS t FROM (SELECT DISTINCT ON (claim_id) * FROM hallucination_claims)")
def str18(spark: SparkSession, d: str) -> DataFrame:
    """A time read out of a name."""
    return claims(spark, d).select("claim_id", "time_text", F.expr(r"try_cast(regexp_extract(time_text, '(\\d+\\.\\d+)s', 1) AS DOUBLE)").alias("t"))


@query("str19", "SELECT p_partkey, CASE WHEN w > 0 AND h > 0 THEN w END AS width, CASE WHEN w > 0 AND h > 0 THEN h END AS height FROM (SELECT p_partkey, TRY_CAST(split_part(r, 'x', 1) AS INTEGER) AS w, TRY_CAST(split_part(r, 'x', 2) AS INTEGER) AS h FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'unknown' ELSE p_size || 'x' || (p_size - 10) END AS r FROM part))")
def str19(spark: SparkSession, d: str) -> DataFrame:
    """Width and height of a text like 640x480, both positive or null."""
    p = table(spark, d, "part").select("p_partkey", F.expr("CASE WHEN p_partkey % 7 = 0 THEN 'unknown' ELSE concat(p_size, 'x', p_size - 10) END").alias("r"))
    p = p.select("p_partkey", *[F.expr(f"try_cast(try_element_at(split(r, 'x'), {i}) AS INT)").alias(c) for i, c in ((1, "w"), (2, "h"))])
    ok = (F.col("w") > 0) & (F.col("h") > 0)
    return p.select("p_partkey", F.when(ok, F.col("w")).alias("width"), F.when(ok, F.col("h")).alias("height"))


@query("str20", """SELECT key, trim(array_to_string([trim(x.text) for x in segments if trim(x.text) <> ''], ' ')) AS text FROM (SELECT DISTINCT ON (key) key, segments FROM transcript)""")
def str20(spark: SparkSession, d: str) -> DataFrame:
    """A transcript's segment texts in one text."""
    t = table(spark, d, "transcript").dropDuplicates(["key"])
    return t.select("key", F.trim(F.array_join(F.filter(F.transform("segments", lambda x: F.trim(x["text"])), lambda x: x.isNotNull() & (x != "")), " ")).alias("text"))


@query("str21", "SELECT DISTINCT approach, translate(approach, ':/ ', '__-') AS slug FROM feedback")
def str21(spark: SparkSession, d: str) -> DataFrame:
    """Names made fit for files."""
    return table(spark, d, "feedback").select("approach", F.translate("approach", ":/ ", "__-").alias("slug")).distinct()


@query("str22", SHARES + " SELECT key, 'You looked at the camera ' || CAST(round_even(share * 100, 0) AS INTEGER) || '% of the time.' AS en, 'คุณมองกล้อง ' || CAST(round_even(share * 100, 0) AS INTEGER) || '% ของเวลา' AS th FROM shares WHERE value = 'eye_contact'")
def str22(spark: SparkSession, d: str) -> DataFrame:
    """A bilingual template filled."""
    p = F.bround(F.col("share") * 100, 0).cast("int")
    return state_shares(spark, d).where("value = 'eye_contact'").select("key", F.concat(F.lit("You looked at the camera "), p, F.lit("% of the time.")).alias("en"), F.concat(F.lit("คุณมองกล้อง "), p, F.lit("% ของเวลา")).alias("th"))


@query("str23", "SELECT p_partkey, [x for x in regexp_split_to_array(p_name, '[ ,]+') if x <> ''][1] AS first, len([x for x in regexp_split_to_array(p_name, '[ ,]+') if x <> '']) AS n FROM part")
def str23(spark: SparkSession, d: str) -> DataFrame:
    """A list packed into a text."""
    x = F.filter(F.split("p_name", "[ ,]+"), lambda x: x != "")
    return table(spark, d, "part").select("p_partkey", F.get(x, F.lit(0)).alias("first"), F.size(x).cast("bigint").alias("n"))


ERRORS = {"busy": "429|overload|busy", "quota": "quota|limit", "network": "timeout|connection"}


@query("str24", "SELECT event_id, CASE WHEN regexp_matches(lower(props), '429|overload|busy') THEN 'busy' WHEN regexp_matches(lower(props), 'quota|limit') THEN 'quota' WHEN regexp_matches(lower(props), 'timeout|connection') THEN 'network' ELSE 'other' END AS kind FROM events")
def str24(spark: SparkSession, d: str) -> DataFrame:
    """Messages sorted into kinds by what they contain."""
    kind = reduce(lambda acc, kv: acc.when(F.lower("props").rlike(kv[1]), kv[0]), list(ERRORS.items())[1:], F.when(F.lower("props").rlike(ERRORS["busy"]), "busy"))
    return table(spark, d, "events").select("event_id", kind.otherwise("other").alias("kind"))


@query("str25", "SELECT key, list_sum([len([y for y in regexp_split_to_array(x.text, ' +') if y <> '']) for x in segments if x.text IS NOT NULL])::BIGINT AS pieces FROM (SELECT DISTINCT ON (key) key, segments FROM transcript WHERE language = 'th')")
def str25(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of Thai texts between blanks, where no tokeniser is at hand."""
    t = table(spark, d, "transcript").dropDuplicates(["key"]).where("language = 'th'")
    n = F.transform(F.filter("segments", lambda x: x["text"].isNotNull()), lambda x: F.size(F.filter(F.split(x["text"], " +"), lambda y: y != "")))
    return t.select("key", F.aggregate(n, F.lit(0).cast("bigint"), lambda a, b: a + b).alias("pieces"))


@query("str26", "SELECT example_id, '# Task' || chr(10) || 'Answer in ' || coalesce(lang, 'en') || '.' || chr(10) || '# Input' || chr(10) || prompt AS prompt FROM (SELECT DISTINCT ON (example_id) * FROM sft_train) WHERE prompt IS NOT NULL")
def str26(spark: SparkSession, d: str) -> DataFrame:
    """Prompts built from parts."""
    s = table(spark, d, "sft_train").dropDuplicates(["example_id"]).where("prompt IS NOT NULL")
    return s.select("example_id", F.concat(F.lit("# Task\nAnswer in "), F.coalesce("lang", F.lit("en")), F.lit(".\n# Input\n"), "prompt").alias("prompt"))


@query("str27", "SELECT example_id, qid, coalesce(CASE qid WHEN 'q1' THEN 'experience' WHEN 'q2' THEN 'strength' WHEN 'q3' THEN 'teamwork' WHEN 'q4' THEN 'motivation' END, 'general') AS focus FROM (SELECT DISTINCT ON (example_id) * FROM sft_train)")
def str27(spark: SparkSession, d: str) -> DataFrame:
    """Focus of a question with a fallback."""
    focus = F.create_map(*[F.lit(x) for kv in {"q1": "experience", "q2": "strength", "q3": "teamwork", "q4": "motivation"}.items() for x in kv])
    return table(spark, d, "sft_train").dropDuplicates(["example_id"]).select("example_id", "qid", F.coalesce(F.try_element_at(focus, F.col("qid")), F.lit("general")).alias("focus"))


@query("str28", "SELECT DISTINCT t.value AS feature, coalesce(l.label_en, t.value) AS en, coalesce(l.label_th, t.value) AS th FROM (SELECT DISTINCT type AS value FROM test_rq2_labels WHERE type IS NOT NULL UNION SELECT DISTINCT type FROM evidence) t LEFT JOIN label_vocab l ON l.type = t.value")
def str28(spark: SparkSession, d: str) -> DataFrame:
    """Bilingual labels that fall back to the raw name."""
    t = table(spark, d, "test_rq2_labels").where("type IS NOT NULL").select("type").union(table(spark, d, "evidence").select("type")).distinct()
    return t.join(table(spark, d, "label_vocab"), "type", "left").select(F.col("type").alias("feature"), F.coalesce("label_en", "type").alias("en"), F.coalesce("label_th", "type").alias("th"))


TEXTS = """f AS (SELECT DISTINCT ON (feedback_id) * FROM feedback), i AS (SELECT feedback_id, unnest(improvements) AS i FROM f),
t AS (SELECT feedback_id, 'issue' AS kind, i.issue_en AS text FROM i WHERE i IS NOT NULL UNION ALL SELECT feedback_id, 'step', unnest(i.action_steps_en) FROM i WHERE i IS NOT NULL UNION ALL SELECT feedback_id, 'summary', overall_summary_en FROM f)"""


@query("str29", f"WITH {TEXTS} SELECT feedback_id, kind, count(*) AS n, coalesce(sum(length(text)), 0)::BIGINT AS letters FROM t GROUP BY 1, 2")
def str29(spark: SparkSession, d: str) -> DataFrame:
    """English texts of a feedback, by kind."""
    f = table(spark, d, "feedback").dropDuplicates(["feedback_id"])
    one = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    items = F.flatten(F.transform(F.filter(F.coalesce("improvements", F.expr("filter(improvements, x -> false)")), lambda x: x.isNotNull()), lambda x: F.concat(F.array(one("issue", x["issue_en"])), F.coalesce(F.transform(x["action_steps_en"], lambda s: one("step", s)), F.array().cast("array<struct<kind:string,text:string>>")))))
    t = f.select("feedback_id", F.explode(F.concat(F.array(one("summary", F.col("overall_summary_en"))), F.coalesce(items, F.array().cast("array<struct<kind:string,text:string>>")))).alias("t"))
    return t.groupBy("feedback_id", "t.kind").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("t.text")), F.lit(0)).alias("letters"))


@query("str30", "SELECT doc_id, 'Rate the answer from 1 to 10.' || chr(10) || text AS prompt FROM documents WHERE text IS NOT NULL AND regexp_replace(lower(trim(source)), '[ \\-]', '_', 'g') = 'interview_answer'")
def str30(spark: SparkSession, d: str) -> DataFrame:
    """Rating prompts with the whole answer, whatever the spelling of its source."""
    return docs(spark, d).where(code_form(F.col("source")) == "interview_answer").select("doc_id", F.concat(F.lit("Rate the answer from 1 to 10.\n"), "text").alias("prompt"))


# math ------------------------------------------------------------------------------------------

MEASURES = {"contact": "l_discount * 10", "wpm": "l_quantity * 6", "pauses_per_min": "l_linenumber * 4", "head_yaw": "l_quantity"}


@query("mth01", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({G.piecewise_sql('(' + x + ')', G.KNOTS[k])}, 6) AS {k}" for k, x in MEASURES.items()) + " FROM lineitem")
def mth01(spark: SparkSession, d: str) -> DataFrame:
    """Piecewise-linear maps, flat beyond their ends."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(G.piecewise(F.expr(x), G.KNOTS[k]), 6).alias(k) for k, x in MEASURES.items()])


@query("mth02", "SELECT c_custkey, round(greatest(least(c_acctbal / 50, 100.0), 0.0), 1) AS score FROM customer")
def mth02(spark: SparkSession, d: str) -> DataFrame:
    """Scores clamped to 0 .. 100."""
    return table(spark, d, "customer").select("c_custkey", F.round(G.clamp(F.col("c_acctbal") / 50), 1).alias("score"))


@query("mth03", "SELECT c_custkey, CASE WHEN s >= 85 THEN 'Excellent' WHEN s >= 70 THEN 'Good' WHEN s >= 55 THEN 'Fair' WHEN s >= 40 THEN 'Needs Work' ELSE 'Priority' END AS band FROM (SELECT c_custkey, c_acctbal / 100 AS s FROM customer)")
def mth03(spark: SparkSession, d: str) -> DataFrame:
    """Band of a score."""
    return table(spark, d, "customer").select("c_custkey", G.band(F.col("c_acctbal") / 100).alias("band"))


@query("mth04", "SELECT c_custkey, CASE WHEN s >= 80 THEN 5 WHEN s >= 60 THEN 4 WHEN s >= 40 THEN 3 WHEN s >= 20 THEN 2 ELSE 1 END AS band FROM (SELECT c_custkey, c_acctbal / 100 AS s FROM customer)")
def mth04(spark: SparkSession, d: str) -> DataFrame:
    """Band of a percentile."""
    s = F.col("c_acctbal") / 100
    return table(spark, d, "customer").select("c_custkey", F.when(s >= 80, 5).when(s >= 60, 4).when(s >= 40, 3).when(s >= 20, 2).otherwise(1).alias("band"))


def _dimension_sql() -> str:
    k, p = G.KNOTS, G.piecewise_sql
    return f"""SELECT l_orderkey, l_linenumber, round(0.7 * ({p('a', k['contact'])}) + 0.3 * ({p('b', k['gaze_stability'])}), 6) AS eye,
    round(0.30 * ({p('c', k['head_movement'])}) + 0.25 * ({p('c', k['head_movement'])}) + 0.20 * ({p('c', k['head_pitch'])}) + 0.15 * ({p('c', k['head_yaw'])}) + 10.0, 6) AS head,
    round(0.45 * ({p('a', k['hand_presence'])}) + 0.30 * ({p('b', k['hand_speed'])}) + 0.25 * ({p('b', k['hand_fidget'])}), 6) AS hand,
    round(0.35 * ({p('a', k['smile'])}) + 0.25 * ({p('b', k['expressiveness'])}) + 0.25 * ({p('a', k['eye_aspect'])}) + 0.15 * ({p('b', k['brow'])}), 6) AS face,
    round(0.30 * ({p('w', k['wpm'])}) + 0.30 * ({p('b', k['filler_ratio'])}) + 0.25 * ({p('c', k['pauses_per_min'])}) + 0.15 * ({p('a', k['long_pause_share'])}), 6) AS answer
    FROM (SELECT l_orderkey, l_linenumber, l_discount * 10 AS a, l_tax AS b, l_quantity AS c, l_quantity * 6 AS w FROM lineitem)"""


@query("mth05", _dimension_sql())
def mth05(spark: SparkSession, d: str) -> DataFrame:
    """The five dimension scores from weighted maps."""
    m = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("a"), F.col("l_tax").alias("b"), F.col("l_quantity").alias("c"), (F.col("l_quantity") * 6).alias("w"))
    p = lambda c, k: G.piecewise(F.col(c), G.KNOTS[k])
    return m.select(
        "l_orderkey", "l_linenumber",
        F.round(0.7 * p("a", "contact") + 0.3 * p("b", "gaze_stability"), 6).alias("eye"),
        F.round(0.30 * p("c", "head_movement") + 0.25 * p("c", "head_movement") + 0.20 * p("c", "head_pitch") + 0.15 * p("c", "head_yaw") + 10.0, 6).alias("head"),
        F.round(0.45 * p("a", "hand_presence") + 0.30 * p("b", "hand_speed") + 0.25 * p("b", "hand_fidget"), 6).alias("hand"),
        F.round(0.35 * p("a", "smile") + 0.25 * p("b", "expressiveness") + 0.25 * p("a", "eye_aspect") + 0.15 * p("b", "brow"), 6).alias("face"),
        F.round(0.30 * p("w", "wpm") + 0.30 * p("b", "filler_ratio") + 0.25 * p("c", "pauses_per_min") + 0.15 * p("a", "long_pause_share"), 6).alias("answer"))


@query("mth13", "SELECT vec_id, round(list_avg(embedding[1:32])::DOUBLE, 5) AS x, round(list_avg(embedding[33:64])::DOUBLE, 5) AS y FROM embeddings")
def mth13(spark: SparkSession, d: str) -> DataFrame:
    """Centre of two sets of coordinates."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(a)
    return table(spark, d, "embeddings").select("vec_id", F.round(mean(F.slice("embedding", 1, 32)), 5).alias("x"), F.round(mean(F.slice("embedding", 33, 32)), 5).alias("y"))


@query("mth14", "SELECT user_id, round(greatest(50.0, avg(value) - 15), 9) AS threshold FROM events GROUP BY 1")
def mth14(spark: SparkSession, d: str) -> DataFrame:
    """Adaptive silence threshold."""
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.greatest(F.lit(50.0), F.avg("value") - 15), 9).alias("threshold"))


@query("mth15", "SELECT o_custkey, round(avg(o_totalprice), 6) AS mean, round(coalesce(stddev_pop(o_totalprice), 0), 6) AS sd FROM orders GROUP BY 1")
def mth15(spark: SparkSession, d: str) -> DataFrame:
    """Mean and population deviation, 0 for a single value."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.round(F.avg("o_totalprice"), 6).alias("mean"), F.round(F.coalesce(F.stddev_pop("o_totalprice"), F.lit(0.0)), 6).alias("sd"))


@query("mth16", "SELECT c_custkey, CAST(least(greatest(round_even(c_acctbal / 2000, 0), 1), 5) AS INTEGER) AS band FROM customer")
def mth16(spark: SparkSession, d: str) -> DataFrame:
    """Rating to the bands 1 to 5, half to even."""
    return table(spark, d, "customer").select("c_custkey", F.least(F.greatest(F.bround(F.col("c_acctbal") / 2000, 0), F.lit(1.0)), F.lit(5.0)).cast("int").alias("band"))


@query("mth17", "SELECT label_id, CASE lower(trim(label, ' ')) WHEN 'none' THEN 0 WHEN 'ปกติดี' THEN 0 WHEN 'head down' THEN 1 WHEN 'ก้มศีรษะ' THEN 1 WHEN 'long pause' THEN 2 WHEN 'หยุดนาน' THEN 2 END AS num FROM (SELECT DISTINCT ON (label_id) * FROM test_rq2_labels)")
def mth17(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of labels in two languages."""
    names = {"none": 0, "ปกติดี": 0, "head down": 1, "ก้มศีรษะ": 1, "long pause": 2, "หยุดนาน": 2}
    m = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return table(spark, d, "test_rq2_labels").dropDuplicates(["label_id"]).select("label_id", F.try_element_at(m, F.lower(F.trim("label"))).alias("num"))


@query("mth18", "SELECT o_orderkey, round(greatest(CASE WHEN o_totalprice < 80000 THEN (80000 - o_totalprice) / 80000 ELSE 0 END, CASE WHEN o_totalprice > 180000 THEN (o_totalprice - 180000) / 180000 ELSE 0 END), 9) AS severity FROM orders")
def mth18(spark: SparkSession, d: str) -> DataFrame:
    """Severity of a breached rule: relative distance to its threshold."""
    x = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", F.round(F.greatest(F.when(x < 80000, (80000 - x) / 80000).otherwise(0.0), F.when(x > 180000, (x - 180000) / 180000).otherwise(0.0)), 9).alias("severity"))


# arrays and JSON -------------------------------------------------------------------------------


@query("arr01", "WITH s AS (SELECT DISTINCT ON (key) key, segments FROM transcript), g AS (SELECT key, unnest(segments) AS s, generate_subscripts(segments, 1) AS i FROM s), w AS (SELECT key, i, unnest(s.words) AS w, generate_subscripts(s.words, 1) AS j FROM g) SELECT key, CAST(i AS INTEGER) AS seg, CAST(j AS INTEGER) AS n, trim(w.word) AS word, round(w.start, 3) AS start FROM w WHERE trim(w.word) <> ''")
def arr01(spark: SparkSession, d: str) -> DataFrame:
    """Words out of nested segments."""
    t = table(spark, d, "transcript").dropDuplicates(["key"]).select("key", F.posexplode("segments").alias("i", "s")).select("key", "i", F.posexplode("s.words").alias("j", "w"))
    return t.select("key", (F.col("i") + 1).alias("seg"), (F.col("j") + 1).alias("n"), F.trim("w.word").alias("word"), F.round("w.start", 3).alias("start")).where("word <> ''")


@query("arr02", "SELECT vec_id, embedding[2]::DOUBLE AS nose, embedding[64]::DOUBLE AS last FROM embeddings")
def arr02(spark: SparkSession, d: str) -> DataFrame:
    """Elements by position."""
    return table(spark, d, "embeddings").select("vec_id", F.get("embedding", F.lit(1)).cast("double").alias("nose"), F.get("embedding", F.lit(63)).cast("double").alias("last"))


@query("arr03", SHARES + " SELECT key, round(coalesce(max(share) FILTER (value = 'no_face'), 0), 9) AS no_face FROM shares WHERE type = 'gaze' GROUP BY key")
def arr03(spark: SparkSession, d: str) -> DataFrame:
    """A map's value with a default."""
    m = state_shares(spark, d).where("type = 'gaze'").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("value", "share"))).alias("m"))
    return m.select("key", F.round(F.coalesce(F.try_element_at("m", F.lit("no_face")), F.lit(0.0)), 9).alias("no_face"))


@query("arr04", SHARES + " SELECT key, round(coalesce(sum(share) FILTER (value LIKE 'turned%'), 0), 9) AS turned FROM shares WHERE type = 'head' GROUP BY key")
def arr04(spark: SparkSession, d: str) -> DataFrame:
    """Sum of a map's values over some keys."""
    m = state_shares(spark, d).where("type = 'head'").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("value", "share"))).alias("m"))
    return m.select("key", F.round(F.aggregate(F.map_values(F.map_filter("m", lambda k, v: k.startswith("turned"))), F.lit(0.0), lambda a, b: a + b), 9).alias("turned"))


@query("arr05", "SELECT event_id, json_valid(props) AS ok FROM events")
def arr05(spark: SparkSession, d: str) -> DataFrame:
    """JSON parsed where it is JSON."""
    return table(spark, d, "events").select("event_id", F.try_parse_json("props").isNotNull().alias("ok"))


@query("arr06", "SELECT vec_id, round((embedding[1]::DOUBLE) * (embedding[2]::DOUBLE), 6) AS product, label FROM embeddings")
def arr06(spark: SparkSession, d: str) -> DataFrame:
    """Two arrays zipped."""
    z = F.arrays_zip(F.slice("embedding", 1, 1).alias("a"), F.slice("embedding", 2, 1).alias("b"))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.get(z, F.lit(0))["a"].cast("double") * F.get(z, F.lit(0))["b"].cast("double"), 6).alias("product"), "label")


@query("arr07", f"WITH {POINTS}, bad AS (SELECT feedback_id, n, len(ids) > 3 OR coalesce(len(ids), 0) = 0 AS bad FROM pts) SELECT feedback_id, count(*) FILTER (NOT bad) AS kept, count(*) FILTER (bad) AS removed FROM bad GROUP BY 1")
def arr07(spark: SparkSession, d: str) -> DataFrame:
    """Failed points dropped from an array, and how many."""
    f = table(spark, d, "feedback").dropDuplicates(["feedback_id"]).where("size(improvements) > 0").withColumn("i", F.filter("improvements", lambda x: x.isNotNull())).where("size(i) > 0")
    bad = lambda x: (F.size(x["evidence_ids"]) > 3) | (F.coalesce(F.size(x["evidence_ids"]), F.lit(0)) <= 0)
    return f.select("feedback_id", F.size(F.filter("i", lambda x: ~bad(x))).cast("bigint").alias("kept"), F.size(F.filter("i", bad)).cast("bigint").alias("removed"))


@query("arr08", f"WITH {POINTS}, t AS (SELECT feedback_id, n, dimension, list_distinct([left(x, 1) for x in ids]) AS kinds FROM pts) SELECT feedback_id, CAST(n AS INTEGER) AS n, CASE WHEN len(kinds) = 1 AND kinds[1] IN ('T', 'P') THEN 'answer_quality' ELSE dimension END AS dimension FROM t")
def arr08(spark: SparkSession, d: str) -> DataFrame:
    """Dimension taken over from the cited ids where all agree."""
    kinds = F.array_distinct(F.transform("ids", lambda x: F.left(x, F.lit(1))))
    return points(spark, d).select("feedback_id", "n", F.when((F.size(kinds) == 1) & F.get(kinds, F.lit(0)).isin("T", "P"), "answer_quality").otherwise(F.col("dimension")).alias("dimension"))


@query("arr09", f"WITH {POINTS} SELECT feedback_id, CAST(n AS INTEGER) AS n, array_to_string(['[' || x || ']' for x in ids], ' ') AS chips FROM pts")
def arr09(spark: SparkSession, d: str) -> DataFrame:
    """Evidence ids as chips."""
    return points(spark, d).select("feedback_id", "n", F.array_join(F.transform("ids", lambda x: F.concat(F.lit("["), x, F.lit("]"))), " ").alias("chips"))


@query("arr10", "SELECT type, label_en, label_th FROM label_vocab")
def arr10(spark: SparkSession, d: str) -> DataFrame:
    """A lookup turned around through a map."""
    v = table(spark, d, "label_vocab").select(F.map_from_arrays(F.array("label_en"), F.array("type")).alias("m"), "label_en", "label_th")
    return v.select(F.element_at("m", F.col("label_en")).alias("type"), "label_en", "label_th")


# projections and filters -----------------------------------------------------------------------


@query("prj01", "SELECT feedback_id, len(improvements) AS improvements__n, length(improved_answer.rewritten_en) AS improved_answer__letters FROM (SELECT DISTINCT ON (feedback_id) * FROM feedback)")
def prj01(spark: SparkSession, d: str) -> DataFrame:
    """Nested leaves flattened into named columns."""
    f = table(spark, d, "feedback").dropDuplicates(["feedback_id"])
    return f.select("feedback_id", F.when(F.col("improvements").isNotNull(), F.size("improvements")).cast("bigint").alias("improvements__n"), F.length("improved_answer.rewritten_en").cast("bigint").alias("improved_answer__letters"))


@query("prj02", "SELECT c_custkey AS id, c_acctbal AS vis__balance, s_acctbal AS sp__balance FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def prj02(spark: SparkSession, d: str) -> DataFrame:
    """Rows put together from several tables with prefixed names."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("vis__balance"))
    return c.join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("sp__balance")), "id", "left")


@query("prj03", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def prj03(spark: SparkSession, d: str) -> DataFrame:
    """A group of columns chosen by type and name."""
    l = table(spark, d, "lineitem")  # noqa: E741
    return l.select("l_orderkey", "l_linenumber", *[c for c, t in l.dtypes if t == "double"])


@query("prj04", "SELECT c_custkey AS participant_id, c_acctbal AS hireability, c_mktsegment AS education FROM customer")
def prj04(spark: SparkSession, d: str) -> DataFrame:
    """Renamed columns, optional ones kept if present."""
    c = table(spark, d, "customer").withColumnsRenamed({"c_custkey": "participant_id", "c_acctbal": "hireability", "c_mktsegment": "education", "accent": "accent"})
    return c.select("participant_id", "hireability", *[x for x in ("education", "accent") if x in c.columns])


KEY = r"^([0-9a-f]{24})_q([1-6])_(generic|personality)$"


@query("prj05", f"SELECT DISTINCT key, nullif(regexp_extract(key, '{KEY}', 1), '') AS participant_id, TRY_CAST(regexp_extract(key, '{KEY}', 2) AS INTEGER) AS question_no, nullif(regexp_extract(key, '{KEY}', 3), '') AS question_type FROM evidence")
def prj05(spark: SparkSession, d: str) -> DataFrame:
    """Parts of a clip key, or nulls."""
    part = lambda i: F.nullif(F.regexp_extract("key", KEY, i), F.lit(""))
    return table(spark, d, "evidence").select("key", part(1).alias("participant_id"), F.expr("try_cast(" + f"nullif(regexp_extract(key, '{KEY}', 2), '') AS INT)").alias("question_no"), part(3).alias("question_type")).distinct()


@query("prj06", "SELECT o_orderkey, o_custkey || '_q' || (o_orderkey % 6 + 1) || '_' || CASE WHEN o_orderkey % 6 + 1 IN (1, 2) THEN 'generic' ELSE 'personality' END AS key FROM orders")
def prj06(spark: SparkSession, d: str) -> DataFrame:
    """Clip keys built from parts."""
    q = F.col("o_orderkey") % 6 + 1
    return table(spark, d, "orders").select("o_orderkey", F.concat("o_custkey", F.lit("_q"), q, F.lit("_"), F.when(q.isin(1, 2), "generic").otherwise("personality")).alias("key"))


@query("prj07", "SELECT o_orderkey, round(o_custkey / nullif(o_totalprice - 1000, 0) * 60, 9) AS per_min FROM orders WHERE o_totalprice > 1000")
def prj07(spark: SparkSession, d: str) -> DataFrame:
    """Derived ratios, null where the divisor is not positive."""
    return table(spark, d, "orders").where("o_totalprice > 1000").select("o_orderkey", F.round(F.try_divide("o_custkey", F.col("o_totalprice") - 1000) * 60, 9).alias("per_min"))


@query("prj08", "SELECT evidence_id, upper(type) || ' ' || value AS line FROM (SELECT DISTINCT evidence_id, type, value FROM evidence) WHERE type <> 'word' AND value IS NOT NULL")
def prj08(spark: SparkSession, d: str) -> DataFrame:
    """Prompt view without word events."""
    e = table(spark, d, "evidence").where("type <> 'word' AND value IS NOT NULL").select("evidence_id", "type", "value").distinct()
    return e.select("evidence_id", F.concat(F.upper("type"), F.lit(" "), "value").alias("line"))


@query("prj09", f"WITH {POINTS} SELECT feedback_id, CAST(n AS INTEGER) AS n, dimension, issue FROM pts")
def prj09(spark: SparkSession, d: str) -> DataFrame:
    """Nested documents without their Thai fields."""
    f = table(spark, d, "feedback").dropDuplicates(["feedback_id"])
    bare = f.withColumn("improvements", F.transform("improvements", lambda x: x.dropFields("issue_th", "action_steps_th")))
    x = bare.select("feedback_id", F.posexplode("improvements").alias("p", "i")).where("i IS NOT NULL")
    return x.select("feedback_id", (F.col("p") + 1).alias("n"), "i.dimension", F.col("i.issue_en").alias("issue"))


@query("prj10", f"WITH {POINTS} SELECT feedback_id, count(*) FILTER (dimension NOT IN ('eye_contact', 'head_pose')) AS visible, count(*) FILTER (dimension IN ('eye_contact', 'head_pose')) AS hidden FROM pts GROUP BY 1")
def prj10(spark: SparkSession, d: str) -> DataFrame:
    """Points shown and skipped by a list."""
    skip = F.array(F.lit("eye_contact"), F.lit("head_pose"))
    return points(spark, d).groupBy("feedback_id").agg(F.count_if(~F.array_contains(skip, F.col("dimension"))).alias("visible"), F.count_if(F.array_contains(skip, F.col("dimension"))).alias("hidden"))


@query("prj11", "SELECT feedback_id, array_to_string([x.text_en for x in strengths], ' | ') AS strengths FROM (SELECT DISTINCT ON (feedback_id) * FROM feedback) WHERE strengths IS NOT NULL")
def prj11(spark: SparkSession, d: str) -> DataFrame:
    """Structs turned into parallel texts."""
    f = table(spark, d, "feedback").dropDuplicates(["feedback_id"]).where("strengths IS NOT NULL")
    return f.select("feedback_id", F.array_join(F.transform("strengths", lambda x: x["text_en"]), " | ").alias("strengths"))


@query("prj12", f"WITH {TEXTS} SELECT feedback_id, kind, text FROM t WHERE text IS NOT NULL")
def prj12(spark: SparkSession, d: str) -> DataFrame:
    """All English texts of a feedback as rows."""
    f = table(spark, d, "feedback").dropDuplicates(["feedback_id"])
    i = f.select("feedback_id", F.explode("improvements").alias("i")).where("i IS NOT NULL")
    one = i.select("feedback_id", F.lit("issue").alias("kind"), F.col("i.issue_en").alias("text"))
    steps = i.select("feedback_id", F.lit("step").alias("kind"), F.explode("i.action_steps_en").alias("text"))
    return one.unionByName(steps).unionByName(f.select("feedback_id", F.lit("summary").alias("kind"), F.col("overall_summary_en").alias("text"))).where("text IS NOT NULL")


@query("flt01", "SELECT vec_id FROM embeddings WHERE len(embedding) >= 64")
def flt01(spark: SparkSession, d: str) -> DataFrame:
    """Frames with enough points."""
    return table(spark, d, "embeddings").where("size(embedding) >= 64").select("vec_id")


@query("flt02", "SELECT vec_id FROM embeddings WHERE embedding[1] > -0.2 AND embedding[1] < 0.2 AND embedding[2] > -0.2 AND embedding[2] < 0.2")
def flt02(spark: SparkSession, d: str) -> DataFrame:
    """Values within their sanity range, ends left out."""
    return table(spark, d, "embeddings").where("embedding[0] > -0.2 AND embedding[0] < 0.2 AND embedding[1] > -0.2 AND embedding[1] < 0.2").select("vec_id")


@query("flt03", "SELECT c_custkey FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey WHERE s_acctbal IS NOT NULL AND c_acctbal IS NOT NULL")
def flt03(spark: SparkSession, d: str) -> DataFrame:
    """Rows that have all modalities asked for."""
    x = prj02(spark, d)
    return x.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in ("vis__balance", "sp__balance")])).select(F.col("id").alias("c_custkey"))


@query("flt04", "SELECT label_id, type FROM (SELECT DISTINCT ON (label_id) * FROM test_rq2_labels) WHERE type IS NOT NULL AND start IS NOT NULL")
def flt04(spark: SparkSession, d: str) -> DataFrame:
    """Rows without nulls in a subset of columns."""
    return table(spark, d, "test_rq2_labels").dropDuplicates(["label_id"]).dropna(subset=["type", "start"]).select("label_id", "type")


@query("flt05", "SELECT evidence_id FROM (SELECT DISTINCT evidence_id, key, type FROM evidence) WHERE type IN ('gaze', 'head') AND key IN (SELECT key FROM transcript)")
def flt05(spark: SparkSession, d: str) -> DataFrame:
    """Membership in a list and in another table."""
    e = table(spark, d, "evidence").where("type IN ('gaze', 'head')").join(table(spark, d, "transcript").select("key"), "key", "left_semi")
    return e.select("evidence_id", "key", "type").distinct().select("evidence_id")


@query("flt06", "SELECT p_brand, p_size, CASE WHEN count(*) >= 5 THEN round(avg(p_retailprice), 6) END AS mean FROM part GROUP BY 1, 2")
def flt06(spark: SparkSession, d: str) -> DataFrame:
    """A statistic only where there are enough rows."""
    return table(spark, d, "part").groupBy("p_brand", "p_size").agg(F.when(F.count("*") >= 5, F.round(F.avg("p_retailprice"), 6)).alias("mean"))


@query("flt07", "SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0 AND c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def flt07(spark: SparkSession, d: str) -> DataFrame:
    """Test ids without those used for fitting."""
    from gleanstone.operators.guards import without_leaks

    c = table(spark, d, "customer").select("c_custkey")
    return without_leaks(c.where("c_custkey % 5 = 0"), c.where("c_custkey % 3 = 0"), "c_custkey")


@query("flt08", "SELECT DISTINCT label_id, trim(label, ' ') AS label FROM test_rq2_labels WHERE trim(label, ' ') <> '' AND lower(trim(label, ' ')) IN (SELECT label_en FROM label_vocab)")
def flt08(spark: SparkSession, d: str) -> DataFrame:
    """Labels that are filled in and belong to the vocabulary."""
    v = table(spark, d, "label_vocab").select(F.col("label_en").alias("k"))
    return table(spark, d, "test_rq2_labels").where("trim(label) <> ''").select("label_id", F.trim("label").alias("label"), F.lower(F.trim("label")).alias("k")).join(v, "k", "left_semi").select("label_id", "label").distinct()


@query("flt09", "SELECT DISTINCT key FROM evidence WHERE NOT regexp_matches(key, '^[0-9a-f]{24}_')")
def flt09(spark: SparkSession, d: str) -> DataFrame:
    """Clips that may leave the house: none of the dataset's own."""
    return table(spark, d, "evidence").where(~F.col("key").rlike("^[0-9a-f]{24}_")).select("key").distinct()


@query("flt10", "SELECT DISTINCT evidence_id FROM evidence WHERE category = 'visual' AND type IN ('gaze', 'head', 'hand', 'face')")
def flt10(spark: SparkSession, d: str) -> DataFrame:
    """A filter that reaches the scan."""
    return table(spark, d, "evidence").where("category = 'visual' AND type IN ('gaze', 'head', 'hand', 'face')").select("evidence_id").distinct()
