"""Consensus queries on the audit sample and the staged labels (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanstone.llm import consensus as C
from gleanstone.session import cut, table


def audit_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, rater, label (0 true, 1 false): one row for each answered place of each audit item."""
    a = table(spark, sf_dir, "hallucination_audit_sample").dropDuplicates(["audit_id"])
    places = F.inline(F.array(*[F.struct(F.col(f"rater{i}_id").alias("rater"), F.col(f"rater{i}_true_false").alias("answer"), F.lit(i).alias("place")) for i in (1, 2)]))
    v = a.select(F.col("audit_id").alias("item"), places).select("item", F.coalesce("rater", F.concat(F.lit("unnamed in place "), F.col("place"))).alias("rater"), C.truth_answer(F.col("answer")).alias("label"))
    return v.dropna().groupBy("item", "rater").agg(F.max("label").alias("label"))


def vocabulary(spark: SparkSession, sf_dir: str) -> tuple[list[str], list[tuple[str, int]]]:
    """The classes, and their spellings: the model's own columns, so few by nature."""
    rows = table(spark, sf_dir, "label_vocab").dropDuplicates(["type"]).where("type is not null").orderBy("type").select("type", *[C.plain_label(F.col(c)).alias(c) for c in ("label_th", "label_en")], C.plain_label(F.col("type")).alias("code")).collect()
    return [r["type"] for r in rows], [(r[c], k) for k, r in enumerate(rows) for c in ("code", "label_th", "label_en") if r[c]]


def staged_votes(spark: SparkSession, sf_dir: str, forms: list[tuple[str, int]]) -> DataFrame:
    """item, rater, label: each rater's latest usable label of each staged item."""
    r = table(spark, sf_dir, "test_rq2_labels").select("label_id", "item_id", "rater_id", "type", "label", "labelled_at")
    r = C.spelled_once(C.spelled_once(r.where("item_id is not null"), "label", forms, "by_label"), "type", forms, "by_type")
    r = r.withColumn("k", F.coalesce("by_label", "by_type")).where("k is not null")
    last = Window.partitionBy("item_id", "rater_id").orderBy(F.col("labelled_at").desc_nulls_last(), F.col("label_id").desc())
    return r.withColumn("n", F.row_number().over(last)).where("n = 1").select(F.col("item_id").cast("string").alias("item"), F.coalesce("rater_id", F.lit("unnamed")).alias("rater"), F.col("k").alias("label"))


def _fits(spark: SparkSession, sf_dir: str) -> tuple[C.Consensus, C.Consensus, list[str]]:
    names, forms = vocabulary(spark, sf_dir)
    staged = C.fit(staged_votes(spark, sf_dir, forms), len(names))
    known = cut(C.carried(staged, len(names), 2))
    return C.fit(audit_votes(spark, sf_dir), 2, known=known), staged, names


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consensus label of each audit item and each staged item; raters' staged reliability serves the audit."""
    audit, staged, names = _fits(spark, sf_dir)
    a = C.labels(audit).select(F.lit("audit").alias("task"), "item", F.when(F.col("label") == 0, "TRUE").otherwise("FALSE").alias("label"))
    s = C.labels(staged).select(F.lit("rq2").alias("task"), "item", F.get(F.array(*map(F.lit, names)), F.col("label")).alias("label"))
    return a.unionByName(s)


def p2_raters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each rater's posterior accuracy in either task, with its interval; and how the task's fit ended."""
    audit, staged, _ = _fits(spark, sf_dir)
    out = [C.reliability(c).withColumns({"task": F.lit(task), "rounds": F.lit(c.rounds), "converged": F.lit(c.converged)}) for task, c in (("audit", audit), ("rq2", staged))]
    return out[0].unionByName(out[1]).select("task", "rater", *[F.round(c, 4).alias(c) for c in ("accuracy", "low", "high", "votes")], "rounds", "converged")


def p2_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Krippendorff's alpha of either task."""
    _, forms = vocabulary(spark, sf_dir)
    out = [C.krippendorff(v).withColumn("task", F.lit(t)) for t, v in (("audit", audit_votes(spark, sf_dir)), ("rq2", staged_votes(spark, sf_dir, forms)))]
    return out[0].unionByName(out[1]).select("task", F.round("alpha", 6).alias("alpha"), "items", "votes")


_PLAIN = "regexp_replace(regexp_replace(lower(regexp_replace({}, '[​ ﻿]', ' ', 'g')), '[(\\[].*$|;.*$|\\s[-–—~]\\s?.*$|~.*$', '', 'g'), '[\\s_\\-.,!?:''\"]+', '', 'g')"
_ANSWER = "CASE WHEN {0} IN ('true', 't', '1', 'yes', 'y') THEN 'TRUE' WHEN {0} IN ('false', 'f', '0', 'no', 'n') THEN 'FALSE' END".format("lower(regexp_replace({}, '[\\s​ .!]+', '', 'g'))")
AGREEMENT_SQL = f"""
WITH a AS (SELECT DISTINCT ON (audit_id) * FROM hallucination_audit_sample),
audit AS (SELECT audit_id AS item, rater, min(label) AS label FROM (
    SELECT audit_id, coalesce(rater1_id, 'unnamed in place 1') AS rater, {_ANSWER.format('rater1_true_false', 'rater1_true_false')} AS label FROM a
    UNION ALL SELECT audit_id, coalesce(rater2_id, 'unnamed in place 2'), {_ANSWER.format('rater2_true_false', 'rater2_true_false')} FROM a) WHERE label IS NOT NULL GROUP BY 1, 2),
forms AS (SELECT type, unnest([{_PLAIN.format('type')}, {_PLAIN.format('label_th')}, {_PLAIN.format('label_en')}]) AS f FROM label_vocab),
texts AS (SELECT DISTINCT t, {_PLAIN.format('t')} AS p FROM (SELECT label AS t FROM test_rq2_labels UNION SELECT type FROM test_rq2_labels) WHERE t IS NOT NULL),
near AS (SELECT t, type, levenshtein(p, f) AS d FROM texts, forms WHERE levenshtein(p, f) <= 2 AND levenshtein(p, f) <= 0.25 * length(f)),
best AS (SELECT t, min(type) AS k FROM near n WHERE d = (SELECT min(d) FROM near m WHERE m.t = n.t) GROUP BY t HAVING count(DISTINCT type) = 1),
votes AS (SELECT item_id, coalesce(rater_id, 'unnamed') AS rater, coalesce(x.k, y.k) AS k, labelled_at, label_id FROM test_rq2_labels l LEFT JOIN best x ON x.t = l.label LEFT JOIN best y ON y.t = l.type WHERE item_id IS NOT NULL),
last AS (SELECT *, row_number() OVER (PARTITION BY item_id, rater ORDER BY labelled_at DESC NULLS LAST, label_id DESC) AS n FROM votes WHERE k IS NOT NULL),
v AS (SELECT 'audit' AS task, item, label FROM audit UNION ALL SELECT 'rq2', CAST(item_id AS VARCHAR), k FROM last WHERE n = 1),
per AS (SELECT task, item, label, count(*) AS n FROM v GROUP BY 1, 2, 3),
size AS (SELECT task, item, sum(n) AS m, sum(n * (n - 1)) AS same FROM per GROUP BY 1, 2 HAVING sum(n) > 1),
o AS (SELECT task, sum((m * (m - 1) - same) / (m - 1)) AS d, sum(m) AS t, count(*) AS items FROM size GROUP BY 1),
e AS (SELECT task, sum(n * n) AS sq FROM (SELECT p.task, p.label, sum(p.n) AS n FROM per p JOIN size s ON p.task = s.task AND p.item = s.item GROUP BY 1, 2) GROUP BY 1)
SELECT o.task, round(1 - d / ((t * t - sq) / (t - 1)), 6) AS alpha, items, CAST(t AS BIGINT) AS votes FROM o JOIN e ON o.task = e.task
"""
