"""Queries of statistics: correlation, bootstrap, agreement, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanstone.functions.draws import draw, draw_sql
from gleanstone.operators import statistics as S
from gleanstone.operators.ranking import numbered
from gleanstone.plans.base import query
from gleanstone.plans.joins import CLAIMS, claims
from gleanstone.session import cut, table

PAIRS = "p AS (SELECT o_custkey AS id, c_mktsegment AS seg, avg(o_totalprice) AS x, count(*)::DOUBLE AS z, any_value(c_acctbal) AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """id, seg, x (mean price), z (orders), y (balance)."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("seg"), F.col("c_acctbal").alias("y"))
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.avg("o_totalprice").alias("x"), F.count("*").cast("double").alias("z"))
    return o.join(c, "id").select("id", "seg", "x", "z", "y")


def _ranked(v: str, by: str) -> str:
    part = f"PARTITION BY {by} " if by else ""
    tie = f"PARTITION BY {by}, {v}" if by else f"PARTITION BY {v}"
    return f"rank() OVER ({part}ORDER BY {v}) + (count(*) OVER ({tie}) - 1) / 2"


@query("st01", f"WITH {PAIRS}, r AS (SELECT seg, {_ranked('x', 'seg')} AS rx, {_ranked('y', 'seg')} AS ry FROM p) SELECT seg, count(*) AS n, round(corr(rx, ry), 9) AS rho FROM r GROUP BY seg")
def st01(spark: SparkSession, d: str) -> DataFrame:
    """Spearman's rank correlation in each group, ties sharing ranks."""
    return S.spearman(pairs(spark, d), ["seg"], "x", "y").select("seg", "n", F.round("rho", 9).alias("rho"))


RESAMPLES = 2000
BOOT_SQL = f"""WITH {PAIRS}, i AS (SELECT *, row_number() OVER (PARTITION BY seg ORDER BY id) - 1 AS k, count(*) OVER (PARTITION BY seg) AS n FROM p), b AS (SELECT unnest(range({RESAMPLES})) AS b),
s AS (SELECT b, seg, k AS slot, {draw_sql('b', 'seg', 'k')} % n AS pick FROM i, b), g AS (SELECT s.b, s.seg, i.x, i.y, i.z FROM s JOIN i ON s.seg = i.seg AND s.pick = i.k)"""


def resamples(spark: SparkSession, d: str, segs: list[str] | None = None) -> DataFrame:
    """Bootstrap weights: b, seg, w (how often the row was drawn), x, y, z.

    Every group is drawn from with replacement, the draws a hash of resample, group and slot. They
    are made and counted where their resample is, so that rows drawn again aren't moved.
    """
    p = pairs(spark, d)
    i = cut(numbered(p.where(F.col("seg").isin(segs)) if segs else p, ["seg"], ["id"], "k").withColumn("k", F.col("k") - 1))
    parts = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    s = i.groupBy("seg").agg(F.count("*").alias("n")).select("seg", "n", F.explode(F.sequence(F.lit(0), F.lit(RESAMPLES - 1))).alias("b")).repartition(parts, "b", "seg")
    s = s.select("b", "seg", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("k"))
    s = s.select("b", "seg", (draw(F.col("b"), F.col("seg"), F.col("k")) % F.col("n")).alias("k")).groupBy("b", "seg", "k").agg(F.count("*").alias("w"))
    # Catalyst takes the draws for a small table and would broadcast them
    return s.join(i.select("seg", "k", "x", "y", "z").hint("shuffle_hash"), ["seg", "k"])


@query("st02", BOOT_SQL + f""", r AS (SELECT b, seg, {_ranked('x', 'b, seg')} AS rx, {_ranked('y', 'b, seg')} AS ry FROM g), c AS (SELECT b, seg, corr(rx, ry) AS rho FROM r GROUP BY 1, 2)
SELECT seg, round(quantile_cont(rho, 0.025), 9) AS low, round(quantile_cont(rho, 0.975), 9) AS high FROM c WHERE rho IS NOT NULL GROUP BY seg""")
def st02(spark: SparkSession, d: str) -> DataFrame:
    """Bootstrap interval of the rank correlation."""
    c = S.bootstrap_rho(pairs(spark, d), "seg", "id", ["x", "y"], RESAMPLES)
    return c.groupBy("seg").agg(*[F.round(F.expr(f"percentile(x, {p})"), 9).alias(n) for n, p in (("low", 0.025), ("high", 0.975))])


@query("st03", BOOT_SQL + f""", r AS (SELECT b, seg, {_ranked('x', 'b, seg')} AS rx, {_ranked('z', 'b, seg')} AS rz, {_ranked('y', 'b, seg')} AS ry FROM g), c AS (SELECT b, seg, corr(rx, ry) - corr(rz, ry) AS delta FROM r GROUP BY 1, 2),
q AS (SELECT seg, quantile_cont(delta, 0.025) AS low, quantile_cont(delta, 0.975) AS high FROM c WHERE delta IS NOT NULL GROUP BY seg) SELECT seg, round(low, 9) AS low, round(high, 9) AS high, CASE WHEN low > 0 THEN 'yes' WHEN high < 0 THEN 'no (worse)' ELSE 'not shown' END AS verdict FROM q""")
def st03(spark: SparkSession, d: str) -> DataFrame:
    """Paired bootstrap of the difference of two correlations on shared draws."""
    c = S.bootstrap_rho(pairs(spark, d), "seg", "id", ["x", "z", "y"], RESAMPLES).select("seg", (F.col("x") - F.col("z")).alias("delta"))
    q = c.groupBy("seg").agg(F.expr("percentile(delta, 0.025)").alias("low"), F.expr("percentile(delta, 0.975)").alias("high"))
    return q.select("seg", F.round("low", 9).alias("low"), F.round("high", 9).alias("high"), S.verdict(F.col("low"), F.col("high")).alias("verdict"))


GRADES = "g AS (SELECT l_returnflag, l_linenumber AS a, CAST(l_quantity AS INTEGER) % 7 + 1 AS b FROM lineitem)"


@query("st04", f"WITH {GRADES}, d AS (SELECT * FROM g WHERE a BETWEEN 1 AND 5 AND b BETWEEN 1 AND 5), o AS (SELECT l_returnflag, count(*) AS n, avg((a - b) * (a - b)) AS d, avg(a) AS ma, avg(b) AS mb, var_pop(a) AS va, var_pop(b) AS vb FROM d GROUP BY 1) SELECT l_returnflag, n, round(1 - d / (va + vb + (ma - mb) * (ma - mb)), 9) AS qwk FROM o")
def st04(spark: SparkSession, d: str) -> DataFrame:
    """Kappa with quadratic weights over the labels 1 to 5."""
    g = table(spark, d, "lineitem").select("l_returnflag", F.col("l_linenumber").alias("a"), (F.col("l_quantity").cast("int") % 7 + 1).alias("b"))
    return S.quadratic_kappa(g, "a", "b", ["l_returnflag"], 1, 5).select("l_returnflag", "n", F.round("qwk", 9).alias("qwk"))


RATER_PAIRS = "r AS (SELECT DISTINCT item_id, rater_id, type FROM test_rq2_labels WHERE type IS NOT NULL), t AS (SELECT a.type AS a, b.type AS b FROM r a JOIN r b ON a.item_id = b.item_id AND a.rater_id < b.rater_id)"
KAPPA = "n AS (SELECT count(*) AS n, avg(CAST(a = b AS DOUBLE)) AS po FROM t), e AS (SELECT sum(x.n * y.n) AS e FROM (SELECT a AS l, count(*) AS n FROM t GROUP BY 1) x JOIN (SELECT b AS l, count(*) AS n FROM t GROUP BY 1) y USING (l))"


@query("st05", f"WITH {RATER_PAIRS}, {KAPPA} SELECT n, round(po, 9) AS agree, round((po - e / (n * n)) / (1 - e / (n * n)), 9) AS kappa FROM n, e")
def st05(spark: SparkSession, d: str) -> DataFrame:
    """Cohen's kappa of two raters' labels."""
    from gleanstone.plans.joins import jn05

    return S.cohen(jn05(spark, d), "type_a", "type_b").select("n", F.round("agree", 9).alias("agree"), F.round("kappa", 9).alias("kappa"))


YES = "lower(trim({})) IN ('true', 't', '1', 'yes', 'y')"
AUDIT = f"t AS (SELECT DISTINCT ON (audit_id) {YES.format('rater1_true_false')} AS a, {YES.format('rater2_true_false')} AS b FROM hallucination_audit_sample WHERE trim(rater1_true_false) NOT IN ('', '?') AND trim(rater2_true_false) NOT IN ('', '?'))"


@query("st06", f"WITH {AUDIT}, {KAPPA} SELECT n, round(po, 9) AS agree, round((po - e / (n * n)) / (1 - e / (n * n)), 9) AS kappa FROM n, e")
def st06(spark: SparkSession, d: str) -> DataFrame:
    """Kappa and agreement of the two audit answers."""
    yes = lambda c: F.lower(F.trim(c)).isin("true", "t", "1", "yes", "y")
    t = table(spark, d, "hallucination_audit_sample").where("trim(rater1_true_false) NOT IN ('', '?') AND trim(rater2_true_false) NOT IN ('', '?')").dropDuplicates(["audit_id"])
    return S.cohen(t.select(yes("rater1_true_false").alias("a"), yes("rater2_true_false").alias("b")), "a", "b").select("n", F.round("agree", 9).alias("agree"), F.round("kappa", 9).alias("kappa"))


@query("st07", """WITH d AS (SELECT p_brand AS s, l_returnflag AS r, avg(l_quantity) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), k AS (SELECT count(DISTINCT r) AS k FROM d), f AS (SELECT * FROM d WHERE s IN (SELECT s FROM d GROUP BY 1 HAVING count(*) = (SELECT k FROM k))),
a AS (SELECT count(*) AS n, sum(t) AS g, sum(q) AS q, sum(t * t) AS tt FROM (SELECT s, sum(v) AS t, sum(v * v) AS q FROM f GROUP BY 1)), c AS (SELECT sum(c * c) AS cc FROM (SELECT r, sum(v) AS c FROM f GROUP BY 1)),
m AS (SELECT n, k, (tt / k - g * g / (n * k)) / (n - 1) AS msr, (cc / n - g * g / (n * k)) / (k - 1) AS msc, (q - tt / k - cc / n + g * g / (n * k)) / ((n - 1) * (k - 1)) AS mse FROM a, c, k)
SELECT n, CAST(k AS INTEGER) AS raters, round((msr - mse) / (msr + (k - 1) * mse + k * (msc - mse) / n), 6) AS icc FROM m""")
def st07(spark: SparkSession, d: str) -> DataFrame:
    """Intraclass correlation of raters (flags) over subjects (brands)."""
    l = table(spark, d, "lineitem").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")  # noqa: E741
    return S.icc2(l, "p_brand", "l_returnflag", "l_quantity").select("n", "raters", F.round("icc", 6).alias("icc"))


@query("st08", f"""WITH {PAIRS}, r AS (SELECT {_ranked('x', '')} AS rx, {_ranked('y', '')} AS ry, {_ranked('z', '')} AS rz FROM p), c AS (SELECT corr(rx, ry) AS xy, corr(rx, rz) AS xz, corr(ry, rz) AS yz FROM r) SELECT round(xy, 9) AS rho, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 9) AS partial FROM c""")
def st08(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation with a third variable held constant: the correlation of the residuals of the ranks."""
    from gleanstone.operators.ranking import average_rank

    r = pairs(spark, d)
    for v in "xyz":
        r = average_rank(r, v, f"r{v}")
    c = r.agg(F.corr("rx", "ry").alias("xy"), F.corr("rx", "rz").alias("xz"), F.corr("ry", "rz").alias("yz"))
    xy, xz, yz = F.col("xy"), F.col("xz"), F.col("yz")
    return c.select(F.round(xy, 9).alias("rho"), F.round((xy - xz * yz) / F.sqrt((1 - xz * xz) * (1 - yz * yz)), 9).alias("partial"))


@query("st09", f"WITH {PAIRS}, r AS (SELECT seg, {_ranked('x', 'seg')} AS rx, {_ranked('y', 'seg')} AS ry, {_ranked('z', 'seg')} AS rz FROM p) SELECT seg, round(corr(rx, rz), 9) AS x_length, round(corr(ry, rz), 9) AS y_length FROM r GROUP BY seg")
def st09(spark: SparkSession, d: str) -> DataFrame:
    """Two measures held against length."""
    p = pairs(spark, d)
    a = S.spearman(p, ["seg"], "x", "z").select("seg", F.round("rho", 9).alias("x_length"))
    return a.join(S.spearman(p, ["seg"], "y", "z").select("seg", F.round("rho", 9).alias("y_length")), "seg")


@query("st10", "SELECT c_nationkey, round((avg(c_acctbal) FILTER (c_mktsegment = 'BUILDING') - avg(c_acctbal) FILTER (c_mktsegment <> 'BUILDING')) / stddev_samp(c_acctbal), 9) AS smd FROM customer GROUP BY 1")
def st10(spark: SparkSession, d: str) -> DataFrame:
    """Standardised mean difference over the deviation of all rows."""
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.round(S.smd(F.col("c_acctbal"), F.col("c_mktsegment") == "BUILDING"), 9).alias("smd"))


@query("st11", BOOT_SQL + """, m AS (SELECT b, seg, avg(x) AS m FROM g GROUP BY 1, 2), q AS (SELECT quantile_cont(u.m - v.m, 0.025) AS low, quantile_cont(u.m - v.m, 0.975) AS high FROM m u JOIN m v USING (b) WHERE u.seg = 'BUILDING' AND v.seg = 'MACHINERY') SELECT round(low, 6) AS low, round(high, 6) AS high, CASE WHEN low > 0 THEN 'yes' WHEN high < 0 THEN 'no (worse)' ELSE 'not shown' END AS verdict FROM q""")
def st11(spark: SparkSession, d: str) -> DataFrame:
    """Bootstrap of the difference of two groups' means."""
    m = cut(resamples(spark, d, ["BUILDING", "MACHINERY"]).where("x IS NOT NULL").groupBy("b", "seg").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m")))
    diff = m.where("seg = 'BUILDING'").select("b", F.col("m").alias("u")).join(m.where("seg = 'MACHINERY'").select("b", F.col("m").alias("v")), "b").select((F.col("u") - F.col("v")).alias("d"))
    q = diff.agg(F.expr("percentile(d, 0.025)").alias("low"), F.expr("percentile(d, 0.975)").alias("high"))
    return q.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), S.verdict(F.col("low"), F.col("high")).alias("verdict"))


@query("st12", f"WITH {PAIRS}, u AS (SELECT seg, 'x' AS measure, x AS v, y FROM p UNION ALL SELECT seg, 'z', z, y FROM p), r AS (SELECT seg, measure, {_ranked('v', 'seg, measure')} AS rx, {_ranked('y', 'seg, measure')} AS ry FROM u) SELECT seg, measure, count(*) AS n, round(corr(rx, ry), 9) AS rho FROM r GROUP BY 1, 2")
def st12(spark: SparkSession, d: str) -> DataFrame:
    """Grid of group and measure against a target."""
    u = pairs(spark, d).unpivot(["seg", "y"], ["x", "z"], "measure", "v")
    return S.spearman(u, ["seg", "measure"], "v", "y").select("seg", "measure", "n", F.round("rho", 9).alias("rho"))


@query("st13", f"WITH {PAIRS}, r AS (SELECT seg, z, x, y, {_ranked('x', 'seg')} AS rx, {_ranked('y', 'seg')} AS ry, {_ranked('z', 'seg')} AS rz FROM p) SELECT seg, round(corr(rx, rz), 9) AS system_rho, round(corr(ry, rz), 9) AS human_rho, round((avg(x) FILTER (z > 10) - avg(x) FILTER (z <= 10)) / stddev_samp(x), 9) AS system_smd, round((avg(y) FILTER (z > 10) - avg(y) FILTER (z <= 10)) / stddev_samp(y), 9) AS human_smd FROM r GROUP BY seg")
def st13(spark: SparkSession, d: str) -> DataFrame:
    """Bias of a system and of people by an attribute."""
    p = pairs(spark, d)
    m = p.groupBy("seg").agg(*[F.round(S.smd(F.col(c), F.col("z") > 10), 9).alias(n) for c, n in (("x", "system_smd"), ("y", "human_smd"))])
    return st09(spark, d).withColumnsRenamed({"x_length": "system_rho", "y_length": "human_rho"}).join(m, "seg")


@query("st14", "WITH r AS (SELECT DISTINCT item_id, rater_id, type FROM test_rq2_labels WHERE type IS NOT NULL), c AS (SELECT item_id, arg_min(type, (-n, type)) AS top FROM (SELECT item_id, type, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY 1) SELECT rater_id, count(*) AS n, round(avg(CAST(type = top AS DOUBLE)), 9) AS accuracy FROM r JOIN c USING (item_id) GROUP BY 1")
def st14(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of each rater against the commonest label."""
    r = table(spark, d, "test_rq2_labels").where("type IS NOT NULL").select("item_id", "rater_id", "type").distinct()
    c = r.groupBy("item_id", "type").agg(F.count("*").alias("n")).groupBy("item_id").agg(F.min_by("type", F.struct(-F.col("n"), "type")).alias("top"))
    return r.join(c, "item_id").groupBy("rater_id").agg(F.count("*").alias("n"), F.round(F.avg((F.col("type") == F.col("top")).cast("double")), 9).alias("accuracy"))


@query("st15", """WITH x AS (SELECT DISTINCT lower(trim(key)) AS k, approach, dimension FROM hallucination_claims WHERE dimension IS NOT NULL), a AS (SELECT k, approach, list(dimension) AS l FROM x GROUP BY 1, 2),
j AS (SELECT p.k, len(list_intersect(p.l, q.l)) / len(list_distinct(list_concat(p.l, q.l))) AS j FROM a p JOIN a q ON p.k = q.k AND p.approach < q.approach) SELECT k AS key, count(*) AS n_pairs, round(avg(j), 9) AS mean_jaccard, round(stddev_pop(j), 6) AS spread FROM j GROUP BY k""")
def st15(spark: SparkSession, d: str) -> DataFrame:
    """Stability over runs: mean and spread of the pairs' Jaccard index."""
    from gleanstone.plans.ordering import set05

    return set05(spark, d).groupBy("key").agg(F.count("*").alias("n_pairs"), F.round(F.avg("jaccard"), 9).alias("mean_jaccard"), F.round(F.stddev_pop("jaccard"), 6).alias("spread"))


@query("st16", "WITH r AS (SELECT s_acctbal AS v FROM supplier) SELECT c_custkey, round((SELECT avg(CAST(v < c_acctbal AS DOUBLE)) * 100 + avg(CAST(v = c_acctbal AS DOUBLE)) * 50 FROM r), 6) AS percentile FROM customer")
def st16(spark: SparkSession, d: str) -> DataFrame:
    """Percentile in a reference distribution, ties counting half: positions in the merged order, no pairs."""
    from gleanstone.operators.ranking import average_rank

    ref = table(spark, d, "supplier").select(F.lit(None).cast("bigint").alias("id"), F.col("s_acctbal").alias("v"), F.lit(1).alias("r"))
    both = ref.unionByName(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("v"), F.lit(0).alias("r")))
    n = ref.count()
    all_ranks, own = average_rank(both, "v", "a"), average_rank(both.where("r = 0"), "v", "b")
    x = all_ranks.where("r = 0").select("id", "a").join(own.select("id", "b"), "id")
    return x.select(F.col("id").alias("c_custkey"), F.round((F.col("a") - F.col("b")) / max(n, 1) * 100, 6).alias("percentile"))


@query("st17", "SELECT p_partkey, abs((p_retailprice - m) / s) > 3 OR abs((p_size - m2) / s2) > 1.5 AS unusual FROM part, (SELECT avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS s, avg(p_size) AS m2, stddev_pop(p_size) AS s2 FROM part)")
def st17(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose z scores lie far out."""
    p = table(spark, d, "part")
    m = p.agg(F.avg("p_retailprice").alias("m"), F.stddev_pop("p_retailprice").alias("s"), F.avg("p_size").alias("m2"), F.stddev_pop("p_size").alias("s2")).first()
    if m["m"] is None:
        return p.select("p_partkey", F.lit(None).cast("boolean").alias("unusual"))
    return p.select("p_partkey", ((F.abs((F.col("p_retailprice") - m["m"]) / m["s"]) > 3) | (F.abs((F.col("p_size") - m["m2"]) / m["s2"]) > 1.5)).alias("unusual"))


@query("st18", "WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), m AS (SELECT i, avg(v) AS m, stddev_pop(v) AS s FROM x GROUP BY 1) SELECT vec_id, CAST(i % 4 AS INTEGER) AS feature_group, round(sum((i + 1) / 64 * (v - m) / s), 6) AS contribution FROM x JOIN m USING (i) GROUP BY 1, 2")
def st18(spark: SparkSession, d: str) -> DataFrame:
    """Coefficient times z score, summed by group of features."""
    x = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).withColumn("v", F.col("v").cast("double"))
    m = x.groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    j = x.join(m, "i")
    return j.groupBy("vec_id", (F.col("i") % 4).alias("feature_group")).agg(F.round(F.sum((F.col("i") + 1) / 64 * (F.col("v") - F.col("m")) / F.col("s")), 6).alias("contribution"))


@query("ver17", f"WITH {CLAIMS}, r AS (SELECT lower(trim(key)) AS k, approach, count(*) FILTER (verdict IN ('contradicted', 'unsupported', 'out_of_range')) / nullif(count(*) FILTER (verdict <> 'not_checkable'), 0) AS rate FROM c GROUP BY 1, 2), d AS (SELECT a.k, a.rate - b.rate AS d FROM r a JOIN r b ON a.k = b.k WHERE a.approach = 'grounded' AND b.approach = 'hybrid' AND a.rate IS NOT NULL AND b.rate IS NOT NULL),\ni AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS j, count(*) OVER () AS n FROM d), b AS (SELECT unnest(range({RESAMPLES})) AS b), m AS (SELECT b, avg(y.d) AS m FROM (SELECT b, {draw_sql('b', 'j')} % n AS pick FROM i, b) s JOIN i y ON s.pick = y.j GROUP BY b)\nSELECT round(quantile_cont(m, 0.025), 9) AS low, round(quantile_cont(m, 0.975), 9) AS high FROM m WHERE (SELECT count(*) FROM d) >= 3")
def ver17(spark: SparkSession, d: str) -> DataFrame:
    """Paired bootstrap of the difference of two approaches' rates over clips."""
    from gleanstone.operators.ranking import global_row_number

    v = F.col("verdict")
    rate = F.try_divide(F.count_if(v.isin("contradicted", "unsupported", "out_of_range")), F.count_if(v != "not_checkable"))
    r = claims(spark, d).groupBy(F.lower(F.trim("key")).alias("k"), "approach").agg(rate.alias("rate")).where("rate IS NOT NULL")
    a, b = r.where("approach = 'grounded'").select("k", F.col("rate").alias("a")), r.where("approach = 'hybrid'").select("k", F.col("rate").alias("b"))
    i = global_row_number(a.join(b, "k").select("k", (F.col("a") - F.col("b")).alias("d")), ["k"], "j").select((F.col("j") - 1).alias("j"), "d")
    n = i.count()
    s = i.select("j", F.explode(F.sequence(F.lit(0), F.lit(RESAMPLES - 1))).alias("b")).select("b", (draw(F.col("b"), F.col("j")) % max(n, 1)).alias("j"))
    m = s.join(i.hint("shuffle_hash"), "j").groupBy("b").agg(F.avg("d").alias("m"))
    return m.agg(*[F.when(F.lit(n >= 3), F.round(F.expr(f"percentile(m, {p})"), 9)).alias(c) for c, p in (("low", 0.025), ("high", 0.975))])
