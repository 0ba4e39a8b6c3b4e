"""Queries of regression and cross-validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanstone.functions.draws import draw
from gleanstone.operators import regression as R
from gleanstone.operators import statistics as S
from gleanstone.plans.base import query
from gleanstone.session import cut, table

FEATURES = ["mean_price", "n_orders", "max_price", "min_price"]


def people(spark: SparkSession, d: str) -> DataFrame:
    """id, four features of the orders, target (balance) and segment."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.avg("o_totalprice").alias("mean_price"), F.count("*").cast("double").alias("n_orders"), F.max("o_totalprice").alias("max_price"), F.min("o_totalprice").alias("min_price"))
    return o.join(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("target"), "c_mktsegment", F.lit("s").alias("seg")), "id")


def _model_rows(spark: SparkSession, m: R.Ridge | None, name: str) -> DataFrame:
    rows = [(name, f, round(float(c), 6)) for f, c in zip(m.features, m.coef)] + [(name, "(intercept)", round(m.intercept, 6)), (name, "(alpha)", round(m.alpha, 6))] if m else []
    return spark.createDataFrame(rows, "model string, feature string, value double")


@query("ml01")
def ml01(spark: SparkSession, d: str) -> DataFrame:
    """Imputed, standardised ridge regression, its penalty chosen by leave-one-out."""
    return _model_rows(spark, R.fit(people(spark, d), "id", FEATURES, "target"), "all")


@query("ml02")
def ml02(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold predictions of five folds, repeated, and their rank correlation."""
    o = R.out_of_fold(people(spark, d), "id", FEATURES, "target", 5, 20)
    return S.spearman(o, ["repeat"], "pred", "y").select("repeat", "n", F.round("rho", 6).alias("rho"))


@query("ml03")
def ml03(spark: SparkSession, d: str) -> DataFrame:
    """Fit on one segment, evaluate on the others, only where there are enough rows."""
    p = people(spark, d)
    m = R.fit(p.where("c_mktsegment = 'BUILDING'"), "id", FEATURES, "target", 1.0, least=20)
    if m is None:
        return spark.createDataFrame([], "c_mktsegment string, n bigint, rho double")
    return S.spearman(p.where("c_mktsegment <> 'BUILDING'").withColumn("pred", m.predict()), ["c_mktsegment"], "pred", "target").select("c_mktsegment", "n", F.round("rho", 6).alias("rho"))


@query("ml04")
def ml04(spark: SparkSession, d: str) -> DataFrame:
    """Several learners on one split: elastic net, forest and boosted trees of the ML library, and ridge."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor

    p = people(spark, d).withColumn("fold", draw(0, F.col("id")) % 5)
    v = VectorAssembler(inputCols=FEATURES, outputCol="x", handleInvalid="skip").transform(p)
    fit, test = v.where("fold <> 0"), v.where("fold = 0")
    learners = {
        "elastic_net": LinearRegression(featuresCol="x", labelCol="target", predictionCol="pred", regParam=1.0, elasticNetParam=0.5),
        "forest": RandomForestRegressor(featuresCol="x", labelCol="target", predictionCol="pred", numTrees=20, minInstancesPerNode=5, featureSubsetStrategy="0.33", seed=0),
        "boosted": GBTRegressor(featuresCol="x", labelCol="target", predictionCol="pred", maxIter=10, maxDepth=3, seed=0),
    }
    parts = [x.fit(fit).transform(test).select(F.lit(n).alias("learner"), "target", "pred") for n, x in learners.items()]
    m = R.fit(p.where("fold <> 0"), "id", FEATURES, "target", 1.0)
    if m:
        parts.append(p.where("fold = 0").select(F.lit("ridge").alias("learner"), "target", m.predict().alias("pred")))
    return S.spearman(reduce(DataFrame.unionByName, parts), ["learner"], "pred", "target").select("learner", "n", F.round("rho", 4).alias("rho"))


@query("ml05", "SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 'test' WHEN c_custkey % 10 = 1 THEN 'dev' ELSE 'train' END AS split FROM customer WHERE c_custkey % 10 <> 0 OR c_custkey % 20 = 0")
def ml05(spark: SparkSession, d: str) -> DataFrame:
    """Training, development and locked test ids."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").where((k % 10 != 0) | (k % 20 == 0)).select(k.alias("id"), F.when(k % 10 == 0, "test").when(k % 10 == 1, "dev").otherwise("train").alias("split"))


@query("ml06")
def ml06(spark: SparkSession, d: str) -> DataFrame:
    """Model card: size, target range and reference predictions' quartiles."""
    p = people(spark, d)
    m = R.fit(p, "id", FEATURES, "target", 1.0)
    if m is None:
        return spark.createDataFrame([], "n bigint, q1 double, q2 double, q3 double")
    x = p.where("target IS NOT NULL").select(m.predict().alias("pred"))
    return x.agg(F.count("*").alias("n"), *[F.round(F.expr(f"percentile(pred, {q})"), 6).alias(f"q{i}") for i, q in enumerate((0.25, 0.5, 0.75), 1)])


@query("ml07")
def ml07(spark: SparkSession, d: str) -> DataFrame:
    """Scores of rows, refused where a feature is missing."""
    p = people(spark, d).withColumn("min_price", F.when(F.col("id") % 7 != 0, F.col("min_price")))
    m = R.fit(p, "id", FEATURES, "target", 1.0)
    return p.select("id", (F.round(m.predict(True), 6) if m else F.lit(None).cast("double")).alias("score"))


@query("ml08")
def ml08(spark: SparkSession, d: str) -> DataFrame:
    """Part models and their weights: the cross-validated correlation, not under zero."""
    p, parts = people(spark, d), {"price": ["mean_price", "max_price", "min_price"], "count": ["n_orders"]}
    rows = [S.spearman(R.out_of_fold(p, "id", f, "target").withColumn("part", F.lit(n)), ["part"], "pred", "y") for n, f in parts.items()]
    return reduce(DataFrame.unionByName, rows).select("part", "n", F.round(F.greatest(F.coalesce("rho", F.lit(0.0)), F.lit(0.0)), 6).alias("weight"))


@query("ml09")
def ml09(spark: SparkSession, d: str) -> DataFrame:
    """Transfer: fitted on customers, scored on suppliers by their part prices."""
    p = people(spark, d)
    m = R.fit(p, "id", ["mean_price", "n_orders"], "target", 1.0)
    l = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.avg("l_extendedprice").alias("mean_price"), F.count("*").cast("double").alias("n_orders"))  # noqa: E741
    s = table(spark, d, "supplier").join(l, "s_suppkey").withColumn("all", F.lit("supplier"))
    s = s.withColumn("pred", m.predict() if m else F.lit(None).cast("double"))
    return S.spearman(s, ["all"], "pred", "s_acctbal").select("all", "n", F.round("rho", 6).alias("rho"))


@query("ml10")
def ml10(spark: SparkSession, d: str) -> DataFrame:
    """Learning curve: five draws each of 25 to 300 rows and the whole pool, evaluated on a held-out part."""
    p = cut(people(spark, d).where("target IS NOT NULL"))
    pool, test, out = p.where("id % 5 <> 0"), p.where("id % 5 = 0"), []
    size = pool.count()
    for n, r in [(n, r) for n in (25, 50, 100, 200, 300) if n < size for r in range(5)] + [(size, 0)]:
        m = R.fit(pool.orderBy(draw(r, F.col("id")), "id").limit(n) if n < size else pool, "id", FEATURES, "target", 1.0)
        if m:
            out.append(test.select(F.lit(n).alias("n_train"), F.lit(r).alias("repeat"), m.predict().alias("pred"), "target"))
    if not out:
        return spark.createDataFrame([], "n_train int, repeat int, n bigint, rho double")
    return S.spearman(reduce(DataFrame.unionByName, out), ["n_train", "repeat"], "pred", "target").select("n_train", "repeat", "n", F.round("rho", 6).alias("rho"))


@query("ml11")
def ml11(spark: SparkSession, d: str) -> DataFrame:
    """Named contrasts of two models' out-of-fold predictions."""
    p = people(spark, d)
    preds = {n: R.out_of_fold(p, "id", f, "target").select("id", "y", F.col("pred").alias(n)) for n, f in {"price": ["mean_price", "max_price"], "count": ["n_orders"]}.items()}
    j = preds["price"].join(preds["count"].drop("y"), "id").withColumn("contrast", F.lit("price - count"))
    for c in ("price", "count", "y"):
        j = S.group_ranks(j, ["contrast"], c, f"r_{c}")
    return j.groupBy("contrast").agg(F.count("*").alias("n"), F.round(F.corr("r_price", "r_y") - F.corr("r_count", "r_y"), 6).alias("delta"))


@query("ml12", "SELECT c_mktsegment, count(*) AS n, count(DISTINCT o_custkey) AS people FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 10 <> 0 GROUP BY 1")
def ml12(spark: SparkSession, d: str) -> DataFrame:
    """The training pool: features joined with labels, locked ids left out."""
    c = table(spark, d, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, d, "orders").join(c, "o_custkey").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("people"))
