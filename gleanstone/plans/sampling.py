"""Queries of sampling: stratified, nested and hash-based."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanstone.functions.draws import draw, draw_sql
from gleanstone.operators.ranking import quantile_bins
from gleanstone.plans.base import query
from gleanstone.plans.joins import CLAIMS, claims
from gleanstone.session import table

STRATA = "s AS (SELECT c_custkey, CAST(greatest(ceil((r - 1) * 5 / (n - 1)) - 1, 0) AS INTEGER) AS stratum FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS r, count(*) OVER () AS n FROM customer))"


@query("smp01", f"WITH {STRATA} SELECT c_custkey, stratum FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY {draw_sql('42 + stratum', 'c_custkey')}, c_custkey) AS n FROM s) WHERE n <= 20 + CASE WHEN stratum < 3 THEN 1 ELSE 0 END")
def smp01(spark: SparkSession, d: str) -> DataFrame:
    """A sample of 103 over five strata, the remainder from the first ones."""
    s = quantile_bins(table(spark, d, "customer"), ["c_acctbal", "c_custkey"], 5, "stratum")
    n = F.row_number().over(Window.partitionBy("stratum").orderBy(draw(42 + F.col("stratum"), F.col("c_custkey")), "c_custkey"))
    return s.withColumn("n", n).where("n <= 20 + CASE WHEN stratum < 3 THEN 1 ELSE 0 END").select("c_custkey", "stratum")


@query("smp02", f"WITH {CLAIMS} SELECT claim_id, approach FROM (SELECT *, row_number() OVER (PARTITION BY approach ORDER BY {draw_sql('7', 'claim_id')}, claim_id) AS n FROM c) WHERE n <= 15")
def smp02(spark: SparkSession, d: str) -> DataFrame:
    """At most fifteen rows of each group."""
    w = Window.partitionBy("approach").orderBy(draw(7, F.col("claim_id")), "claim_id")
    return claims(spark, d).withColumn("n", F.row_number().over(w)).where("n <= 15").select("claim_id", "approach")


@query("smp03", f"WITH o AS (SELECT o_custkey, arg_min(o_orderkey, ({draw_sql('1', 'o_orderkey')}, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1) SELECT o_custkey, o_orderkey FROM o ORDER BY {draw_sql('2', 'o_custkey')}, o_custkey LIMIT 100")
def smp03(spark: SparkSession, d: str) -> DataFrame:
    """One clip of each participant, then a hundred participants."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct(draw(1, F.col("o_orderkey")), "o_orderkey")).alias("o_orderkey"))
    return o.orderBy(draw(2, F.col("o_custkey")), "o_custkey").limit(100)


@query("smp04", f"WITH p AS (SELECT o_custkey, o_orderkey, o_orderkey % 10 = 0 AS chosen FROM orders) SELECT o_custkey, arg_min(o_orderkey, (NOT chosen, {draw_sql('3', 'o_orderkey')}, o_orderkey)) AS o_orderkey FROM p GROUP BY 1")
def smp04(spark: SparkSession, d: str) -> DataFrame:
    """The clip already chosen if there is one, else a random one."""
    p = table(spark, d, "orders").withColumn("rest", F.col("o_orderkey") % 10 != 0)
    return p.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("rest", draw(3, F.col("o_orderkey")), "o_orderkey")).alias("o_orderkey"))


@query("smp05", f"WITH s AS (SELECT p_partkey, {draw_sql('5', 'p_partkey')} AS h FROM part ORDER BY h, p_partkey LIMIT 60) SELECT p_partkey, row_number() OVER (ORDER BY h, p_partkey) <= 20 AS overlap FROM s")
def smp05(spark: SparkSession, d: str) -> DataFrame:
    """Sixty shuffled rows, the first twenty of them for both raters."""
    h = draw(5, F.col("p_partkey"))
    s = table(spark, d, "part").select("p_partkey", h.alias("h")).orderBy("h", "p_partkey").limit(60)
    return s.withColumn("overlap", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("h", "p_partkey")) <= 20).select("p_partkey", "overlap")


@query("smp06", f"WITH g AS (SELECT n, r FROM (SELECT unnest([25, 50, 100]) AS n), (SELECT unnest([0, 1]) AS r)), x AS (SELECT n, r, c_custkey, row_number() OVER (PARTITION BY n, r ORDER BY {draw_sql('r', 'c_custkey')}, c_custkey) AS k FROM customer, g) SELECT n, r, c_custkey FROM x WHERE k <= n")
def smp06(spark: SparkSession, d: str) -> DataFrame:
    """Learning-curve subsamples: three sizes, two repeats; each repeat is one shuffle that all sizes share."""
    from functools import reduce

    c = table(spark, d, "customer").select("c_custkey")
    parts = [c.orderBy(draw(r, F.col("c_custkey")), "c_custkey").limit(n).select(F.lit(n).alias("n"), F.lit(r).alias("r"), "c_custkey") for n in (25, 50, 100) for r in (0, 1)]
    return reduce(DataFrame.unionByName, parts)


@query("smp07", "SELECT example_id, CASE WHEN CAST('0x' || substr(md5(id), 1, 8) AS BIGINT) % 10 = 0 THEN 'val' ELSE 'train' END AS split FROM (SELECT DISTINCT ON (example_id) * FROM sft_train) WHERE id IS NOT NULL")
def smp07(spark: SparkSession, d: str) -> DataFrame:
    """Split by a hash of the id."""
    h = F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("bigint") % 10
    return table(spark, d, "sft_train").dropDuplicates(["example_id"]).where("id IS NOT NULL").select("example_id", F.when(h == 0, "val").otherwise("train").alias("split"))


@query("smp08")
def smp08(spark: SparkSession, d: str) -> DataFrame:
    """Synthetic alternating-state clips for the keys of the transcripts, seeded by key."""
    from gleanstone.sources.synthetic import synthetic_states

    return synthetic_states(table(spark, d, "transcript").where("key IS NOT NULL").select("key").distinct())
