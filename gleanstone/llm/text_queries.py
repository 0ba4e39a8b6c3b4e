"""Queries on texts: sentences (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanstone.llm.sentences import sentences
from gleanstone.session import table


def joined_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, text: each transcript's segment texts in order, trimmed, blank and null ones left out."""
    t = table(spark, sf_dir, "transcript").select("key", F.col("segments.text").alias("parts")).where("key is not null").dropDuplicates(["key"])
    blank = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
    clean = F.transform("parts", lambda x: F.regexp_replace(x, f"^{blank}|{blank}$", ""))
    return t.select("key", F.array_join(F.filter(clean, lambda x: x.isNotNull() & (x != "")), " ").alias("text"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of the sampled documents and of all transcripts."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "sentence_sample").select("doc_id").distinct(), "doc_id", "left_semi")
    d = d.select(F.lit("documents").alias("holder"), F.col("doc_id").cast("string").alias("holder_id"), "text")
    t = joined_transcripts(spark, sf_dir).select(F.lit("transcript").alias("holder"), F.col("key").alias("holder_id"), "text")
    return sentences(d.unionByName(t))
