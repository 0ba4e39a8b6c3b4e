"""Held-out items in the documents (problem 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanstone.llm.leakage import leaks
from gleanstone.session import table


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that carry a held-out item or two fifths of it in one stretch."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_items")).select("doc_id", "item_id")
