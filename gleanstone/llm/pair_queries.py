"""Broken prompt and response pairs (problem 3)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanstone.llm.pairs import judge, question_of
from gleanstone.session import cut, table


def broken_pairs(prompts: DataFrame, feedback: DataFrame) -> DataFrame:
    """example_id, field, defect: each field of a pair that is unusable, and why.

    ``prompts`` (example_id, prompt), ``feedback`` (example_id, improvements, improved_answer);
    other columns are ignored. A pair is a prompt and the feedback with its example_id; null ids
    pair with nothing, repeated rows count once. Null structs, lists, items and texts say nothing.
    A field has the first of these defects that holds: empty, refusal, copy, language, truncated.

    Each pair is judged by itself in one scan behind the join. Where a text ends without a stop
    in an ordinary word, that word is looked up among the words of all texts of the
    feedback, last words without a stop left out: one that never occurs there is taken for a cut piece.
    """
    f = feedback.where("example_id is not null").dropDuplicates(["example_id"]).select(
        "example_id", F.col("improved_answer.rewritten_en").alias("answer"),
        F.transform("improvements", lambda x: F.concat(F.array(x["issue_en"]), F.coalesce(x["action_steps_en"], F.array().cast("array<string>")))).alias("items"))
    p = prompts.where("example_id is not null").dropDuplicates(["example_id"]).select("example_id", "prompt")

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                q = question_of(r.prompt)
                for field, items in (("improved_answer", [[r.answer]]), ("improvements", [list(x) for x in r.items if x is not None] if r.items is not None else [])):
                    defect, words = judge(q, items)
                    if defect or words:
                        rows.append((r.example_id, field, defect, words))
            yield pd.DataFrame(rows, columns=["example_id", "field", "defect", "words"])

    judged = cut(f.join(p, "example_id").mapInPandas(scan, "example_id bigint, field string, defect string, words array<string>"))
    open_ = judged.where("defect is null").select("example_id", "field", F.explode("words").alias("word"))
    texts = f.select(F.explode(F.concat(F.array("answer"), F.coalesce(F.flatten("items"), F.array().cast("array<string>")))).alias("t")).where("t is not null")
    whole = F.when(F.col("t").rlike(r"[.!?][\"'”»)\]]*\s*$"), F.col("t")).otherwise(F.regexp_replace("t", r"\s*\S+\s*$", ""))
    inside = F.split(F.lower(whole), r"[^\p{L}\p{M}\p{Nd}'’]+")
    known = texts.select(F.explode(F.array_distinct(inside)).alias("word")).join(open_.select("word").distinct(), "word", "left_semi").distinct()
    cut_off = open_.join(known, "word", "left_anti").select("example_id", "field", F.lit("truncated").alias("defect")).distinct()
    return judged.where("defect is not null").select("example_id", "field", "defect").unionByName(cut_off)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unusable answers and improvements with their kind of defect."""
    return broken_pairs(table(spark, sf_dir, "sft_train"), table(spark, sf_dir, "feedback"))


def p3_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many fields have each defect."""
    return p3_found(spark, sf_dir).groupBy("field", "defect").agg(F.count("*").alias("n"))
