"""Rating prompts hold the whole answer of every interview answer."""

from gleanstone.plans import registry


def test_rating_prompts_are_whole(spark, tmp_path):
    long = "word " * 1000 + "end"
    rows = [(1, long, "interview_answer"), (2, "a", "INTERVIEW_ANSWER"), (3, "b", " interview answer "), (4, "c", "Interview-Answer"), (5, "d", "diary"), (6, None, "interview_answer"), (7, "e", None)]
    spark.createDataFrame([(i, t, "en", s, "k") for i, t, s in rows], "doc_id bigint, text string, lang string, source string, key string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["prompt"] for r in registry.QUERIES["str30"](spark, str(tmp_path)).collect()}
    assert got == {i: "Rate the answer from 1 to 10.\n" + t for i, t in ((1, long), (2, "a"), (3, "b"), (4, "c"))}
