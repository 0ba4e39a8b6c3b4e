"""Times, topics and states of written statements, by hand; verdicts of claims on planted rows."""

from pyspark.sql import functions as F

from gleanstone.functions import claims as C
from gleanstone.plans import registry

TIMES = {
    "You looked away at 12.4s.": [(12.4, 12.4)], "At around 12 seconds you smiled.": [(12, 12)], "Between 30 and 35 seconds you paused.": [(30, 35)], "From 35s to 30s it was still.": [(30, 35)], "From 5 - 9 sec.": [(5, 9)],
    "It dips (12.4s).": [(12.4, 12.4)], "It dips (at 7 s).": [(7, 7)], "It dips (3s-5.5s).": [(3, 5.5)], "It dips (3–5 secs).": [(3, 5)], "Near 3-5s you nod.": [(3, 5)], "By 40 seconds you rush.": [(40, 40)],
    "The 20-second mark.": [(20, 20)], "The 20 s mark.": [(20, 20)], "At 0:45 you smile.": [(45, 45)], "At 12:05 and 1:10.": [(725, 725), (70, 70)], "Starting at 8s.": [(8, 8)], "After the ~9 seconds.": [(9, 9)], "Before 3 s and until 9 s.": [(3, 3), (9, 9)],
    "60-90 seconds is ideal.": [], "Hold it for 3 seconds.": [], "A score of 12 at 3.": [], "At 1:75.": [], "At 1234 s.": [], "": [], None: [], "Between 2 and 3 points.": [], "At 5 secondary.": [],
}
TOPICS = [
    ("You broke eye contact at 12s.", 20, None, "gaze"), ("Your head went down, later the camera, at 12s.", 40, None, "gaze"), ("Your head went down at 3s, far from the camera.", 20, None, "head"), ("You touched your face at 3s.", 20, None, "hand"),
    ("You said \"we were late\" at 3s.", 20, "eye_contact", "quote"), ("You said \"um\" near the camera.", 9, None, "filler"), ("There was a long silence.", 0, None, "pause"), ("Something else.", 0, "hand_gesture", "hand"), ("Something else.", 0, "answer_quality", None), ("Gestures and smiles.", 0, None, "hand"),
]
STATES = [
    ("gaze", "You glanced aside.", "looking_away"), ("gaze", "Steady eye contact.", "eye_contact"), ("gaze", "Nothing.", ""), ("head", "Head down and up.", "turned_down"), ("head", "You turned left.", "turned_left"), ("head", "You nodded.", "turned_down turned_up turned_left turned_right"), ("head", "Centred.", "centered"),
    ("hand", "Hands out of the frame.", "hands_hidden"), ("hand", "You gestured.", "gesturing"), ("hand", "Hands at rest.", "hands_still"), ("face", "A warm smile.", "smiling"), ("face", "No smile.", "neutral"), ("face", "A stern face.", "neutral"), ("pause", "A pause.", ""), (None, "You smiled.", ""),
]


def test_times(spark):
    df = spark.createDataFrame(list(enumerate(TIMES)), "i int, s string").select("i", "s", C.claimed_times(F.col("s")).alias("t"))
    for r in df.collect():
        assert [(t["t0"], t["t1"]) for t in r["t"]] == TIMES[r["s"]], r["s"]
        assert [(t["t0"], t["t1"], t["pos"], t["text"]) for t in r["t"]] == C.find_times(r["s"])
        assert all(r["s"][t["pos"] :].startswith(t["text"]) for t in r["t"])


def test_topics_and_states(spark):
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(TOPICS)], "i int, s string, p int, d string, want string")
    assert [(r["s"], r["got"]) for r in df.orderBy("i").withColumn("got", C.topic_at(F.col("s"), F.col("p"), F.col("d"))).collect()] == [(x[0], x[3]) for x in TOPICS]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(STATES)], "i int, t string, s string, want string")
    assert [(r["s"], r["got"]) for r in df.orderBy("i").withColumn("got", F.array_join(C.expected_states(F.col("t"), F.col("s")), " ")).collect()] == [(x[1], x[2]) for x in STATES]


def test_verdicts(spark, tmp_path):
    e = [(1, "c", "gaze", 10.0, 12.0, "looking_away"), (2, "c", "word", 20.0, 20.3, "Um,"), (3, "c", "word", 30.0, 30.2, "We"), (4, "c", "word", 30.3, 30.5, "were"), (5, "c", "word", 32.0, 32.4, "late.")]
    spark.createDataFrame([(i, k, "x", t, a, b, b - a, v) for i, k, t, a, b, v in e], "evidence_id bigint, key string, category string, type string, start double, end double, duration double, value string").write.parquet(f"{tmp_path}/evidence.parquet")
    c = [
        (1, "gaze", "looking_away", None, 11.0, "supported"), (2, "gaze", "eye_contact", None, 11.0, "contradicted"), (3, "gaze", None, None, 15.0, "unsupported"), (4, "filler", None, None, 21.2, "supported"), (5, "filler", None, None, 25.0, "unsupported"),
        (6, "quote", None, "We were late", 33.0, "supported"), (7, "quote", None, "we were early and happy", 31.0, "unsupported"), (8, "quote", None, "...", 31.0, "unverifiable"), (9, "quote", None, None, 31.0, "unverifiable"), (10, None, None, None, 31.0, "unverifiable"), (11, "gaze", None, None, 62.0, "out_of_range"),
    ]
    spark.createDataFrame([(i, " C ", t, x, q, a, None, 60.0) for i, t, x, q, a, _ in c], "claim_id bigint, key string, topic string, expected string, quote string, t0 double, t1 double, clip_duration double").write.parquet(f"{tmp_path}/hallucination_claims.parquet")
    got = {r["claim_id"]: r["verdict"] for r in registry.QUERIES["ver02"](spark, str(tmp_path)).collect()}
    assert got == {x[0]: x[5] for x in c}
