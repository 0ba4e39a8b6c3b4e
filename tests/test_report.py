"""The checker's report on planted feedback: every code once, and points without problems."""

from gleanstone.plans import report as R

LOG = [
    ("c", "E1", "event", "gaze", "looking_away", 10.0, 14.0, "gaze looking_away", None), ("c", "E2", "event", "face", "smiling", 20.0, 25.0, "face smiling", None),
    ("c", "T1", "transcript", "transcript", None, 0.0, 8.0, "I asked the team what they needed for 3 weeks.", None), ("c", "P1", "pause", "pause", None, 8.0, 10.0, "pause", None),
    ("c", "S1", "summary", "gaze", None, None, None, None, {"eye_contact": 0.24, "looking_away": 0.76}), ("c", "S2", "summary", "face", None, None, None, None, {"smiling": 0.25, "neutral": 0.75}),
]
POINTS = [  # section, dimension, ids, text, steps, status, problems
    ("improvements", "eye_contact", ["E1"], "You looked away at 12s.", None, "ok", ""),
    ("improvements", "eye_contact", None, "Look here.", None, "failed", "no_ids"),
    ("improvements", "eye_contact", ["E1", "E77"], "Your gaze left.", None, "failed", "unknown_id"),
    ("improvements", "eye_contact", ["VIDEO"], "Words for the video alone.", None, "failed", "no_video"),
    ("improvements", "eye_contact", ["E2"], "A remark.", None, "failed", "wrong_source"),
    ("improvements", "facial_expression", ["E2", "VIDEO"], "You smiled at 26s.", None, "ok+video", ""),
    ("improvements", "facial_expression", ["E2"], "A broad grin was seen on your face (26.1 seconds).", None, "failed", "time_mismatch"),
    ("improvements", "eye_contact", ["E1"], "You kept eye contact between 11 and 13 seconds.", None, "failed", "contradicted"),
    ("improvements", "answer_quality", ["T1"], "There were several fillers in it.", None, "failed", "filler"),
    ("improvements", "answer_quality", ["T1"], "You said \"nobody was there today\" too early.", None, "failed", "quote"),
    ("improvements", "answer_quality", ["T1"], "You said \"what they needed for\" in a clear way.", None, "ok", ""),
    ("strengths", "eye_contact", ["S1"], "Steady eye contact.", None, "failed", "share"),
    ("strengths", "facial_expression", ["S2"], "Warm smiles throughout.", None, "ok", ""),
    ("strengths", "eye_contact", ["E1", "S1", "S2", "T1", "P1"], "Nothing to add.", None, "failed", "too_many_ids"),
    ("strengths", "eye_contact", ["S1"], "See E1, S1 and T1.", None, "failed", "ids_in_text"),
    ("strengths", "eye_contact", ["E1"], "x" * 321, None, "failed", "too_long"),
    ("strengths", "eye_contact", ["E1"], "x" * 320, None, "ok", ""),
    ("improvements", "eye_contact", ["E1"], "You looked away at 12 s.", ["Keep your head up at 99s."], "failed", "duplicate time_mismatch"),
    ("improvements", "eye_contact", ["S1"], "Fine words only.", ["Hold steady eye contact."], "ok", ""),
]
SCHEMA = """feedback_id bigint, key string, overall_summary_en string, strengths array<struct<dimension:string,text_en:string,text_th:string,evidence_ids:array<string>>>,
improvements array<struct<dimension:string,issue_en:string,issue_th:string,evidence_ids:array<string>,action_steps_en:array<string>,action_steps_th:array<string>>>, improved_answer struct<rewritten_en:string,rewritten_th:string>, kind string"""


def frames(spark):
    log = spark.createDataFrame(LOG, "key string, id string, kind string, type string, value string, start double, end double, text string, share map<string,double>")
    s = [(p[1], p[3], None, p[2]) for p in POINTS if p[0] == "strengths"]
    i = [(p[1], p[3], None, p[2], p[4], None) for p in POINTS if p[0] == "improvements"]
    rows = [
        (1, "c", "You looked away at 12s. You smiled at 12s.", s, i, ("It took 3 weeks [add 5 names] and 40 days.", None), "x"), (1, "c", "You looked away at 12s. You smiled at 12s.", s, i, ("It took 3 weeks [add 5 names] and 40 days.", None), "x"),
        (2, "c", "Too many ums in it.", None, [None, (None, None, None, None, None, None)], ("It took 3 weeks.", None), "x"), (3, None, None, [], [], None, "x"), (4, "unknown", None, [("eye_contact", "Fine.", None, ["E1"])], None, None, "x"),
    ]
    return spark.createDataFrame(rows, SCHEMA), log


def test_every_code(spark):
    feedback, log = frames(spark)
    got = {(r["feedback_id"], r["section"], r["n"]): (r["status"], r["problems"]) for r in R.report(feedback, log).collect()}
    want, n = {}, {"strengths": 0, "improvements": 0}
    for section, _, _, _, _, status, problems in POINTS:
        want[1, section, n[section]] = (status, problems)
        n[section] += 1
    want |= {(1, "summary", 0): ("failed", "time_mismatch"), (1, "answer", 0): ("failed", "invented_number"), (2, "summary", 0): ("failed", "filler"), (2, "improvements", 1): ("failed", "no_ids"), (4, "strengths", 0): ("failed", "unknown_id")}
    assert got == want
    assert R.report(feedback.limit(0), log).count() == 0 and R.report(feedback, log.limit(0)).where("status <> 'failed'").count() == 0


def test_the_video_may_be_allowed(spark):
    feedback, log = frames(spark)
    got = R.report(feedback, log, allow_video=True).where("feedback_id = 1 AND section = 'improvements' AND n = 3").first()
    assert (got["status"], got["problems"]) == ("video_only", "")
