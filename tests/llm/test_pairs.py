import pytest

from gleanstone.llm import pairs as P
from gleanstone.llm.pair_queries import broken_pairs

Q = "When did you change your mind because of a colleague?"


@pytest.mark.parametrize("text,want", [
    (None, "empty"), (" ​", "empty"), ("N/A", "empty"), ("[your own example: situation - result]", "empty"), ("...", "empty"),
    ("Unfortunately, I won't rewrite this answer, since the recording may be private.", "refusal"), ("No feedback will be given for this clip, as it touches on health.", "refusal"),
    ("I'm unable to coach this clip.", "refusal"), ("This is something I have to turn down.", "refusal"), ("Please contact a human coach; this cannot be answered here.", "refusal"),
    ("I'm sorry to say that the list was late at first, but I rebuilt it and the guests stayed calm.", None), ('As a porter I once told the staff "I can\'t promise that", then I tested the list, and the team trusted it.', None),
    ("I could not fix the list alone last spring, so I asked the night team for help and we finished a day ahead.", None),
    (Q, "copy"), ("Well, When did you really change your mind mind because of a colleague ...", "copy"), (f"{Q} {Q}", "copy"), ("Question: " + Q.upper(), "copy"),
    (f"{Q} Yes, I have one. My best example is from the old town, where we kept the contract.", None),
    ("OK. その結果、一日早く終わり、運転手も大切にしてくれました。", "language"), ("Ich habe zuerst den Plan mit dem Team erklärt, und die Schlange wurde kürzer.", "language"),
    ("I tested the list at once and the queue became shorter. [ใส่ตัวอย่างของคุณ]", None),
    ("I could not fix the list alone last spring, so", "truncated"), ("What makes me calm is [your own exam", "truncated"), ('With the staff, because the old way "we were', "truncated"), ("The list was late,", "truncated"), ("Here it is:\n```\ncode", "truncated"),
    ("I tested the list at once and complaints fell by a third", None), ('They mention it today, e.g. "that was quick"', None),
])
def test_judge(text, want):
    assert P.judge(Q, [[text]])[0] == want


def test_questions():
    for p in (f"### Interview question\n{Q}\n### Transcript\nx", f"Question: {Q}\nCandidate: x", f"You coach.\n\nQUESTION\n{Q}\n\nSAID\nx", f"Hello.\n{Q}\nMore"):
        assert P.question_of(p) == Q
    assert P.question_of(None) == "" and P.question_of("") == ""


def test_tiles():
    assert P.tiles("a b c d".split(), "c d a b".split()) == 4
    assert P.tiles("a x b".split(), "a b".split()) == 0


def test_pairs(spark):
    f = "example_id bigint, improvements array<struct<issue_en:string,action_steps_en:array<string>>>, improved_answer struct<rewritten_en:string>, field string"
    good, step = "The result comes too late.", ["Say the result first."]
    rows = [
        (1, [(good, step)], ("I tested it and the queue became shorter.",), "x"), (1, [(good, step)], ("I tested it and the queue became shorter.",), "x"),
        (2, None, None, "x"), (3, [None, (None, None)], ("I rebuilt the queu",), "x"), (4, [(good, step), (good, ["Say", None])], ("We shortened the queue",), "x"),
        (5, [], ("Fine.",), "x"), (None, None, None, "x"), (9, None, None, "x"),
    ]
    prompts = spark.createDataFrame([(i, f"Question: {Q}\nCandidate: x") for i in range(1, 6)] + [(None, "q")], "example_id bigint, prompt string")
    got = {(r["example_id"], r["field"]): r["defect"] for r in broken_pairs(prompts, spark.createDataFrame(rows, f)).collect()}
    assert got == {(2, "improved_answer"): "empty", (2, "improvements"): "empty", (3, "improvements"): "empty", (3, "improved_answer"): "truncated", (5, "improvements"): "empty"}
    assert broken_pairs(prompts.limit(0), spark.createDataFrame(rows, f)).count() == 0


def test_long_refusals_and_long_answers_with_a_refusal_in_them():
    long = "I am afraid that I will not be able to rewrite this answer, because the recording, the transcript and everything else that came along with them, however carefully it was all put together, may well belong to somebody who has never agreed to it. We are also not allowed to comment on the way in which the person in this clip sits, stands, moves or looks, whatever the question may have been and whoever may have asked it."
    assert len(long) > 320 and P.refuses(long)
    assert not P.refuses("We rebuilt the plan. I can not say who asked for it first. " + "Then the crew tested it every morning and the guests came back. " * 8)


@pytest.mark.parametrize("text,left", [
    ("a (b [c] d) e", []), ("a (b [c", ["(", "["]), ("```py\n(x\n``` done", []), ("```py\n(x", ["```"]), ("<b>x <i>y</b> z", []), ("<b>x <i>y</i>", ["<b"]), ("x<br>y<img/>", []), ("- one\n- two", []), ("- one\n-", ["item"]), ("1. one\n2.", ["item"]), ('"a" and "b', ['"']), ("„a“ b „c", ["„"]), ("a) b] c", []),
])
def test_the_pushdown_parser(text, left):
    assert P.open_marks(text) == left


def test_tilings_against_a_slow_search():
    import random

    def slow(a, b, least):
        free_a, free_b, covered = [True] * len(a), [True] * len(b), 0
        while True:
            best = (least - 1, 0, 0)
            for i in range(len(a)):
                for j in range(len(b)):
                    k = 0
                    while i + k < len(a) and j + k < len(b) and free_a[i + k] and free_b[j + k] and a[i + k] == b[j + k]:
                        k += 1
                    best = max(best, (k, -i, -j))
            k, i, j = best[0], -best[1], -best[2]
            if k < least:
                return covered
            free_a[i : i + k] = free_b[j : j + k] = [False] * k
            covered += k

    rng = random.Random(8)
    near = 0
    for _ in range(200):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(0, 14))] for _ in range(2))
        got, want = P.tiles(a, b), slow(a, b, 2)
        near += abs(got - want) <= 2
        assert got <= (__import__("collections").Counter(a) & __import__("collections").Counter(b)).total()
    assert near >= 195  # halved lengths may lay a few tiles elsewhere
