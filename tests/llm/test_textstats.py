import random

import numpy as np
import pytest

from gleanstone.llm import textstats as T

PROSE = "When I worked at the harbour office, I walked through the training plan together with the night team. It took until 10 p.m. on Friday, and in the end the audit went smoothly. "


def kind(t):
    return T.describe([t])["kind"][0]


@pytest.mark.parametrize("text,want", [
    (PROSE * 3, "prose"), ("\n".join(PROSE[i : i + 60] for i in range(0, len(PROSE), 60)), "prose"), ("interviewer " + PROSE.lower().replace(".", "").replace(",", "") * 3, "prose"),
    (PROSE * 2 + "\n\n- careful\n- steady\n- calm\n\n" + PROSE * 2, "prose"), ("Interviewer: What did you learn?\nCandidate: " + PROSE * 2, "prose"),
    ("ผมเริ่มจากการวางแผนรายการสินค้าครับ หลังจากนั้นผมทดสอบระบบจองห้องทุกวันครับ " * 3, "prose"), ("最初に地下の記録を確認しました。次は上司と先に話すことです！" * 3, "prose"),
    ("- careful\n- the stock list on the second floor\n- calm\n- Practise pausing for 12 seconds before each take.\n", "list"), ("To prepare:\n1) posture\n2. the evening school\n3) pausing\n4. tone of voice", "list"),
    ("calm\nthe stock list\nposture\na bicycle shop on the hill\npausing", "list"), ("calm · the stock list · posture · a bicycle shop · pausing · direct", "list"), ("ร้านของเล่น, ท่าเรือ, พนักงานต้อนรับ, ร้านขนมปัง, ห้องสมุด, โรงแรม", "list"),
    ("| name | band |\n|---|---|\n| head | 1.5 |\n| face | 2.5 |", "table"), ("type\tstart\tend\nhand\t1.48\t3.02\nface\t4.10\t5.33", "table"), ('{"type": "hand", "start": 2.14}\n{"type": "gaze", "start": 4.84}', "table"),
    ("vis.gaze_0 = 2.07\nrule.face_1 = 5.26\npr.pitch_2 = 8.05", "table"), ("E1 face smiling 2.04-4.00s share 0.52\nE2 gaze no_face 4.25-6.04s share 0.04", "table"), ("Dr. Ponsei      5    3    4    96.0\nMr. Tindrake    2    3    3    25.8", "table"),
    ("urodgu bvhuiycb ioxd gutgvipqq jxyzpl doslpxrhhwhk lusvzk abyyyh ylnt zmtgbaogrdvcd xahjrpshzgr rvuwcgjxybsiz qxhehm", "junk"), ("... ... ... ... ... ...", "junk"), ("-~=?^:_&#=*@$,|$$,#<;^~?@^!}{#[@", "junk"),
    ("00000000: e7 7e 3b 5e e0 63 fe c5\n00000010: 8f 6a 80 0c 68 35 d8 ce", "junk"), ('<li class="nav" id=x4></li><td class="c" id=x8></td><div id=x2></div>', "junk"), ("H�l�o t�e�e, t��s i� b�o��n te�t", "junk"),
])
def test_kinds(text, want):
    assert kind(text) == want


def test_languages_have_their_own_profiles():
    """Prose of each language is near it; Thai with its characters shaken isn't."""
    for text in T.PROSE.values():
        got = T.describe([text * 3])
        assert got["letter_divergence"][0] < 0.1 and got["word_divergence"][0] < 0.1 and got["kind"][0] == "prose"
    shaken = list(T.PROSE["th"] * 3)
    random.Random(3).shuffle(shaken)
    got = T.describe(["".join(shaken)])
    assert got["letter_divergence"][0] > T.describe([T.PROSE["th"] * 3])["letter_divergence"][0] and got["kind"][0] == "junk"


def test_many_texts_are_counted_as_one_by_one():
    texts = [t for _, t in T.samples()]
    whole = T.describe(texts)
    for i in range(0, len(texts), 7):
        assert whole.iloc[i].tolist() == T.describe([texts[i]]).iloc[0].tolist()


def test_divergence():
    p, q = np.array([0.5, 0.5, 0.0]), np.array([0.0, 0.5, 0.5])
    assert T.divergence(p, p) == pytest.approx(0) and T.divergence(p, q) == pytest.approx(0.5) and T.divergence(np.array([1.0, 0]), np.array([0, 1.0])) == pytest.approx(1)


def test_table(spark):
    rng = random.Random(1)
    rows = [(1, PROSE), (2, None), (3, "  \n "), (4, "x" * 300_000), (5, PROSE * 2000), (5, PROSE * 2000), (6, "".join(chr(rng.choice([9, 10, 32, *range(33, 0x2FF), 0xFFFD, 0x1F642])) for _ in range(500))), (None, "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS kind", "2 AS n_words")
    got = T.quality(df).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 4, 5, 5, 6]
    one = next(r for r in got if r["doc_id"] == 1)
    assert one["n_words"] == 33 and one["n_lines"] == 1 and one["n_chars"] == len(PROSE) and one["stopped_lines"] == 1.0 and one["common_words"] > 0.4
    assert T.quality(df.limit(0)).count() == 0
