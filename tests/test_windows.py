"""Two-second windows of recordings of any length, against brute force."""

import random
from collections import defaultdict

from gleanstone.plans import registry


def events():
    """Rows of a short clip and of one that runs far beyond ten minutes, in whole quarters of a second."""
    rng = random.Random(4)
    rows = [(i, "long" if i % 4 else "short", "gaze", rng.choice(["eye_contact", "Looking Away", "no_face"]), a := rng.randint(0, 16000 if i % 4 else 800) / 4, a + rng.choice([0.25, 1.0, 3.5, 40.0])) for i in range(300)]
    return [*rows, rows[1], (900, "long", "gaze", None, 10.0, 4100.25), (901, "short", "gaze", "no_face", 5.0, 5.0), (902, "short", "gaze", "no_face", 5.0, None)]


def folder(spark, tmp_path):
    spark.createDataFrame(events(), "event_id bigint, key string, type string, event string, start double, end double").write.parquet(f"{tmp_path}/gaze_events.parquet")
    return str(tmp_path)


def test_the_state_of_every_window(spark, tmp_path):
    share = defaultdict(lambda: defaultdict(float))
    for _, key, _, event, a, b in {r[0]: r for r in events() if r[3] and r[5]}.values():
        for w in range(0, 4200, 2):
            if (o := min(b, w + 2) - max(a, w)) > 0:
                share[key, float(w)][event.lower().replace(" ", "_")] += o
    want = {(*k, e := max(s, key=lambda x: (s[x], x)), s[e]) for k, s in share.items()}
    got = {(r["key"], r["start"], r["event"], r["sec"]) for r in registry.QUERIES["jn20"](spark, folder(spark, tmp_path)).collect()}
    assert got == want and max(w for _, w, _, _ in got) > 3000


def test_windows_reach_to_the_end_of_the_clip(spark, tmp_path):
    want = set()
    for key in ("long", "short"):
        end = max(r[5] for r in events() if r[1] == key and r[5] is not None)
        want |= {(key, float(w), min(w + 2.0, end)) for w in range(0, 4200, 2) if min(w + 2.0, end) - w >= 0.5}
    got = [(r["key"], r["start"], r["end"]) for r in registry.QUERIES["win17"](spark, folder(spark, tmp_path)).collect()]
    assert len(got) == len(want) and set(got) == want and max(w for _, w, _ in got) > 3000
