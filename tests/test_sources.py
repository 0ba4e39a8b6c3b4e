import json
import struct

import pytest

from gleanstone.functions import external as X
from gleanstone.functions.claims import find_times
from gleanstone.sources import files as S
from gleanstone.sources.synthetic import synthetic_states


def test_documents_even_corrupt_ones(spark, tmp_path):
    (tmp_path / "clip1_evidence.json").write_text(json.dumps({"key": "clip1", "total_events": 1, "evidence": [{"type": "gaze", "start": 1.0}]}))
    (tmp_path / "clip2_evidence.json").write_text("{broken")
    rows = {r["stem"]: r for r in S.json_documents(spark, str(tmp_path), S.EVIDENCE, "_evidence").collect()}
    assert rows["clip1"]["evidence"][0]["type"] == "gaze" and rows["clip2"]["evidence"] is None and rows["clip2"]["_corrupt"]


def test_sheets(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id,name\n1,x\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("id,name\n2,y\n", encoding="utf-8")
    got = S.splits(spark, {"train": f"{tmp_path}/a.csv", "val": f"{tmp_path}/b.csv"}, "id STRING, name STRING").collect()
    assert sorted((r["id"], r["name"], r["split"]) for r in got) == [("1", "x", "train"), ("2", "y", "val")]


def test_wav_header():
    data = b"RIFF" + struct.pack("<I", 36) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16) + b"data" + struct.pack("<I", 64000)
    assert S.wav_seconds(data) == 2.0 and S.wav_seconds(b"nothing") is None and S.wav_seconds(None) is None


def test_nothing_is_clobbered(spark, tmp_path):
    a = S.write_once(spark.range(3), f"{tmp_path}/x")
    b = S.write_once(spark.range(5), f"{tmp_path}/x")
    assert (spark.read.parquet(a).count(), spark.read.parquet(b).count()) == (3, 5)


def test_times():
    assert find_times("Between 30 and 35 seconds you looked away, at 0:45 you smiled (12.4s).") == [(30.0, 35.0, 0, "Between 30 and 35 seconds"), (45.0, 45.0, 46, "0:45"), (12.4, 12.4, 62, "(12.4s)")]
    assert find_times("60-90 seconds is ideal, hold it for 3 seconds") == [] and find_times(None) == []
    assert find_times("the 20-second mark")[0][:2] == (20.0, 20.0)


def test_tries():
    seen = []
    f = X.with_tries(lambda x: seen.append(x) or "bad" * len(seen), lambda y: len(y) > 5)
    assert f("q") == "badbad" and len(seen) == 2
    assert X.with_tries(lambda x: 1 / 0, bool)("q") is None


def test_synthetic_clips_tile_their_time(spark):
    rows = synthetic_states(spark.createDataFrame([("a",), ("b",), (None,)], "key string")).orderBy("key", "start").collect()
    for k in "ab":
        mine = [r for r in rows if r["key"] == k]
        assert mine[0]["start"] == 0 and mine[-1]["end"] == 60.0 and all(x["end"] == y["start"] for x, y in zip(mine, mine[1:]))


@pytest.mark.parametrize("fail", [0, 3])
def test_write_check_revise(spark, fail):
    df = spark.createDataFrame([(i, "x" * i) for i in range(6)], "id int, text string")
    out = X.write_check_revise(df, lambda d: d, lambda d: d.where(f"length(text) < {fail}"), "id")
    assert sorted(r["id"] for r in out.collect()) == list(range(fail, 6))
