"""Synthetic clips: alternating states with flickers, seeded by key."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def synthetic_states(keys: DataFrame, seconds: float = 60.0, good: float = 0.7, flicker: float = 0.1) -> DataFrame:
    """key, state, start, end: states that tile each clip's time, good ones taking about ``good`` of it.

    Lengths are exponential (3 s), a flicker of under 0.2 s follows a state with chance ``flicker``.
    The draws depend on the key alone, so rows come out alike in any partitioning. Null keys have
    no rows; repeated keys repeat their clip.
    """

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for key in pdf["key"].dropna():
                rng, t, state = np.random.default_rng(zlib.crc32(key.encode())), 0.0, "eye_contact"
                while t < seconds:
                    mean = 3.0 * (2 * good if state == "eye_contact" else 2 * (1 - good))
                    end = min(seconds, round(t + max(0.2, rng.exponential(mean)), 2))
                    rows.append((key, state, t, end))
                    t = end
                    if rng.random() < flicker and t + 0.2 < seconds:
                        end = round(t + rng.uniform(0.05, 0.19), 2)
                        rows.append((key, "low_lids", t, end))
                        t = end
                    state = "looking_away" if state == "eye_contact" else "eye_contact"
            yield pd.DataFrame(rows, columns=["key", "state", "start", "end"])

    return keys.select("key").mapInPandas(scan, "key string, state string, start double, end double")
