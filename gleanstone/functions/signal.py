"""Audio as numbers: frames' intensity, pitch by autocorrelation, silence."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanstone.sources.files import wav_seconds

PROSODY = T.StructType([T.StructField(n, T.DoubleType()) for n in ("pitch_mean_hz", "pitch_std_hz", "intensity_mean_db", "silence_ratio")])


def measure(x: np.ndarray, rate: int, frame: float = 0.04) -> tuple[float | None, float | None, float | None, float]:
    """Mean and deviation of the voiced pitch, mean intensity of frames over 0 dB, share of silent frames.

    A frame is silent under max(50, mean - 15) dB and voiced where its autocorrelation between 75
    and 500 Hz reaches half its power. A signal without sound is all silence.
    """
    n = max(1, int(rate * frame))
    frames = x[: len(x) // n * n].reshape(-1, n) if len(x) >= n else np.zeros((0, n))
    power = (frames**2).mean(1) if len(frames) else np.zeros(0)
    db = 10 * np.log10(np.maximum(power, 1e-20) / 4e-10)
    loud = db[db > 0]
    if not len(loud):
        return None, None, None, 1.0
    quiet = db < max(50.0, loud.mean() - 15)
    pitches = []
    for f in frames[~quiet]:
        c = np.correlate(f - f.mean(), f - f.mean(), "full")[n - 1 :]
        lo, hi = int(rate / 500), min(int(rate / 75), n - 1)
        k = lo + int(np.argmax(c[lo:hi])) if hi > lo else 0
        if k and c[k] > 0.5 * c[0]:
            pitches.append(rate / k)
    return (float(np.mean(pitches)) if pitches else None, float(np.std(pitches)) if pitches else None, float(loud.mean()), float(quiet.mean()))


@F.pandas_udf(PROSODY)
def prosody(samples: pd.Series, rate: pd.Series) -> pd.DataFrame:
    """``measure`` of arrays of samples; null signals give nulls."""
    got = [measure(np.asarray(s, float), int(r)) if s is not None else (None,) * 4 for s, r in zip(samples, rate)]
    return pd.DataFrame(got, columns=[f.name for f in PROSODY.fields], dtype="float64")


@F.pandas_udf(T.DoubleType())
def wav_length(content: pd.Series) -> pd.Series:
    """Seconds of PCM files by their header."""
    return content.map(wav_seconds).astype("float64")
