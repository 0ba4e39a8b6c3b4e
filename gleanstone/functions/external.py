"""External models behind one interface, with deterministic stand-ins that need no model files."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Model(Protocol):
    def __call__(self, texts: list[str | None]) -> list:
        """One result for each text."""


_loaded: dict[str, Model] = {}


def apply_model(df: DataFrame, load: Callable[[], Model], column: str, result: str, kind: str, batch: int = 16) -> DataFrame:
    """``df`` with ``result``: the model's answer to ``column``, in batches, the model loaded once in each worker."""
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), f"`{result}` {kind}"])
    name = f"{load.__module__}.{load.__qualname__}"

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _loaded.get(name) or _loaded.setdefault(name, load())
        for pdf in frames:
            texts = pdf[column].tolist()
            got = [y for a in range(0, len(texts), batch) for y in model(texts[a : a + batch])]
            yield pdf.assign(**{result: pd.Series(got, index=pdf.index, dtype=object)})

    return df.mapInPandas(scan, schema)


def hashed_encoder(size: int = 16) -> Model:
    """Stand-in sentence encoder: signed word hashes, scaled to unit length."""

    def encode(texts: list[str | None]) -> list:
        out = []
        for t in texts:
            v = np.zeros(size)
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                v[h % size] += 1 if h >> 16 & 1 else -1
            out.append((v / (np.linalg.norm(v) + 1e-9)).tolist())
        return out

    return encode


def length_rater() -> Model:
    """Stand-in rater: 1 to 10 by the number of words, as schema-constrained JSON."""
    return lambda texts: [json.dumps({"rating": min(10, 1 + len((t or "").split()) // 40), "reason": "length"}) for t in texts]


def first_sentence() -> Model:
    """Stand-in writer: gives back a text's first sentence."""
    return lambda texts: [(t or "").split(". ")[0] or None for t in texts]


def with_tries(call: Callable[[str], str], check: Callable[[str], bool], tries: int = 3, wait: Callable[[int], None] = lambda n: None) -> Callable[[str], str | None]:
    """A call repeated until its answer passes the check, with a wait that grows between the tries; None if none does."""

    def run(x: str) -> str | None:
        for n in range(tries):
            try:
                y = call(x)
                if check(y):
                    return y
            except Exception:  # noqa: BLE001  a failing service is tried again
                pass
            wait(2**n)
        return None

    return run


def write_check_revise(df: DataFrame, write: Callable[[DataFrame], DataFrame], failed: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """Draft all rows, write the failed ones once more, and drop what fails again: two passes, no loop over rows."""
    draft = write(df)
    bad = failed(draft).select(key).distinct()
    again = write(df.join(bad, key, "left_semi"))
    still = failed(again).select(key).distinct()
    return draft.join(bad, key, "left_anti").unionByName(again.join(still, key, "left_anti"))


def sampled_frames(df: DataFrame, n_frames: str, fps: str, target: float) -> DataFrame:
    """Rows for the frames kept of each video: every max(1, round(fps / target))-th one, from 0."""
    step = F.greatest(F.lit(1), F.round(F.col(fps) / target).cast("int"))
    return df.where(F.col(n_frames) > 0).withColumn("frame", F.explode(F.sequence(F.lit(0), F.col(n_frames).cast("int") - 1, step)))
