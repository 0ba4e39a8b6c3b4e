"""State streams: run-length encoding with carried state, sessions, tumbling windows, resumable batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INTERVAL = "key string, state string, start double, end double"
STATE = "state string, start double, last double"


def stream_rle(frames: DataFrame) -> DataFrame:
    """Closed intervals of a stream (key STRING, t DOUBLE, state STRING), in time order of each key's rows.

    The open interval of each key is the stored state; it comes out when the next state begins.
    Rows of a batch are sorted in time; a row older than what is already closed is left out.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], store) -> Iterator[pd.DataFrame]:
        now = store.get if store.exists else None
        rows = pd.concat(list(frames)).sort_values("t")
        out = []
        for t, s in zip(rows["t"], rows["state"]):
            if now is None:
                now = (s, t, t)
            elif t >= now[2]:
                if s != now[0]:
                    out.append((key[0], now[0], now[1], t))
                    now = (s, t, t)
                else:
                    now = (s, now[1], t)
        if now is not None:
            store.update(now)
        yield pd.DataFrame(out, columns=["key", "state", "start", "end"])

    return frames.groupBy("key").applyInPandasWithState(step, INTERVAL, STATE, "append", GroupStateTimeout.NoTimeout)


def sessions(frames: DataFrame, gap: str, late: str) -> DataFrame:
    """Episodes of one key and state whose gaps stay within ``gap``; other states in between don't count."""
    return frames.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "key", "state").agg(F.count("*").alias("n")).select("key", "state", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def tumbling(frames: DataFrame, width: str, late: str) -> DataFrame:
    """Rows of each state in windows of ``width``."""
    return frames.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "key", "state").agg(F.count("*").alias("n")).select("key", "state", F.col("w.start").alias("start"), "n")


def run_once(df: DataFrame, place: str, mode: str = "append") -> str:
    """Process all that a stream has now into Parquet below ``place``; a later call goes on from there."""
    q = df.writeStream.format("parquet").option("checkpointLocation", f"{place}/checkpoint").option("path", f"{place}/out").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return f"{place}/out"
