"""Mixing sources to target shares of tokens by Sainte-Lague apportionment of equal blocks."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanstone.functions.text import code_form
from gleanstone.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern by which the vocabulary's text is split before its bytes are merged.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_TOKENS = 512
SHARD_TOKENS = 2_000_000
_encoders: dict[str, object] = {}


def encoder(path: str):
    """The public tokenizer at ``path`` (ranks file), read once in each worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """doc_id, source (clean spelling), tokens of the whole text; null texts have 0 tokens."""
    kind = dict(docs.dtypes)["doc_id"]

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer)
        for pdf in frames:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in pdf["text"]]})

    return docs.select("doc_id", code_form(F.col("source")).alias("source"), "text").mapInPandas(scan, f"doc_id {kind}, source string, tokens bigint")


def sainte_lague(weights: list[float], caps: list[int], seats: int) -> list[int]:
    """Seats by the highest quotients weight / (2 k + 1), none above its cap.

    Equal quotients go to the earlier entry; entries without weight get nothing; if all caps are
    reached, the rest of the seats stays empty.
    """
    w, cap = np.array(weights, float), np.array(caps, np.int64)
    cap = np.where(w > 0, cap, 0)
    seats = int(min(seats, cap.sum()))
    if seats <= 0:
        return [0] * len(weights)
    given = lambda d: np.minimum(cap, np.floor(w / d + 0.5).astype(np.int64))  # noqa: E731  quotients of at least 2 d
    low, high = 0.0, w.max() * 3
    for _ in range(200):  # the largest divisor that hands out too few seats is the starting point
        mid = (low + high) / 2
        if low == mid or mid == high:
            break
        low, high = (low, mid) if given(mid).sum() < seats else (mid, high)
    n = given(high * (1 + 1e-9))  # clear of rounding; equal quotients are left to the loop
    while n.sum() < seats:
        n[np.where(n < cap, w / (2 * n + 1), -1).argmax()] += 1
    while n.sum() > seats:
        last = np.where(n > 0, w / (2 * n - 1), np.inf)
        n[len(n) - 1 - last[::-1].argmin()] -= 1
    return n.tolist()


def mix(docs: DataFrame, targets: DataFrame, seed: int = 7, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """Draw documents so that each source has its target share of each mix's tokens.

    ``docs`` (doc_id, source, text), ``targets`` (mix_id, source, target_share, max_repeats,
    budget_share). Returns the selection (mix_id, doc_id, source, tokens, times) and the report
    (mix_id, source, target_share, max_repeats, available_tokens, drawn_tokens, actual_share,
    distinct_docs, most_repeats), one row for each target.

    Documents are spread over shards of about ``shard_tokens`` by a hash of their id. In a shard,
    each source's documents stand in seeded order and are cut into blocks of about
    ``block_tokens`` (a document belongs to the block in which it begins). The shard's part of the
    mix's budget is apportioned to its sources by the highest Sainte-Lague quotients; a source
    gets at most ``max_repeats`` times its blocks, what it can't give goes to the others. The
    quota then fills whole rounds of the source's blocks and a seeded stretch of one more.
    Shards are independent and bounded, however large a source is.

    Documents without text or tokens are never drawn, nor are those of a null source or one
    without target; a null or negative share counts as 0; repeated (mix_id, source) targets count
    once; of different budgets of a mix the largest counts; a source without documents is reported with 0. Empty tables give an empty result.
    """
    t = targets.select("mix_id", code_form(F.col("source")).alias("source"), F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(1)).alias("max_repeats"), F.coalesce("budget_share", F.lit(0.0)).alias("budget_share"))
    t = t.where("mix_id is not null and source is not null").dropDuplicates(["mix_id", "source"])
    tok = cut(count_tokens(docs, tokenizer).where("doc_id is not null"))
    total = tok.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_tokens))
    tok = tok.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(shards)))
    used = tok.where("tokens > 0 and source is not null")
    w = Window.partitionBy("shard", "source").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id")
    before = F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    group = F.sum("tokens").over(Window.partitionBy("shard", "source"))
    blocks = F.greatest(F.lit(1), F.round(F.col("group") / block_tokens)).cast("bigint")
    used = used.withColumn("before", before).withColumn("group", group).withColumn("blocks", blocks)
    used = used.withColumn("block", F.floor(F.col("before") * F.col("blocks") / F.col("group")).cast("bigint"))

    room = tok.groupBy("shard", "source").agg(F.sum("tokens").alias("tokens"))
    whole = room.groupBy("shard").agg(F.sum("tokens").alias("all"))
    room = room.where("tokens > 0 and source is not null").withColumn("blocks", F.greatest(F.lit(1), F.round(F.col("tokens") / block_tokens)).cast("bigint"))
    asked = room.join(t, "source").join(whole, "shard").groupBy("shard", "mix_id").agg(
        F.first("all").alias("all"), F.max("budget_share").alias("budget"), F.sort_array(F.collect_list(F.struct("source", "target_share", (F.col("blocks") * F.col("max_repeats")).alias("cap")))).alias("s"))

    def quotas(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                n = sainte_lague([s["target_share"] for s in r.s], [s["cap"] for s in r.s], round(r.budget * r.all / block_tokens))
                rows += [(r.shard, r.mix_id, s["source"], q) for s, q in zip(r.s, n) if q]
            yield pd.DataFrame(rows, columns=["shard", "mix_id", "source", "quota"])

    mixes = dict(t.dtypes)["mix_id"]
    quota = asked.mapInPandas(quotas, f"shard bigint, mix_id {mixes}, source string, quota bigint")
    turn = F.pmod(F.col("block") - F.pmod(F.xxhash64(F.lit(seed + 2), "mix_id", "shard", "source"), F.col("blocks")), F.col("blocks"))
    times = F.floor(F.col("quota") / F.col("blocks")) + (turn < F.pmod("quota", "blocks")).cast("bigint")
    drawn = used.join(quota, ["shard", "source"]).withColumn("times", times.cast("int")).where("times > 0")
    selection = drawn.select("mix_id", "doc_id", "source", "tokens", "times")
    sums = drawn.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("times")).alias("drawn_tokens"), F.count("*").alias("distinct_docs"), F.max("times").alias("most_repeats"))
    there = used.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    zero = F.lit(0).cast("bigint")
    report = t.join(there, "source", "left").join(sums, ["mix_id", "source"], "left").withColumn("drawn_tokens", F.coalesce("drawn_tokens", zero))
    mine = F.sum("drawn_tokens").over(Window.partitionBy("mix_id"))
    report = report.select(
        "mix_id", "source", "target_share", "max_repeats", F.coalesce("available_tokens", zero).alias("available_tokens"), "drawn_tokens", F.try_divide(F.col("drawn_tokens"), mine).alias("actual_share"),
        F.coalesce("distinct_docs", zero).alias("distinct_docs"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
    return selection, report
