"""Deterministic draws: the same row gets the same number in every engine and on every cluster."""

from __future__ import annotations

from functools import lru_cache
from math import sin

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(*parts: Column | str | int) -> Column:
    """A whole number below 2**31 from the MD5 of the parts joined by colons."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.concat_ws(":", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % (1 << 31)


def draw_sql(*parts: str) -> str:
    """The same number as a DuckDB expression of SQL parts."""
    text = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) % 2147483648)"


#: Messages of one MD5 pass over arrays: few enough for the cache, many enough for NumPy's calls.
LANES = 1 << 16
_SINES = [int(abs(sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_WORDS = [(i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_FULL = 0xFFFFFFFF


def _compress(state: list, words: list[tuple], size: int, steps: int) -> list:
    """MD5's steps over ``size`` messages at once: the state behind them, before it is added to the one in front.

    A word is a number and an array to add to it (or None); the state is numbers until the first array.
    """
    a, b, c, d = state
    f, t = np.empty(size, np.uint32), np.empty(size, np.uint32)
    if not isinstance(a, int):
        a, b, c, d = (x.copy() for x in state)
    for i in range(steps):
        number, array = words[_WORDS[i]]
        if isinstance(a, int):
            if array is None:
                mix = (b & c | ~b & d, d & b | ~d & c, b ^ c ^ d, c ^ (b | ~d & _FULL))[i // 16]
                x = (a + (mix & _FULL) + _SINES[i] + number) & _FULL
                a, b, c, d = d, (b + (x << _TURNS[i] | x >> 32 - _TURNS[i])) & _FULL, b, c
                continue
            a, b, c, d = (np.full(size, x, np.uint32) for x in (a, b, c, d))
        if i < 16:
            np.bitwise_xor(c, d, f)
            np.bitwise_and(f, b, f)
            np.bitwise_xor(f, d, f)
        elif i < 32:
            np.bitwise_xor(b, c, f)
            np.bitwise_and(f, d, f)
            np.bitwise_xor(f, c, f)
        elif i < 48:
            np.bitwise_xor(b, c, f)
            np.bitwise_xor(f, d, f)
        else:
            np.invert(d, f)
            np.bitwise_or(f, b, f)
            np.bitwise_xor(f, c, f)
        np.add(f, a, f)
        if array is not None:
            np.add(f, array, f)
        np.add(f, np.uint32((_SINES[i] + number) & _FULL), f)
        np.left_shift(f, np.uint32(_TURNS[i]), t)
        np.right_shift(f, np.uint32(32 - _TURNS[i]), f)
        np.bitwise_or(t, f, t)
        np.add(t, b, a)
        a, b, c, d = d, a, b, c
    return [a, b, c, d]


@lru_cache(maxsize=1)
def _tails(length: int, n: int) -> list[tuple[int, int, dict[int, np.ndarray]]]:
    """The numbers below ``n`` written behind ``length`` bytes, by their digits: first, end, words of the message."""
    out, low, digits = [], 0, 1
    while low < n:
        high = min(n, 10**digits)
        rest, words = np.arange(low, high, dtype=np.uint32), {}
        for at in range(length + digits - 1, length - 1, -1):
            rest, digit = rest // np.uint32(10), rest % np.uint32(10)
            words[at // 4] = words.get(at // 4, np.uint32(0)) + (digit + np.uint32(48) << np.uint32(8 * (at % 4)))
        out.append((low, high, words))
        low, digits = high, digits + 1
    return out


def draws(heads: list[str], n: int) -> np.ndarray:
    """``draw(head, k)`` for every k below ``n`` (at most 2**31): a row for each head. All heads have as many bytes."""
    texts = [f"{h}:".encode() for h in heads]
    length, out = len(texts[0]), np.empty((len(texts), n), np.uint32)
    for low, high, tails in _tails(length, n):
        total = length + len(str(low))
        raw = np.zeros((len(texts), 64 * ((total + 8) // 64 + 1)), np.uint8)
        raw[:, :length] = np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), length)
        raw[:, total] = 0x80
        raw[:, -8:] = np.frombuffer((8 * total).to_bytes(8, "little"), np.uint8)
        fixed, rows = raw.view("<u4"), max(1, LANES // (high - low))
        for r in range(0, len(texts), rows):
            some = fixed[r : r + rows]
            same = (some == some[0]).all(0)
            for k in range(0, high - low, LANES):
                end = min(high - low, k + LANES)
                size, words = len(some) * (end - k), []
                for w in range(some.shape[1]):
                    tail = tails[w][k:end] if w in tails else None
                    if len(some) == 1 or same[w] and tail is None:
                        words.append((int(some[0, w]), tail))
                    else:
                        words.append((0, np.broadcast_to(some[:, w, None] + (np.uint32(0) if tail is None else tail), (len(some), end - k)).ravel()))
                state = list(_START)
                for block in range(0, len(words) - 16, 16):
                    state = [x + y & _FULL if isinstance(x, int) and isinstance(y, int) else y + np.uint32(x) if isinstance(x, int) else x + y for x, y in zip(state, _compress(state, words[block : block + 16], size, 64))]
                # the first word of the state is last written by step 60
                first = _compress(state, words[-16:], size, 61)[1] + (np.uint32(state[0]) if isinstance(state[0], int) else state[0])
                out[r : r + rows, low + k : low + end] = first.byteswap().reshape(len(some), end - k) & np.uint32(0x7FFFFFFF)
    return out
