"""Held-out texts inside a corpus: q-gram lemma filter on diagonal bands, banded alignment."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_CHARS = 4_000_000  # held-out characters that one pass over the corpus is held against
Q = (16, 8, 4, 2, 1)  # lengths of q-grams; an item takes the longest for which the lemma still asks for a hit
WORD, DENSE_WORD = 5, 2  # letters of a changed word, in scripts of letters and in dense ones
BAND = 64  # diagonals in half a band; bands overlap by half
WIDE = 40  # diagonals at either side in the alignment
PENALTY = 1.5  # of an edited character, against 1 for a matching one
START_BITS = 31  # of an alignment cell, for its start in the item

# one class of first characters, so that the search may skip to them; what each begins stands behind a look back at it
MARKS = re.compile(r"[\[\d\\<&\-](?:(?<=\[)\d+(?:[.:,]\d+)*\s?s?\]|(?<=\d)\d?:\d\d:\d\d(?:[.,]\d+)?(?:\s*-->\s*\d\d?:\d\d:\d\d(?:[.,]\d+)?)?|(?<=\\)[nrt\"]|(?<=<)[^<>\n]{0,80}>|(?<=&)[a-z]{2,6};|(?<=\w-)\n(?=\w))")
ESCAPED = re.compile(r"\\u([0-9a-fA-F]{4})")

_points = np.arange(0x33500)  # no letters or digits beyond
_lower, _keep = np.zeros(len(_points), np.uint32), np.zeros(len(_points), bool)
for _c in range(len(_points)):
    if not 0xD800 <= _c < 0xE000:
        _s = chr(_c)
        _keep[_c] = _s.isalnum() or 0x0E00 <= _c <= 0x0E7F
        _lower[_c] = ord(_s.lower()) if len(_s.lower()) == 1 else _c


def squeeze(text: str) -> np.ndarray:
    """The text's letters and digits in lower case, without time marks, markup and escapes."""
    if "\\u" in text:
        text = ESCAPED.sub(lambda m: chr(int(m[1], 16)), text)
    text = MARKS.sub(" ", text)
    c = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    c = c[c < len(_keep)]
    return _lower[c[_keep[c]]]


def words(text: str) -> str:
    """The text's words as ``squeeze`` reads them, a blank at either side of each; dense scripts without blanks."""
    if dense(squeeze(text)):
        return "".join(map(chr, squeeze(text)))
    return " " + " ".join(w for x in MARKS.sub(" ", text).split() for part in re.split(r"[^\w\u0e00-\u0e7f]+|_", x) if (w := "".join(map(chr, squeeze(part))))) + " "


def grams(c: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams; those that run over a separator (0) are 0."""
    n = len(c) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, power, k = c.astype(np.uint64), 0x9E3779B97F4A7C15, 1
    while k < q:  # q is a power of two: the hash of 2k letters from those of k
        h = h[:-k] * np.uint64(power) + h[k:]
        power, k = power * power & (1 << 64) - 1, 2 * k
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    gaps = np.concatenate([[0], np.cumsum(c == 0)])
    h[gaps[q:] != gaps[: n]] = 0
    return h


def in_order(*columns: np.ndarray) -> np.ndarray:
    """What ``np.lexsort`` gives, but for rows alike: one sort of the columns' bits side by side where they fit."""
    low = [int(c.min()) for c in columns]
    bits = [(int(c.max()) - x).bit_length() for c, x in zip(columns, low)]
    if sum(bits) > 63:
        return np.lexsort(columns)
    key = np.zeros(len(columns[0]), np.int64)
    for c, x, b in reversed(list(zip(columns, low, bits))):
        key = key << b | c.astype(np.int64) - x
    return np.argsort(key)


def dense(c: np.ndarray) -> bool:
    """Whether a text is mostly in a script whose characters stand for syllables or words."""
    return len(c) > 0 and np.mean(c >= 0x2E80) > 0.3


def step(q: int) -> int:
    """Every so many letters of an item a q-gram is looked up, at every place of a document."""
    return max(1, q // 4)


def lemma(stretch: np.ndarray, q: int, word: int, edited: float) -> np.ndarray:
    """q-gram lemma: how many of its looked-up q-grams a stretch of so many letters keeps at least.

    Up to the share ``edited`` of its letters may be changed, in words of ``word`` letters; a changed
    word touches at most q + word - 1 neighbouring q-grams, so one in ``step`` of those, rounded up.
    """
    words = np.floor(edited * stretch / word)
    return (stretch - q + 1) // step(q) - words * -(-(q + word - 1) // step(q))


class Index:
    """The q-grams of a block of items."""

    def __init__(self, ids: list[int], texts: list[str], part: float, least_score: float):
        self.ids, self.part = np.array(ids), part
        self.text = [squeeze(t) for t in texts]
        self.n = np.array([len(t) for t in self.text])
        edited = (1 - least_score) / (1 + PENALTY)  # edits of which the alignment keeps the asked score
        # of a long stretch, some part of this length has no more edits than the whole; there they can't leave the band
        stretch = np.minimum(np.ceil(part * self.n), int(BAND / edited))
        word = np.array([DENSE_WORD if dense(t) else WORD for t in self.text])
        self.whole = {int(i): words(texts[i]) for i in np.flatnonzero((stretch < np.where(word == WORD, Q[0], Q[1])) & (self.n > 0))}
        stretch[list(self.whole)] = self.n[list(self.whole)]
        edited = np.where(np.isin(np.arange(len(texts)), list(self.whole)), 0.0, edited)
        self.least, size = np.ones(len(texts), np.int64), np.zeros(len(texts), np.int64)
        for q in Q:
            asked = np.array([lemma(s, q, w, e) for s, w, e in zip(stretch, word, edited)])
            fits = (size == 0) & (asked >= 1) & ((q <= 8) | (word == WORD))
            size[fits], self.least[fits] = q, asked[fits]
        self.tables = {q: self._table(np.flatnonzero(size == q), q) for q in Q}

    def _table(self, items: np.ndarray, q: int):
        """The items' q-grams in order of their hashes, with a bitmap of hash prefixes."""
        every = [grams(self.text[i], q)[:: step(q)] for i in items]
        key = np.concatenate(every) if every else np.zeros(0, np.uint64)
        item = np.repeat(items, [len(g) for g in every]).astype(np.int64)
        at = np.concatenate([step(q) * np.arange(len(g)) for g in every]) if every else np.zeros(0, np.int64)
        order = np.argsort(key, kind="stable")
        key, item, at = key[order], item[order], at[order]
        each, first, count = np.unique(key, return_index=True, return_counts=True)
        seen = np.zeros(1 << 22, bool)
        seen[(each >> np.uint64(42)).astype(np.int64)] = True
        return each, first, count, item, at, seen

    def candidates(self, docs: list[np.ndarray]):
        """(document, item, diagonal, first and last item position, hits) of bands with enough hits."""
        out = []
        lengths = np.array([len(d) + 1 for d in docs])
        begins = np.cumsum(lengths) - lengths
        zero = np.zeros(1, np.uint32)
        joined = np.concatenate([x for d in docs for x in (d, zero)]) if docs else zero
        for q, (each, first, count, item, at, seen) in self.tables.items():
            if not len(each):
                continue
            g = grams(joined, q)
            pos = np.flatnonzero(seen[(g >> np.uint64(42)).astype(np.int64)] & (g != 0))
            slot = np.minimum(np.searchsorted(each, g[pos]), len(each) - 1)
            good = each[slot] == g[pos]
            pos, slot = pos[good], slot[good]
            if not len(pos):
                continue
            n = count[slot]
            total = int(n.sum())
            offset = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
            post = np.repeat(first[slot], n) + offset
            p, it, k = np.repeat(pos, n), item[post], at[post]
            doc = np.searchsorted(begins, p, side="right") - 1
            # pairs may share a counter, which only lets more of them on
            pair = (doc * 0x9E3779B1 + it) & (1 << 20) - 1
            enough = np.bincount(pair, minlength=1 << 20)[pair] >= self.least[it]
            p, it, k, doc = p[enough], it[enough], k[enough], doc[enough]
            if not len(p):
                continue
            diagonal = p - begins[doc] - k
            band = np.concatenate([diagonal // BAND, diagonal // BAND + 1])
            rows = np.tile(np.arange(len(p)), 2)
            order = in_order(k[rows], band, it[rows], doc[rows])
            rows, band = rows[order], band[order]
            new = np.concatenate([[True], (np.diff(doc[rows]) != 0) | (np.diff(it[rows]) != 0) | (np.diff(band) != 0)])
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(rows))
            # a q-gram of the item counts once in a band
            fresh = np.cumsum(new | np.concatenate([[True], np.diff(k[rows]) != 0]))
            hits = fresh[end - 1] - fresh[begin] + 1
            enough = np.flatnonzero(hits >= self.least[it[rows[begin]]])
            for a, b, n in zip(begin[enough], end[enough], hits[enough]):
                r = rows[a:b]
                out.append((int(doc[r[0]]), int(it[r[0]]), int(np.median(diagonal[r])), int(k[r[0]]), int(k[r[-1]]) + q, int(n)))
        return out

    def verify(self, docs: list[np.ndarray], found: list[tuple], least_score: float, size: int = 64) -> dict[tuple[int, int], float]:
        """The part of the item that the best local alignment covers, for each (document, item) that holds enough of it.

        Of a pair's bands the one with the most hits comes first, the next only while none has held.
        """
        out: dict[tuple[int, int], float] = {}
        bands: dict[tuple[int, int], list[tuple]] = {}
        for x in sorted(found, key=lambda x: -x[5]):
            near = bands.setdefault(x[:2], [])
            # overlapping halves often hold the same hits
            if not any(y[2] == x[2] and y[3] <= x[3] and y[4] >= x[4] for y in near):
                near.append(x)
        turn = 0
        while rest := sorted((b[turn] for pair, b in bands.items() if len(b) > turn and pair not in out), key=lambda x: x[4] - x[3]):
            for a in range(0, len(rest), size):
                for d, i, share, score in self._align(docs, rest[a : a + size]):
                    if share >= self.part and score >= least_score:
                        out[d, i] = share
            turn += 1
        return out

    def _align(self, docs: list[np.ndarray], some: list[tuple]) -> list[tuple[int, int, float, float]]:
        m, width = len(some), 2 * WIDE + 1
        reach = 40
        lo = np.array([max(0, x[3] - reach) for x in some])
        hi = np.array([min(self.n[x[1]], x[4] + reach) for x in some])
        steps = int((hi - lo).max())
        item = np.zeros((m, steps), np.uint32)
        near = np.full((m, steps + width), 0xFFFFFFFF, np.uint32)
        for r, (d, i, diag, *_) in enumerate(some):
            item[r, : hi[r] - lo[r]] = self.text[i][lo[r] : hi[r]]
            begin = lo[r] + diag - WIDE
            a, b = max(0, begin), min(len(docs[d]), begin + steps + width)
            if b > a:
                near[r, a - begin : b - begin] = docs[d][a:b]
        # a cell's number is its score in halves, then where its alignment starts: of equal scores the later start, the denser one
        one = 1 << START_BITS
        edit = int(2 * PENALTY) * one
        lift = edit * np.arange(width)
        cell, base = np.zeros((m, width), np.int64), np.empty((m, width), np.int64)
        best, span = np.zeros(m, np.int64), np.zeros(m, np.int64)
        for s in range(steps):
            # both letters, alike or not
            np.multiply(near[:, s : s + width] == item[:, s, None], 2 * one + edit, out=base)
            base += cell
            # the item's letter without a partner: from the next diagonal
            np.maximum(base[:, :-1], cell[:, 1:], out=base[:, :-1])
            base -= edit
            np.maximum(base, s + 1, out=base)
            # letters of the document without a partner: along the row
            base += lift
            np.maximum.accumulate(base, 1, out=cell)
            cell -= lift
            top = cell.max(1)
            now = top >> START_BITS
            live = (now > best) & (lo + s < hi)
            best = np.where(live, now, best)
            span = np.where(live, s + 1 - (top & one - 1), span)
        return [(d, i, float(span[r] / self.n[i]), float(best[r] / 2 / max(1, span[r]))) for r, (d, i, *_) in enumerate(some)]


def _scan(index: Index, least_score: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            size = np.cumsum(pdf["text"].str.len().to_numpy()) // 1_000_000
            for _, part in pdf.groupby(size, sort=False):
                texts = part["text"].tolist()
                docs = [squeeze(t) for t in texts]
                found = index.candidates(docs)
                hits = index.verify(docs, [x for x in found if x[1] not in index.whole], least_score)
                hits |= {x[:2]: 1.0 for x in found if x[1] in index.whole and index.whole[x[1]] in words(texts[x[0]])}
                if hits:
                    key = np.array(list(hits))
                    yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy()[key[:, 0]], "item_id": index.ids[key[:, 1]], "share": list(hits.values())})

    return run


def leaks(docs: DataFrame, items: DataFrame, part: float = 0.4, least_score: float = 0.7, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, share: documents that hold at least ``part`` of an item's text in one stretch.

    ``docs`` (doc_id BIGINT, text), ``items`` (item_id BIGINT, text). Texts are compared by their
    letters and digits; case, punctuation, blanks, line breaks, time marks and markup don't count,
    and single words may differ. ``share`` is the part of the item that the best stretch covers.
    Null and empty texts and texts without letters and digits match nothing; a repeated (doc_id, text) gives one row; the
    same text under several ids leaks under each; empty tables give an empty result; other columns
    are ignored.

    Items are taken in blocks of about ``block_chars`` characters, each held against all documents
    in one scan, so that the index sent out is bounded however many items there are. An item's
    q-grams at regular steps are looked up at every place of the documents, the different ones
    counted in overlapping bands of diagonals, and bands that meet the q-gram lemma's bound for
    the edit budget verified by banded local alignment; no stretch within the budget is missed. The budget is what the score allows: (1 - ``least_score``) / 2.5 of the letters,
    in changed words. An item of which ``part`` is shorter than a q-gram must stand in the document
    whole, word for word; its q-grams are shorter, down to single letters.
    """
    docs = docs.select("doc_id", "text").where("doc_id is not null and length(text) > 0")
    items = items.select("item_id", "text").where("item_id is not null and length(text) > 0").distinct()

    def blocks() -> Iterator[list]:
        block, size = [], 0
        for r in items.toLocalIterator():
            block.append(r)
            size += len(r["text"])
            if size >= block_chars:
                yield block
                block, size = [], 0
        if block:
            yield block

    schema = "doc_id bigint, item_id bigint, share double"
    out = None
    for block in blocks():
        one = docs.mapInPandas(_scan(Index([r["item_id"] for r in block], [r["text"] for r in block], part, least_score), least_score), schema)
        out = one if out is None else out.unionByName(one)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    return out.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))
