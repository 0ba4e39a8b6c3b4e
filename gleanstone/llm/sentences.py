"""Sentence boundaries by a hidden-event trigram model over words of any script."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanstone.session import cut

MOST = 2_000_000  # entries of a model that is sent to every task; a larger one is joined

THAI, KANA = "฀-๿", "぀-ヿ㐀-鿿々〆ー"
OPEN, CLOSE = "\"“„«‹「『(（[【‘", "\"”“»›」』)）]】’"
PAIRS = {"“": "”", "„": "“", "«": "»", "‹": "›", "「": "」", "『": "』", "(": ")", "（": "）", "[": "]", "【": "】"}
TOKEN = re.compile(
    rf"(?P<blank>\n[^\S\n]*\n\s*)|(?P<thai>[{THAI}][{THAI}​]*)|(?P<kana>[{KANA}]+)|(?P<num>\d+(?:[.,:]\d+)*)|(?P<abbr>(?:[^\W\d_{THAI}{KANA}]{{1,2}}\.)+[^\W\d_]{{1,2}}(?![^\W\d_]))"
    rf"|(?P<word>[^\W\d_{THAI}{KANA}]+(?:['’\-][^\W\d_]+)*)|(?P<stop>[.!?…。！？｡]+)|(?P<other>\S)"
)
PARTICLES = ("ครับ", "ค่ะ", "คะ", "จ้ะ", "จ้า")  # fixed values: Thai polite particles that end a sentence
PROFILES = {  # fixed values: a few of the commonest words of languages that share a script
    "en": {"the", "and", "of", "to", "a", "in", "for", "with", "that", "was"},
    "de": {"und", "der", "die", "das", "den", "ich", "mit", "zu", "einer", "bei"},
    "es": {"de", "la", "el", "que", "los", "con", "y", "en", "una", "del"},
    "fr": {"le", "les", "et", "des", "est", "dans", "une", "pour", "qui", "du"},
}
SPEECH_WORDS = 40  # so many words without any stop are taken for unpunctuated speech

MAYBE = 0.3  # the prior of a stop behind a short capitalised word, until the corpus has been counted

B, NONE = 1, 0
STOP, SPACELESS, SHORT, KANJI = 1, 2, 3, 4  # kinds of tokens: stops, ends of Thai stretches, stops behind a short capitalised word, ends of Japanese or Chinese stretches; others are words
_ids: dict[str, int] = {}


def _id(form: str) -> int:
    x = _ids.get(form)
    if x is None:
        if len(_ids) > 1_000_000:
            _ids.clear()
        x = _ids[form] = zlib.crc32(form.encode()) | 2
    return x


def _mix(salt: int, *parts: np.ndarray | int) -> np.ndarray:
    h = np.array([salt * 0x9E3779B97F4A7C15 & (2**64 - 1)], np.uint64)
    for p in parts:
        h = (h ^ np.asarray(p, np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(29))
    return h.view(np.int64)


class Model:
    """Event counts by hashed event."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.n = np.append(keys[order], np.iinfo(np.int64).max), np.append(n[order], 0.0)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.n[at], 0.0)


def _quoted(text: str) -> list[tuple[int, int]]:
    """Spans of matched quotation marks and brackets within one paragraph each."""
    spans = []
    for para in re.finditer(r"(?:.|\n(?![^\S\n]*\n))+", text):
        stack: list[tuple[str, int]] = []
        plain = None
        for m in re.finditer(r"[\"“”„«»‹›「」『』()（）\[\]【】]", para.group()):
            c, i = m.group(), para.start() + m.start()
            if c == '"':
                if plain is None:
                    plain = i
                else:
                    spans.append((plain, i))
                    plain = None
                continue
            hit = next((k for k in range(len(stack) - 1, -1, -1) if PAIRS[stack[k][0]] == c), None)
            if hit is not None:
                spans.append((stack[hit][1], i))
                del stack[hit:]
            elif c in PAIRS:
                stack.append((c, i))
    return spans


class Batch:
    """Texts as one array of tokens, each with the prior probability that a sentence ends behind it."""

    def __init__(self, texts: list[str]):
        ids, cap, prior, at, last, stop, mark = [NONE, B], [0, 0], [0.0, 1.0], [-1, -1], [-1, -1], [0, 0], [B, B]
        for n, text in enumerate(texts):
            self._read(text, n, ids, cap, prior, at, last, stop, mark)
        ids += [NONE, NONE, NONE]
        for x in (cap, prior, at, last, stop, mark):
            x += [0, 0, 0]
        self.mark = np.array(mark, np.uint64)  # the boundary token of the paragraph's language
        self.ids, self.cap, self.stop = np.array(ids, np.uint64), np.array(cap, np.int8), np.array(stop, np.int8)
        self.prior, self.text, self.at = np.array(prior, float), np.array(last, np.int32), np.array(at, np.int32)

    PARTS = (("ids", np.uint64, np.uint32), ("mark", np.uint64, np.uint32), ("prior", np.float64, np.float32), ("text", np.int32, np.int32), ("at", np.int32, np.int32), ("cap", np.int8, np.int8), ("stop", np.int8, np.int8))

    def packed(self) -> bytes:
        return b"".join(getattr(self, name).astype(small).tobytes() for name, _, small in self.PARTS)

    @classmethod
    def unpacked(cls, raw: bytes) -> Batch:
        """The batch of ``packed`` bytes."""
        b = cls.__new__(cls)
        n, at = len(raw) // sum(np.dtype(small).itemsize for *_, small in cls.PARTS), 0
        for name, kind, small in cls.PARTS:
            setattr(b, name, np.frombuffer(raw, small, n, at).astype(kind))
            at += n * np.dtype(small).itemsize
        b.prior = np.round(b.prior, 6)
        return b

    @staticmethod
    def _read(text: str, n: int, ids: list, cap: list, prior: list, at: list, last: list, stop: list, mark: list) -> None:
        inside = np.zeros(len(text) + 2, bool)
        for a, b in _quoted(text):
            inside[a + 1 : b + 1] = True
        first = len(ids)
        shouts = not re.search(r"[^\W\d_]", text) or text.upper() == text or text.lower() == text
        words, speech = 0, []  # tokens since the last stop

        def put(form: str, upper: int, p: float, end: int, is_stop: int = 0) -> None:
            ids.append(_id(form))
            cap.append(upper)
            prior.append(p)
            at.append(end)
            last.append(n)
            stop.append(is_stop)
            mark.append(B)

        def name_language() -> None:
            """Give the paragraph's tokens the boundary token of its script or language."""
            nonlocal para
            total = sum(script.values())
            if total:
                best = max(script, key=script.get)
                if best == "latin" and hits:
                    best = max(hits, key=hits.get)
                b = _id("boundary in " + best)
                mark[para:] = [b] * (len(mark) - para)
            script.clear()
            hits.clear()
            para = len(mark)

        para = len(ids)
        script: dict[str, int] = {}
        hits: dict[str, int] = {}

        def unpunctuated() -> None:
            if words >= SPEECH_WORDS:
                for k in speech[:-1]:
                    prior[k] = max(prior[k], 0.05)

        previous = ""
        for m in TOKEN.finditer(text):
            kind, s, a, b = m.lastgroup, m.group(), m.start(), m.end()
            if kind == "blank":
                if len(ids) > first:
                    prior[-1], at[-1] = 1.0, a
                unpunctuated()
                name_language()
                words, speech, previous = 0, [], ""
                continue
            if kind == "stop":
                if s[-1] in ".…" and len(s) > 1 or s == "…":
                    s = "..."
                e = b
                while e < len(text) and text[e] in CLOSE and (text[e] != '"' or inside[e]):
                    e += 1
                p = Batch._prior(text, s, previous, a, b, e, bool(inside[e - 1]) and e > b, bool(inside[e]))
                put(s[:1] if s != "..." else s, 0, p, e, SHORT if p == MAYBE else STOP)
                unpunctuated()
                words, speech, previous = 0, [], s
                continue
            if kind == "other":
                if s in OPEN or s in CLOSE:
                    if stop[-1] not in (STOP, SHORT) and at[-1] == a and len(ids) > first:
                        at[-1] = b if s in CLOSE and inside[a] else at[-1]
                    continue
                put(s, 0, 0.0, b)
                continue
            if kind == "thai":
                s = s.replace("​", "")
            if kind in ("thai", "kana"):
                script[kind] = script.get(kind, 0) + len(s)
            if kind == "thai":
                put("P:" + s[:6], 0, 0.0, b)
                after = re.match(r"[\"”»)]*[^\S\n]*\n?[^\S\n]*(?=\S)", text[b : b + 40])
                gap = bool(after and re.search(r"\s", after.group())) and not inside[min(b + after.group().rfind('"') + 1, len(text))]
                ends = s.endswith(PARTICLES)
                quote = after.group().rstrip() if after else ""
                put("S:" + s[-4:] + quote, 0, (0.985 if ends and not quote else 0.03) if gap else 0.0, b + len(quote), SPACELESS)
                previous = s
                continue
            if kind == "kana":
                put("P:" + s[:2], 0, 0.0, b)
                put("S:" + s[-3:], 0, 0.05 if text[b : b + 1].isspace() and not inside[b] else 0.0, b, KANJI)
                previous = s
                continue
            words += 1
            low = s.lower()
            script["latin"] = script.get("latin", 0) + len(s)
            for lang, common in PROFILES.items():
                if low in common:
                    hits[lang] = hits.get(lang, 0) + 1
            put("#" if kind == "num" else low, 0 if shouts or kind == "num" else 1 + (s[0] != low[0]), 0.0, b)
            if not inside[b] and kind == "word":
                speech.append(len(ids) - 1)
            previous = s
        unpunctuated()
        name_language()
        if len(ids) > first:
            prior[-1], at[-1] = 1.0, len(text)

    @staticmethod
    def _prior(text: str, mark: str, before: str, a: int, b: int, e: int, closes: bool, held: bool) -> float:
        """How likely a stop ends a sentence, from what stands at its sides; the model then decides."""
        if held:
            return 0.0
        rest = text[e : e + 12]
        blank = rest[:1].isspace() or not rest
        nxt = rest.lstrip()[:1]
        if not nxt:
            return 1.0
        wide = mark[0] in "。！？｡"
        starts = nxt.isupper() or nxt in OPEN + "¿¡" or bool(re.match(rf"[{THAI}{KANA}]", nxt))
        if wide:
            return 0.02 if closes and not blank else 0.97
        if not blank and not (starts and len(before) > 2 and not nxt.isdigit()):
            return 0.0
        if nxt.islower():
            return 0.02
        if mark[0] in "!?":
            return 0.95 if starts or nxt.isdigit() else 0.1
        if mark == "...":
            return 0.1 if starts else 0.03
        if closes:
            return 0.9 if starts else 0.3
        if not starts:
            return 0.15
        if len(before) == 1 and before.isalpha():
            return 0.5 if before.islower() and re.search(r"\d\s?$", text[max(0, a - 4) : a - 1]) else 0.03  # a unit, else an initial
        if "." in before and not before[:1].isdigit():
            return 0.75 if nxt in OPEN else 0.6
        if before[:1].isdigit():
            return 0.4
        if 1 < len(before) <= 5 and before[:1].isupper() and before.isalpha():
            return MAYBE
        return 0.95

    # the model -----------------------------------------------------------------------------

    def keys(self):
        """Hash keys of the events at each token j: history (j-1, j), followed by j+1."""
        t = self.ids
        h2, h1, x = t[:-2], t[1:-1], t[2:]
        return h2, h1, x

    def counts(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashed events and their expected counts, if a sentence ends behind token j with probability p[j]."""
        h2, h1, x = self.keys()
        bound = self.mark[1:-1]
        events, weights = [], []

        def add(key: np.ndarray, w: np.ndarray) -> None:
            hit = w > 1e-3
            events.append(key[hit])
            weights.append(w[hit])

        pj, pb = p[1:-1], p[:-2]
        real = (x != NONE) & (h1 != NONE)
        for h, w in ((h2, 1 - pb), (bound, pb)):
            w = w * real
            add(_mix(3, h, h1, x), w * (1 - pj))
            add(_mix(3, h, h1, bound), w * pj)
            add(_mix(2, h, h1), w)
        add(_mix(5, h1, x), real * (1 - pj))
        add(_mix(5, h1, bound), real * pj)
        add(_mix(4, h1), real * 1.0)
        add(_mix(5, bound, x), real * pj)
        add(_mix(10, bound), real * pj)
        add(_mix(6, x), real * 1.0)
        capital = self.cap[2:]
        within = real * (1 - pj)  # inside a sentence
        add(_mix(7, bound, x), (capital > 0) * within)
        add(_mix(8, bound, x), (capital == 2) * within)
        # words before a stop's boundary, for text that has no stops
        s = (self.stop[1:-1] == STOP) | (self.stop[1:-1] == SHORT)
        add(_mix(9, np.concatenate([[NONE], h2[:-1]]), h2), s * pj)
        add(_mix(12, h2), s * pj)
        add(_mix(11, h2), (h1 == _id(".")) * 1.0)
        add(_mix(1, np.zeros(1)), np.array([real.sum() * 1.0]))
        return _summed(np.concatenate(events), np.concatenate(weights))

    def posterior(self, c: Model) -> np.ndarray:
        """Forward-backward probability of a sentence end behind each token."""
        h2, h1, x = self.keys()
        n = len(self.ids)
        total = max(c[_mix(1, np.zeros(1))][0], 1.0)
        pick = np.flatnonzero((self.prior > 0) & (self.prior < 1))
        p = self.prior.copy()
        if not len(pick):
            return p
        j = pick - 1  # index into h2, h1, x
        bs = self.mark[pick]
        ends = c[_mix(10, bs)]
        h2, h1, x = h2[j], h1[j], x[j]
        y = np.concatenate([self.ids, [NONE]])[pick + 2]
        mu = 2.0
        def given(event: np.ndarray, n: np.ndarray, lower: np.ndarray) -> np.ndarray:
            """Share of an event after a history seen n times, discounted so that a place doesn't vouch for itself; a tenth is kept for what is new."""
            return (np.maximum(c[event] - 0.75, 0) + (mu + 0.1 * n) * lower) / (1.1 * n + mu)

        uni = lambda w: (c[_mix(6, w)] + 0.1) / total
        bi = lambda g, w: given(_mix(5, g, w), c[_mix(4, g)], uni(w))
        tri = lambda f, g, w: given(_mix(3, f, g, w), c[_mix(2, f, g)], bi(g, w))
        start = lambda w: given(_mix(5, bs, w), ends, 0.1 * uni(w))  # noqa: E731  as far from the single word as tri
        # the class prior stands in where a history hasn't been seen
        pri = self.prior[pick]
        short = self.stop[pick] == SHORT
        if short.any():  # a form that hardly ever goes without the stop is an abbreviation
            seen_w = c[_mix(4, h2)]
            bare_share = np.clip(seen_w - c[_mix(11, h2)], 0, None) / (seen_w + 2)
            pri = np.where(short, 0.1 / (1 + seen_w / 10) + 0.85 * np.clip(8 * (bare_share - 0.02), 0, 1), pri)
        stop_b = lambda f: (c[_mix(3, f, h1, bs)] + mu * (c[_mix(5, h1, bs)] + mu * pri) / (c[_mix(4, h1)] + mu)) / (c[_mix(2, f, h1)] + mu)
        bare = (self.stop[pick] != STOP) & (self.stop[pick] != SHORT)
        spoken = c[_mix(9, h2, h1)]
        free = np.where(bare, (spoken + mu * 0.02) / (spoken + c[_mix(2, h2, h1)] + mu), 0)
        kanji = self.stop[pick] == KANJI
        if kanji.any():  # how often a stretch of this ending stands before a stop elsewhere
            free = np.where(kanji, (c[_mix(12, h1)] + mu * 0.02) / (c[_mix(4, h1)] + mu), free)
        thai = self.stop[pick] == SPACELESS
        ends_here = {0: np.where(bare & ~thai, free, stop_b(h2)), 1: np.where(bare & ~thai, free, stop_b(bs))}
        upper, seen = c[_mix(8, bs, x)], c[_mix(7, bs, x)]
        mid = (upper + 0.5) / (seen + 1.5)
        known, big = self.cap[pick + 1] > 0, self.cap[pick + 1] == 2
        case0, case1 = np.where(known, np.where(big, mid, 1 - mid), 1.0), np.where(known, np.where(big, 0.97, 0.03), 1.0)
        # the prior class weighs like one more witness beside the words; speech has none
        odds = np.where(bare & ~thai, 1.0, np.sqrt(pri / (1 - pri)))
        phi = np.empty((len(pick), 2, 2))
        phi[:, 0, 1] = ends_here[0] * start(x) * case1 * odds
        phi[:, 1, 1] = ends_here[1] * start(x) * case1 * odds
        phi[:, 0, 0] = tri(h2, h1, x) * case0 / odds
        phi[:, 1, 0] = tri(bs, h1, x) * case0 / odds
        after = np.empty((len(pick), 2))
        second = y != NONE
        after[:, 1] = np.where(second, tri(bs, x, np.where(second, y, 2)), 1)
        after[:, 0] = np.where(second, tri(h1, x, np.where(second, y, 2)), 1)
        joined = np.zeros(len(pick), bool)
        joined[1:] = np.diff(pick) == 1
        alone = ~joined & ~np.concatenate([joined[1:], [False]])
        one, zero = phi[:, 0, 1] * after[:, 1], phi[:, 0, 0] * after[:, 0]
        out = one / (one + zero)
        heads = np.flatnonzero(~joined & ~alone)
        for a in heads:
            b = a + 1
            while b < len(pick) and joined[b]:
                b += 1
            m = b - a
            f, g = np.empty((m, 2)), np.ones((m, 2))
            f[0] = phi[a, 0]
            for i in range(1, m):
                f[i] = f[i - 1] @ phi[a + i]
                f[i] /= f[i].sum()
            g[m - 1] = after[b - 1]
            for i in range(m - 2, -1, -1):
                g[i] = phi[a + i + 1] @ g[i + 1]
                g[i] /= g[i].sum()
            q = f * g
            out[a:b] = q[:, 1] / q.sum(1)
        p[pick] = out
        assert len(p) == n
        return p

    def spans(self, texts: list[str], p: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """Text number, sentence number, begin and end."""
        cut_at: dict[int, list[int]] = {}
        for j in np.flatnonzero(p >= 0.5):
            if self.text[j] >= 0 and self.at[j] >= 0:
                cut_at.setdefault(int(self.text[j]), []).append(int(self.at[j]))
        for n, text in enumerate(texts):
            begin, no = 0, 0
            for end in sorted({*cut_at.get(n, []), len(text)}):
                part = text[begin:end]
                body = part.strip()
                if body:
                    a = begin + len(part) - len(part.lstrip())
                    no += 1
                    yield n, no, a, a + len(body)
                begin = max(begin, end)


def _batches(pdf: pd.DataFrame, size: int = 400_000) -> Iterator[pd.DataFrame]:
    """Slices of a frame of about ``size`` characters, each text whole."""
    lengths = pdf["text"].str.len().to_numpy()
    group = np.cumsum(lengths) // size
    for _, part in pdf.groupby(group, sort=True):
        yield part


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    each, back = np.unique(keys, return_inverse=True)
    return each, np.bincount(back, n, len(each))


class _Wanted(Model):
    """Notes the events that are asked for; knows none."""

    def __init__(self):
        self.asked: list[np.ndarray] = []

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        self.asked.append(np.atleast_1d(keys))
        return np.zeros(len(self.asked[-1]))


READ = "batch bigint, holder array<string>, holder_id array<string>, texts array<string>, tokens binary"


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts in numbered batches, each with its packed tokens."""
    no = TaskContext.get().partitionId() << 32
    for pdf in frames:
        for part in _batches(pdf):
            texts = part["text"].tolist()
            yield pd.DataFrame({"batch": [no], "holder": [part["holder"].tolist()], "holder_id": [part["holder_id"].tolist()], "texts": [texts], "tokens": [Batch(texts).packed()]})
            no += 1


def _wanted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The events whose counts a batch needs."""
    for pdf in frames:
        for no, raw in zip(pdf["batch"], pdf["tokens"]):
            w = _Wanted()
            Batch.unpacked(raw).posterior(w)
            if w.asked:
                keys = np.unique(np.concatenate(w.asked))
                yield pd.DataFrame({"batch": np.full(len(keys), no), "key": keys})


def _own(r, model: Model | None) -> Model | None:
    """The model of a row: its own events where it carries them, else the one sent out."""
    return Model(np.asarray(r.keys, np.int64), np.asarray(r.n, float)) if hasattr(r, "n") and r.n is not None else model


def _count(model: Model | None):
    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, n, size = [], [], 0
        for pdf in frames:
            for r in pdf.itertuples():
                b, m = Batch.unpacked(r.tokens), _own(r, model)
                k, x = b.counts(b.prior if m is None else b.posterior(m))
                keys.append(k)
                n.append(x)
                size += len(k)
                if size > 2_000_000:  # what has come together so far goes out, summed up
                    k, x = _summed(np.concatenate(keys), np.concatenate(n))
                    yield pd.DataFrame({"key": k, "n": x})
                    keys, n, size = [], [], 0
        if keys:
            k, x = _summed(np.concatenate(keys), np.concatenate(n))
            yield pd.DataFrame({"key": k, "n": x})

    return scan


def _decode(model: Model):
    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples():
                b = Batch.unpacked(r.tokens)
                rows = list(b.spans(list(r.texts), b.posterior(_own(r, model))))
                if rows:
                    n, no, a, e = map(np.array, zip(*rows))
                    yield pd.DataFrame({"holder": np.array(r.holder, object)[n], "holder_id": np.array(r.holder_id, object)[n], "sent_no": no.astype(np.int32), "begin_pos": a.astype(np.int32), "end_pos": e.astype(np.int32)})

    return scan


def _with_model(texts: DataFrame, wanted: DataFrame, before: Model | DataFrame | None) -> tuple[DataFrame, Model | None]:
    """Batches with the model they need: one for all if it is small, else each with its own events."""
    if not isinstance(before, DataFrame):
        return texts, before
    own = wanted.join(before, "key").groupBy("batch").agg(F.collect_list(F.struct("key", "n")).alias("own"))
    return texts.join(own.select("batch", F.col("own.key").alias("keys"), F.col("own.n").alias("n")), "batch", "left"), Model(np.zeros(0, np.int64), np.zeros(0))


def _model(texts: DataFrame, wanted: DataFrame, before: Model | DataFrame | None, most: int) -> Model | DataFrame:
    """Counts over all texts: on the driver if there are at most ``most`` of them, else a table."""
    batches, sent = _with_model(texts.select("batch", "tokens"), wanted, before)
    got = cut(batches.mapInPandas(_count(sent), "key bigint, n double").groupBy("key").agg(F.sum("n").alias("n")))
    if got.count() > most:
        return got
    pdf = got.toPandas()
    return Model(pdf["key"].to_numpy(np.int64), pdf["n"].to_numpy(float))


def sentences(texts: DataFrame, rounds: int = 3, most: int = MOST) -> DataFrame:
    """holder, holder_id, sent_no, begin_pos, end_pos of the sentences of ``texts`` (holder, holder_id, text).

    Positions are code points, end exclusive, without outer blanks; every character that isn't
    blank belongs to one sentence. Null, empty and blank texts have none; repeated (holder,
    holder_id) rows are each divided; other columns are ignored.

    Boundary tokens stand between words as hidden events of a trigram model: the chance of a
    boundary behind two words, of the next words behind a boundary, and of going on. Counts of
    all texts start from what stops, particles and blank lines suggest and are taken again from
    the forward-backward posteriors (``rounds`` times in all); a boundary is set where its
    posterior is a half or more. A short capitalised word counts as an abbreviation as far as it
    never goes without its stop in the corpus. Blank lines always divide, matched quotations and
    brackets never do. Scripts without spaces enter as the beginnings and ends of their stretches;
    a blank behind a Japanese stretch is open to a boundary, and so is every word of a stretch of
    ``SPEECH_WORDS`` words or more without any stop (a shorter one is one sentence).

    No event is left out, however many there are. Up to ``most`` of them are collected and sent
    to every task; a larger model stays a table, and each batch of texts gets the counts of its own
    events by a join. Both ways give the same result.
    """
    texts = texts.select("holder", "holder_id", "text").where(F.length(F.trim("text")) > 0)
    texts = cut(texts.mapInPandas(_read, READ))
    wanted = texts.select("batch", "tokens").mapInPandas(_wanted, "batch bigint, key bigint")
    model = None
    for _ in range(rounds):
        model = _model(texts, wanted, model, most)
    batches, sent = _with_model(texts, wanted, model)
    return batches.mapInPandas(_decode(sent), "holder string, holder_id string, sent_no int, begin_pos int, end_pos int")
