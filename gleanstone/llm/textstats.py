"""Text quality statistics and the nearest structural profile of each document."""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Common function words by language and class; in scripts without spaces, common particles.
FUNCTION = {
    "article": "the a an this that these those der die das den dem des ein eine einer einem el la los las un una unos aquel",
    "preposition": "of to in for with at by from on about after before until into without behind von mit zu zum zur bei für auf im am aus nach vor über um an in de del por para en con sin sobre hasta desde entre hacia",
    "conjunction": "and or but if so because than while although since und oder aber weil denn dass wenn y o pero porque que si cuando como",
    "pronoun": "i we you he she they it my our your his her their who which what ich wir sie er es mein meine man wer was yo nosotros mi me se lo le su nuestro nuestra",
    "auxiliary": "was were is are be been will would should could have had has did not haben hat habe wurde war ist sind nicht fue está es hizo no había",
}
PARTICLES = "ที่ และ ของ ผม ดิฉัน ให้ ว่า การ เป็น ไม่ กับ ต้อง แล้ว ครับ ค่ะ คะ จน ได้ จาก の を に は が と で た し て も です ます から".split()
CLASSES = [*FUNCTION, "particle", "content", "single", "long", "number"]
# Letter shares in running prose, in per mille, a to z and then all other letters.
LETTERS = {
    "en": [82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1, 1],
    "de": [62, 19, 31, 49, 161, 16, 30, 46, 75, 3, 13, 36, 25, 97, 26, 8, 1, 71, 66, 62, 42, 8, 19, 1, 1, 11, 22],
    "es": [119, 13, 40, 50, 126, 7, 11, 8, 60, 5, 1, 52, 30, 68, 88, 25, 9, 68, 77, 43, 32, 11, 1, 2, 10, 5, 39],
}
LANGUAGES = np.array([np.array(v, float) / sum(v) for v in LETTERS.values()])
EVEN = np.append(np.full(26, 1 / 26.0), 0.0)
KINDS = ("prose", "list", "table", "junk")

# Classes of characters.
BLANK, BREAK, LATIN, THAI, KANA, HAN, DIGIT, STOP, COMMA, FIELD, QUOTE, BULLET, ANGLE, SYMBOL, BROKEN = range(15)


@cache
def character_classes() -> tuple[np.ndarray, np.ndarray]:
    """The class of every code point, and its lower case."""
    c = np.full(0x110000, SYMBOL, np.uint8)
    low = np.arange(0x110000, dtype=np.uint32)
    for a in range(0x250, 0x3000):
        if chr(a).isalpha():
            c[a] = LATIN
    for a in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250)):
        if chr(a).isalpha():
            c[a], low[a] = LATIN, ord(chr(a).lower()[0])
    c[0xAC00:0xD7A4] = c[0xF900:0xFB00] = c[0x20000:0x33500] = LATIN
    c[0x0E01:0x0E5C], c[0x3040:0x3100], c[0x3400:0xA000] = THAI, KANA, HAN
    c[48:58] = c[0x0E50:0x0E5A] = DIGIT
    c[:32] = c[0x80:0xC0] = c[0x7F] = c[0xFFFD] = BROKEN  # signs of wrong decoding
    for signs, k in (("  　​\r", BLANK), ("\n", BREAK), (".!?…。！？", STOP), (",、，;:", COMMA), ("|\t={}_\\", FIELD), ("\"'“”‘’„«»()[]「」『』（）¿¡", QUOTE), ("-*+•‣▪●○◦·→–—/✓✔☐☑□■", BULLET), ("<>&#", ANGLE), ("ªº", LATIN), ("°§£©®±", SYMBOL), ("々〆ー", HAN)):
        for s in signs:
            c[ord(s)] = k
    return c, low


def _hash(words: list[str]) -> np.ndarray:
    """Hashes of words, as of those in a text."""
    out = np.zeros(len(words), np.uint64)
    for i, w in enumerate(words):
        h = 7
        for x in w:
            h = (h * 0x100000001B3 + ord(x)) & 2**64 - 1
        out[i] = h
    return out


@cache
def function_words() -> tuple[np.ndarray, np.ndarray]:
    seen = {w: k for k, words in reversed(list(enumerate(FUNCTION.values()))) for w in words.split()}
    h, k = _hash(list(seen)), np.array(list(seen.values()))
    order = np.argsort(h)
    return h[order], k[order]


def _entropy(p: np.ndarray) -> np.ndarray:
    p = np.asarray(p, float)
    return -(p * np.log2(p + 1e-300)).sum(-1)


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon divergence in bits, over the last axis."""
    return _entropy((p + q) / 2) - (_entropy(p) + _entropy(q)) / 2


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(-1, keepdims=True), 1e-9)


class Counts:
    """Counts of many texts at once: characters, words, lines and letters by class, a row a text."""

    def __init__(self, texts: list[str]):
        classes, low = character_classes()
        parts = [np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32) for t in texts]
        self.size = np.array([len(x) for x in parts])
        n = len(texts)
        end = np.array([10], np.uint32)
        c = low[np.concatenate([y for x in parts for y in (x, end)])]
        k = classes[c]
        doc = np.repeat(np.arange(n), self.size + 1)
        mine = np.ones(len(c), bool)
        mine[np.cumsum(self.size + 1) - 1] = False
        self.chars = np.bincount(doc[mine] * 15 + k[mine], minlength=15 * n).reshape(n, 15).astype(float)
        self.ink = self.chars[:, LATIN:].sum(1)
        self.dense = self.chars[:, THAI : HAN + 1].sum(1)

        # words: stretches of letters of scripts with spaces, of digits; apostrophes within belong to them
        letter = k == LATIN
        edge = np.flatnonzero(np.diff(np.concatenate([[0], letter.view(np.int8), [0]])))
        begin, stop = edge[::2], edge[1::2]
        length, owner = stop - begin, doc[begin]
        h = np.full(len(begin), 7, np.uint64)
        for j in range(min(int(length.max(initial=0)), 24)):  # two words that agree so far count as one
            on = length > j
            h[on] = h[on] * np.uint64(0x100000001B3) + c[begin[on] + j]
        known, of = function_words()
        slot = np.minimum(np.searchsorted(known, h), len(known) - 1)
        kind = np.where(known[slot] == h, of[slot], np.where(length == 1, 7, np.where(length > 20, 8, 6)))
        self.words = np.bincount(owner * 10 + kind, minlength=10 * n).reshape(n, 10).astype(float)
        self.n_words, self.letters = np.bincount(owner, minlength=n), np.bincount(owner, length, n)
        digit = k == DIGIT
        inner = np.concatenate([[False], np.isin(c[:-1], [44, 46, 58])]) & np.concatenate([[False, False], digit[:-2]])  # decimals
        number = digit & ~np.concatenate([[False], digit[:-1]]) & ~inner
        numbers = np.bincount(doc[number], minlength=n)
        self.words[:, 9] = numbers
        particles = np.array([sum(t.count(w) * len(w) for w in PARTICLES) if d else 0 for t, d in zip(texts, self.dense)], float)
        particles = np.minimum(particles, self.dense)
        self.words[:, 5] += particles / 4  # a word of such a script is taken for four characters
        self.words[:, 6] += (self.dense - particles) / 4
        pair = (np.unique((owner.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24))) >> np.uint64(40)).astype(np.int64)
        distinct = np.bincount(pair, minlength=n)
        self.variety = np.stack([distinct + (self.dense + self.chars[:, DIGIT]) / 4, np.maximum(self.n_words - distinct, 0)], 1)

        # lines: what they begin and end with, and what is in them
        ends = np.flatnonzero(k == BREAK)
        starts = np.concatenate([[0], ends[:-1] + 1])
        solid = (k != BLANK) & (k != BREAK) & (c != 9)
        total = np.concatenate([[0], np.cumsum(solid)])
        width = total[ends] - total[starts]
        real = width > 0
        starts, ends, width = starts[real], ends[real], width[real]
        at = np.flatnonzero(solid)
        head, tail = at[total[starts]], at[total[ends] - 1]
        back = tail.copy()
        for _ in range(3):  # closing marks behind the stop
            back = np.where((k[back] == QUOTE) & (back > head), back - 1, back)
        within = lambda x: (s := np.concatenate([[0], np.cumsum(x)]))[ends] - s[starts]
        nxt = np.concatenate([k[1:], [BREAK]])
        after = np.concatenate([k[2:], [BREAK, BREAK]])
        polite = np.isin(c, [0x0E1A, 0x0E30]) & (np.concatenate([[0, 0], c[:-2]]) == 0x0E23) | (c == 0x0E30) & np.isin(np.concatenate([[0], c[:-1]]), [0x0E04, 0x0E48])
        closes = (k == STOP) & ((nxt == BLANK) & (np.concatenate([[SYMBOL], k[:-1]]) != DIGIT) | (nxt == BREAK) | (nxt == QUOTE) | (c > 0x3000)) | polite & (nxt != THAI)
        stops = within(closes)
        gaps = (k == BLANK) & (nxt == BLANK) & (after == BLANK) & np.concatenate([[False], k[:-1] != BLANK])
        fields = within((k == FIELD) & (c != 0x5F) | (c == 59) | gaps | (c == 44) & (nxt != BLANK))
        figures = within(number)
        parts_in = within((k == COMMA) & (c != 58) | np.isin(c, [0xB7, 0x2022]) | (c == 47))
        dense = within((k >= THAI) & (k <= HAN))
        wide = width + 1.2 * dense  # such a character says more
        then = lambda i: k[np.minimum(head + i, len(c) - 1)] == BLANK
        sign = lambda i, *x: np.isin(c[np.minimum(head + i, len(c) - 1)], x)
        marker = (k[head] == BULLET) & (then(1) | (k[np.minimum(head + 1, len(c) - 1)] != BULLET)) | sign(1, 41, 46) & then(2) & (k[head] != QUOTE) | sign(2, 41, 46) & then(3) & (k[head] == DIGIT) | sign(0, 91) & (sign(1, 93) | sign(2, 93))
        ended = closes[back] | (k[back] == STOP)
        row = (fields + figures >= 3) & (fields >= 2) & (fields * 40 >= wide) & (stops <= 1) | (figures >= 2) & (figures * 22 >= wide) & ~(ended & (stops > 0) & (figures * 12 < wide))
        row |= (fields >= 1) & (figures >= 1) & (wide <= 60) & (stops == 0) & (c[head] != 91)
        segments = (parts_in >= 4) & (parts_in * 50 >= wide) & (stops <= 1 + parts_in // 6) & ~row
        even = np.zeros(len(wide), bool)  # about as long as the line before or behind it, as where lines were broken at one width
        if len(wide) > 1:
            pair = (doc[starts[1:]] == doc[starts[:-1]]) & (np.minimum(wide[1:], wide[:-1]) >= 0.75 * np.maximum(wide[1:], wide[:-1])) & (np.minimum(wide[1:], wide[:-1]) >= 42)
            even[1:] |= pair
            even[:-1] |= pair
        full = even & ~ended
        what = np.select([within((k >= LATIN) & (k <= HAN)) + figures == 0, row, marker, segments, (stops >= 2) | ended & (wide > 25), ended, ~full & (wide <= 75)], [0, 1, 2, 3, 4, 5, 6], 7)
        self.lines = np.bincount(doc[starts] * 8 + what, np.minimum(wide, 400), 8 * n).reshape(n, 8)
        self.n_lines = np.bincount(doc[starts], minlength=n)
        self.stopped = np.bincount(doc[starts], ended, n)
        # neighbours in scripts without spaces: consonants, vowels and tones, kana and Han
        p = np.full(len(c), 7, np.int64)
        thai, kana = k == THAI, k == KANA
        p[thai] = np.select([c[thai] < 0x0E30, (c[thai] >= 0x0E40) & (c[thai] < 0x0E47), (c[thai] >= 0x0E47) & (c[thai] < 0x0E4F)], [0, 1, 2], 3)
        p[kana] = np.where(c[kana] < 0x30A0, 4, 5)
        p[k == HAN] = 6
        both = (p[1:] < 7) & (p[:-1] < 7)
        self.neighbours = np.bincount(doc[1:][both] * 49 + (p[:-1] * 7 + p[1:])[both], minlength=49 * n).reshape(n, 49).astype(float)
        a = c[letter].astype(np.int64)
        a = np.where((a >= 97) & (a < 123), a - 97, 26)
        self.alphabet = np.bincount(doc[letter] * 27 + a, minlength=27 * n).reshape(n, 27).astype(float)

    def strangeness(self) -> tuple[np.ndarray, np.ndarray]:
        """Divergence of the letters from the nearest language's prose, and from letters without order, less what few letters differ by chance.

        Of scripts with spaces the shares of the letters are compared, of Thai and Japanese those of neighbouring kinds of characters.
        """
        p, n = _shares(self.alphabet), self.alphabet.sum(1)
        q, m = _shares(self.neighbours), self.neighbours.sum(1)
        ordered, mixed = neighbour_profiles()
        thin, dense = 12.0 / np.maximum(n, 1), m > n
        far = np.where(dense, _from_profiles(q, ordered).min(1) - 20.0 / np.maximum(m, 1), divergence(p[:, None, :], LANGUAGES[None, :, :]).min(1) - thin)
        even = np.where(dense, _from_profiles(q, mixed).min(1) + 0.05 - 20.0 / np.maximum(m, 1), divergence(p, EVEN[None, :]) - thin)
        few = np.where(dense, m < 40, n < 12)
        return np.where(few, 0.0, np.maximum(far, 0)), np.where(few, 0.0, np.maximum(even, 0))

    def views(self) -> list[np.ndarray]:
        """Distributions of each text: characters, words, lines, variety, broken characters."""
        x = self.chars
        chars = np.stack([x[:, BLANK], x[:, BREAK], x[:, LATIN : HAN + 1].sum(1), *(x[:, i] for i in range(DIGIT, 15))], 1)
        broken = x[:, BROKEN]
        return [_shares(chars), _shares(self.words), _shares(self.lines), _shares(self.variety), _shares(np.stack([broken, self.ink - broken], 1))]


# Samples that the profiles are counted from: prose of each language, entries, and what is made of them.
PROSE = {
    "en": "When I joined the team, the schedule was a mess and nobody knew who had the key. I asked each of them what they needed, and then we wrote a plan together. It took about 3 weeks, but in the end the guests were happy. Would you do it again? I would, because it helped us to see what was missing.",
    "de": "Als ich in das Team kam, war der Plan ein Durcheinander und niemand wusste, wer den Schlüssel hatte. Ich habe alle gefragt, was sie brauchen, und dann haben wir zusammen eine Liste geschrieben. Es hat etwa 3 Wochen gedauert, aber am Ende waren die Gäste zufrieden. Würden Sie das noch einmal so machen? Ja, weil es uns geholfen hat.",
    "es": "Cuando llegué al equipo, el plan era un caos y nadie sabía quién tenía la llave. Pregunté a todos qué necesitaban y luego escribimos una lista con los compañeros. Tardamos unas 3 semanas, pero al final los huéspedes se fueron contentos. ¿Lo haría usted otra vez? Sí, porque nos ayudó a ver lo que faltaba.",
    "th": "ตอนที่ผมเข้าทีมใหม่ แผนงานยุ่งมากและไม่มีใครรู้ว่าใครถือกุญแจครับ ผมถามทุกคนว่าต้องการอะไร แล้วเราก็เขียนรายการด้วยกันครับ ใช้เวลาประมาณ 3 สัปดาห์ แต่ในที่สุดลูกค้าก็พอใจค่ะ",
    "ja": "チームに入ったとき、予定は混乱していて、誰が鍵を持っているか分かりませんでした。全員に何が必要かを聞き、それから一緒に表を作りました。3週間ほどかかりましたが、最後にはお客様に喜んでもらえました。",
}
ENTRIES = {
    "en": ["clear goals", "the morning shift at the desk", "speaking slowly", "a box of spare parts", "patient", "the garden behind the house", "budget", "writing short notes"],
    "de": ["klare Ziele", "die Frühschicht am Schalter", "langsam sprechen", "eine Kiste mit Teilen", "geduldig", "der Garten hinter dem Haus", "Budget", "kurze Notizen"],
    "es": ["metas claras", "el turno de mañana", "hablar despacio", "una caja de piezas", "paciente", "el jardín de la casa", "presupuesto", "notas breves"],
    "th": ["เป้าหมายชัดเจน", "กะเช้าที่โต๊ะ", "พูดช้าลง", "กล่องอะไหล่", "อดทน", "สวนหลังบ้าน", "งบประมาณ", "บันทึกสั้น"],
    "ja": ["明確な目標", "窓口の早番", "ゆっくり話す", "部品の箱", "忍耐", "家の裏の庭", "予算", "短い記録"],
}
COLUMNS = [["name", "from", "to", "state", "mark"], *[[["door", "lamp", "desk"][i % 3], f"{i + 0.25:.2f}", f"{i + 1.75:.2f}", ["open", "shut_off", "half_open"][i * 2 % 3], str(i % 5)] for i in range(1, 9)]]


def samples() -> list[tuple[str, str]]:
    """Kind and text of each sample."""
    rng, out = random.Random(5), []
    wrap = lambda t, n: "\n".join(t[i : i + n].strip() for i in range(0, len(t), n))
    for lang, text in PROSE.items():
        flat = text.lower().translate({ord(x): None for x in ".,?¿。、"})
        three = "\n".join("- " + e for e in ENTRIES[lang][:3])
        sentences = [s + "." for s in text.split(". ")] if lang not in ("th", "ja") else text.replace("。", "。 ").split(" ")
        out += [("prose", t) for t in (text, wrap(text, 64), text + "\n\n" + text, text + "\n\n" + three + "\n\n" + text, "\n".join("> " + s for s in sentences), "\n".join(f"{'AB'[i % 2]}: {s}" for i, s in enumerate(sentences)), "\n".join(f"[{i * 7}.5s] {s}" for i, s in enumerate(sentences)), " ".join([flat] * 2), "Notes\n\n" + text)]
        entries = ENTRIES[lang]
        for mark in ("- ", "• ", "→ ", "\t+ ", "[x] ", "#) ", "#. ", "a) ", ""):
            lines = [mark.replace("#", str(i + 1)) + e for i, e in enumerate(entries)]
            out += [("list", "\n".join(lines)), ("list", "Topics:\n" + "\n".join(lines)), ("list", "\n\n".join(lines))]
            if mark:
                out.append(("list", "\n".join(x + (f" ({entries[i - 1]})." if i % 2 else "") for i, x in enumerate(lines))))
                out.append(("list", "\n".join(mark.replace("#", str(i + 1)) + s for i, s in enumerate(sentences))))
        out += [("list", mark.join(entries * k)) for mark in ("; ", ", ", " · ", " / ", "、") for k in (1, 2)]
        broken = list(text)
        for share in (0.1, 0.2, 0.4):
            out.append(("junk", "".join("�" if rng.random() < share else x for x in text)))
        if not text.isascii():
            out.append(("junk", text.encode().decode("latin-1")))
        rng.shuffle(broken)
        if lang not in ("th", "ja"):
            out.append(("junk", " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 13))) for _ in range(60))))
            out.append(("junk", " ".join(text.replace(" ", ""))))
        else:
            out.append(("junk", " ".join(text.replace(" ", ""))))
            if lang == "th":  # in Japanese prose any order of kana and Han occurs
                out.append(("junk", "".join(broken)))
    for rows in (COLUMNS, COLUMNS[1:]):
        out += [("table", "\n".join(mark.join(r) for r in rows)) for mark in ("\t", ";", ",", ", ", " | ")]
        out += [("table", "\n".join("| " + " | ".join(r) + " |" for r in rows)), ("table", "\n".join("".join(x.ljust(14) for x in r) for r in rows))]
    out += [("prose", PROSE[a] + gap + PROSE[b]) for a in PROSE for b in PROSE if a != b for gap in ("\n\n", " ")]
    noisy = lambda t: "".join(rng.choice("@!^~]§¬410") if rng.random() < 0.15 else x for x in t)
    out += [("junk", noisy(" ".join(PROSE[a]))) for a in ("en", "de", "es")]
    rows = COLUMNS[1:]
    out.append(("table", "| " + " | ".join(COLUMNS[0]) + " |\n|---|---|---|---|---|\n" + "\n".join("| " + " | ".join(r) + " |" for r in rows)))
    out.append(("table", "\n".join("{" + ", ".join(f'"{k}": ' + (v if v[0].isdigit() else f'"{v}"') for k, v in zip(COLUMNS[0], r)) + "}" for r in rows)))
    out += [("table", "\n".join(f"set.{r[0]}_{i}{mark}{r[1]}" for i, r in enumerate(rows))) for mark in (" = ", "=", ": ")]
    out.append(("table", "\n".join(f"E{i} {r[0]} {r[3]} {r[1]}-{r[2]}s share 0.{i}2" for i, r in enumerate(rows))))
    out.append(("table", "\n".join(f"{'Dr. Anna Berg'.ljust(24)}{i}       {i + 2}       {i * 3}     {r[1]}" for i, r in enumerate(rows))))
    code = [f"{rng.randrange(256):02x}" for _ in range(128)]
    out.append(("junk", "\n".join(f"{i:08x}: " + " ".join(code[i : i + 16]) for i in range(0, 128, 16))))
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/"
    for n in (76, 400):
        out.append(("junk", "\n".join("".join(rng.choice(alphabet) for _ in range(n)) for _ in range(400 // n))))
    out.append(("junk", "".join(f'<{t} class="{c}" id=x{i}></{t}>' for i, (t, c) in enumerate(zip(["div", "li", "span"] * 6, ["nav", "c-1"] * 9)))))
    out += [("junk", w * 60) for w in ("ok\n", "ok ", "ok", "... ", "ha", "ha ", "um ", "um um\n", "- - ", "test ", "test", "la\n")]
    out += [("junk", "".join(rng.choice("!?#$%&*+-=@^_~|<>{}[];:,.") for _ in range(200))), ("junk", " ".join("".join(rng.choice("!?#$%&*+-=@^_~") for _ in range(4)) for _ in range(40)))]
    return out


NEAR = 0.03  # samples of a kind this close make one profile
WEIGHTS = (1.0, 1.0, 1.5, 0.7, 3.0, 1.0)  # of the views and of the letters


@cache
def neighbour_profiles() -> tuple[np.ndarray, np.ndarray]:
    """Shares of neighbouring kinds of characters in Thai and Japanese prose, and in Thai prose shaken."""
    rng, texts = random.Random(6), [PROSE["th"], PROSE["ja"]]
    c = Counts([*texts, *("".join(rng.sample([x for x in t if not x.isspace()] * 8, 8 * len("".join(t.split())))) for t in texts[:1])])
    p = _shares(c.neighbours)
    return p[:2], p[2:]


@cache
def profiles() -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Views of the samples, without those that are close to an earlier one of their kind; kinds; whether their letters are those of no language."""
    got = samples()
    c = Counts([t for _, t in got])
    kinds = np.array([KINDS.index(k) for k, _ in got])
    far, even = c.strangeness()
    strange = (kinds == 3) & (far > even)
    views, kept = c.views(), []
    for i in range(len(got)):
        d = sum(w * divergence(v[kept], v[i]) for w, v in zip(WEIGHTS, views))
        if not np.any((d < NEAR) & (kinds[kept] == kinds[i]) & (strange[kept] == strange[i])):
            kept.append(i)
    return [v[kept].astype(np.float32) for v in views], kinds[kept], strange[kept]


def _from_profiles(v: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Divergence of every row of v from every row of p."""
    out = np.zeros((len(v), len(p)), np.float32)
    for x, y in zip(v.T.astype(np.float32), p.T):
        m = (x[:, None] + y[None, :]) / 2
        out -= m * np.log2(m + np.float32(1e-30))
    return out - (_entropy(v)[:, None] + _entropy(p)[None, :]) / 2


def distances(c: Counts) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: divergence from the nearest profile of each kind, and of its letters from the nearest language."""
    views, kinds, strange = profiles()
    far, even = c.strangeness()
    d = sum(w * _from_profiles(v, p) for w, v, p in zip(WEIGHTS, c.views(), views))
    d = d + WEIGHTS[-1] * np.where(strange[None, :], even[:, None], far[:, None])
    return np.stack([d[:, kinds == k].min(1) for k in range(4)], 1), far


FIELDS_OUT = "n_words int, mean_word_length double, symbol_ratio double, stopped_lines double, common_words double, n_lines int, n_chars int, letter_divergence double, word_divergence double, from_prose double, from_list double, from_table double, from_junk double, kind string"


def describe(texts: list[str]) -> pd.DataFrame:
    """The statistics of texts, in the columns of FIELDS_OUT."""
    c = Counts(texts)
    near, far = distances(c)
    views, kinds, _ = profiles()
    symbols = c.chars[:, [FIELD, BULLET, ANGLE, SYMBOL, BROKEN]].sum(1)
    words = np.maximum(c.words[:, :9].sum(1), 1e-9)
    return pd.DataFrame({
        "n_words": c.n_words.astype(np.int32), "mean_word_length": np.round(c.letters / np.maximum(c.n_words, 1), 4), "symbol_ratio": np.round(symbols / np.maximum(c.ink, 1), 4), "stopped_lines": np.round(c.stopped / np.maximum(c.n_lines, 1), 4),
        "common_words": np.round(c.words[:, :6].sum(1) / words, 4), "n_lines": c.n_lines.astype(np.int32), "n_chars": c.size.astype(np.int32), "letter_divergence": np.round(far, 4),
        "word_divergence": np.round(_from_profiles(c.views()[1], views[1][kinds == 0]).min(1).astype(float), 4), **{f"from_{k}": np.round(near[:, i].astype(float), 4) for i, k in enumerate(KINDS)}, "kind": np.array(KINDS, object)[near.argmin(1)],
    })


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics of every document and the structural profile that is nearest to it.

    Returns ``doc_id`` and: words (of scripts with spaces), mean word length, symbols a visible
    character, share of lines that end in a stop, share of common words, lines, characters,
    Jensen-Shannon divergence of the letters and of the classes of function words from the nearest
    language's prose, that of the whole from the nearest profile of each kind, and ``kind``
    (prose, list, table, junk) of the nearest one.

    Every text is counted into distributions: characters by class, words by class (articles,
    prepositions, conjunctions, pronouns, auxiliaries, particles, others), characters by the kind of
    line they stand in, words used before, broken characters, letters. The profiles are counted in
    the same way from samples of each kind, in five languages and many layouts; the divergences from
    a profile are weighed and summed, and the nearest profile gives the kind.

    Null texts and texts of blanks have no row; whole texts count, whatever their length; repeated
    rows are each described; ties go to the first kind; other columns are ignored. One scan without
    a shuffle.
    """
    kind = dict(docs.dtypes)[doc_id]

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pdf = pdf[pdf["t"].str.strip() != ""]
            size = np.cumsum(pdf["t"].str.len().to_numpy()) // 500_000  # texts counted at once
            for _, part in pdf.groupby(size, sort=False):
                got = describe(part["t"].tolist())
                got.insert(0, doc_id, part["i"].to_numpy())
                yield got

    rows = docs.selectExpr(f"`{doc_id}` AS i", f"`{text}` AS t").where("t is not null and i is not null")
    return rows.mapInPandas(scan, f"`{doc_id}` {kind}, {FIELDS_OUT}")
