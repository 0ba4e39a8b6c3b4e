"""Defects of prompt and response pairs: empty, refusal, copy, language, truncated."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

# Fixed values of the English language and of common answer formats.
NOTHING = {"", "none", "null", "na", "nil", "nan", "empty", "tbd", "todo", "placeholder", "undefined", "notext", "noanswer", "notavailable", "notapplicable"}
HANGING = set(
    "a an the this that these those my our your his her its their of to in on at by for with from into about over under between through during before after without within as than and or but nor so because since although while "
    "if when where which who whom whose whether that i we you he she they it is are was were be been am has have had do does did will would can could should may might must not no very more most some any each every then".split()
)
PROFILES = {
    "en": set("the and of to a in for with that was were is are it i we you my our your not but so as at by from on or if had have has which who what when how would should said there an than before after because".split()),
    "de": set("und der die das dem den ein eine einer ich wir sie er es mit von zu bei für auf nicht aber habe haben hat wurde war ist im am aus noch wie wer warum als".split()),
    "es": set("de la el que los las con y en una un del por para se lo al como más pero mi yo nuestro porque fue sin su primero entre según desde cuando así".split()),
    "fr": set("le la les et de des un une est dans pour que qui je nous vous avec pas sur au du".split()),
}
OPENERS = {"(": ")", "[": "]", "{": "}", "“": "”", "„": "“", "«": "»", "「": "」", "『": "』", "（": "）"}
BRACKETED = re.compile(r"\[[^\[\]]*\]")
QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|„[^“]*“|«[^»]*»|'[^']{3,}'(?!\w)")
TERMINAL = re.compile(r"[.!?…。！？][\"'”»“)\]』」*_]*$")
WORDS = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
PLACEHOLDER = re.compile(r"\s*\[[^\[\]]*\]$")
JOINING = re.compile(r"[,;:\-–—(/&+=\"“„«]$")
CLOSED = re.compile(r"[\"”»)\]]$")
LATIN, OTHER, DENSE = re.compile(r"[^A-Za-zÀ-ɏ]+"), re.compile(r"[^\W\d_A-Za-zÀ-ɏ]|[ัิ-ฺ็-๎]"), re.compile(r"[぀-ヿ㐀-鿿]")
PRIME = (1 << 61) - 1
INVISIBLE = re.compile(r"[​‌‍﻿­]")

# Refusal grammar. Words are read as classes; what no class holds is "x".
LEXICON = {
    "A": "i we",  # who speaks
    "M": "can will may must should would do am are is was be been have has feel",  # present and future auxiliaries
    "N": "not no never",
    "B": "able allowed permitted willing comfortable authorised authorized position going told",  # what one is or isn't
    "D": "decline declined refuse refused reject rejected denied unable turn",  # declining by one word
    "P": "rather prefer",
    "T": "rewrite assess judge comment coach fill produce suggest say go answer help provide continue assist respond write give evaluate rate review improve complete create generate discuss offer process take",  # what is asked for
    "O": "request task question this that it service coaching feedback answer advice assessment rewrite comment help suggestion suggestions recommendation something thing anything",  # what is declined
    "V": "available possible provided offered given answered fulfilled processed",
    "G": "guideline guidelines rule rules policy policies instructions principles",
    "F": "forbid prohibit prevent exclude disallow out",
    "R": "right appropriate proper fair",
    "W": "wrong inappropriate",
    "U": "outside beyond",
    "K": "ask contact",
    "H": "human person",
    "t": "to",
    "a": "what",
}
CLASS = {}
for _k, _words in LEXICON.items():
    for _w in _words.split():
        CLASS[_w] = CLASS.get(_w, "") + _k
SHORT = {"can't": "can not", "cannot": "can not", "won't": "will not", "don't": "do not", "isn't": "is not", "aren't": "are not", "mustn't": "must not", "shouldn't": "should not", "wouldn't": "would not", "i'm": "i am", "i'd": "i would", "i've": "i have", "i'll": "i will", "we're": "we are", "we'd": "we would", "we've": "we have", "we'll": "we will", "it's": "it is", "that's": "that is"}


def _any(classes: str) -> str:
    """A word of one of the classes; a word is written as its classes and a blank."""
    return rf"(?:[A-Za-z]*[{classes}][A-Za-z]* )"


_X = r"(?:[A-Za-z]+ )"
# SENTENCE -> DENIAL | DECLINING | PASSIVE | NOTHING | RULED | IMPROPER | OUTSIDE | REFERRAL
GRAMMAR = {
    "denial": _any("A") + _any("M") + _X + "{0,2}" + _any("N") + _X + "{0,6}" + _any("T"),  # I can not (be able to) rewrite
    "declining": _any("A") + _any("Mt") + "{0,3}(?:" + _any("D") + "|" + _any("P") + _any("N") + "|" + _any("N") + _any("P") + ")",  # I (must) decline
    "passive": _any("O") + _X + "{0,8}" + _any("M") + "{1,2}(?:" + _any("D") + "|" + _any("N") + _any("MB") + "{0,1}" + _any("V") + ")",  # the request is declined, can not be answered
    "nothing": _any("N") + _any("O") + _any("M"),  # no feedback will be given
    "ruled": _any("G") + _X + "{0,2}(?:" + _any("F") + "|" + _any("M") + _any("N") + _any("B") + "{0,1})",  # guidelines rule out
    "improper": _any("M") + "(?:" + _any("N") + _any("M") + "{0,1}" + _any("R") + "|" + _any("W") + ")" + _X + "{0,3}" + _any("t"),  # it would not be right to
    "outside": "(?:" + _any("U") + _X + "{0,2}" + _any("a") + "|" + _any("N") + _X + "{0,2}" + _any("O") + ")" + _any("A") + _any("M"),  # outside of what I do, not a task I will take on
    "referral": _any("K") + _X + "{0,3}" + _any("H"),  # ask a human
}
REFUSAL = re.compile("|".join(GRAMMAR.values()))
HINT = re.compile(r"\b(?:not|no|never|cannot|\w+n't|declin\w*|refus\w*|reject\w*|denied|unable|turn|rather|prefer|forbid|prohibit|prevent|exclude|disallow|out|wrong|inappropriate|outside|beyond|ask|contact)\b")


def visible(text: str | None) -> str:
    return INVISIBLE.sub("", text or "").replace(" ", " ").strip()


def says_nothing(text: str | None) -> bool:
    """Null, blank, marks only, a word for nothing, or only a bracketed placeholder."""
    body = BRACKETED.sub("", visible(text))
    return "".join(WORDS.findall(body)).lower() in NOTHING


def refusing(clause: str) -> bool:
    """Whether a sentence in lower case is one of the refusal grammar."""
    if not HINT.search(clause):
        return False
    words = " ".join(SHORT.get(w, w) for w in WORDS.findall(clause)).split()
    return bool(REFUSAL.search("".join(CLASS.get(w, "x") + " " for w in words)))


def refuses(text: str) -> bool:
    """Whether a text declines the task: one of its first two sentences is a refusal, and refusals with what leads up to them make up most of it.

    Quotations and bracketed placeholders don't count.
    """
    body = QUOTED.sub(" ", BRACKETED.sub(" ", visible(text))).replace("’", "'").lower()
    parts = [p for p in re.split(r"(?<=[.!?;])\s+", body.strip()) if p]
    if not any(map(refusing, parts[:2])):
        return False
    sizes = [(len(p), refusing(p)) for p in parts]
    return sum(n for n, h in sizes if not h) <= max(90, sum(n for n, h in sizes if h))


def tiles(a: list[str], b: list[str], least: int = 2) -> int:
    """Greedy string tiling: words of ``a`` covered by disjoint common stretches of ``least`` words or more, long ones first.

    Stretches of one length are found by running Karp-Rabin hashes; the length is halved from round to round.
    """
    free_a, free_b = [True] * len(a), [True] * len(b)
    number = {w: k for k, w in enumerate(dict.fromkeys([*a, *b]), 1)}

    def windows(words: list[str], free: list[bool], size: int) -> Iterator[tuple[int, int]]:
        """(hash, place) of each stretch of free words."""
        h, run, top = 0, 0, pow(1_000_003, size, PRIME)
        for i, w in enumerate(words):
            if not free[i]:
                h, run = 0, 0
                continue
            h, run = (h * 1_000_003 + number[w]) % PRIME, run + 1
            if run > size:
                h = (h - number[words[i - size]] * top) % PRIME
            if run >= size:
                yield h, i - size + 1

    covered, size = 0, max(least, min(len(a), len(b)))
    while True:
        places: dict[int, list[int]] = {}
        for h, j in windows(b, free_b, size):
            places.setdefault(h, []).append(j)
        found = []
        for h, i in windows(a, free_a, size):
            for j in places.get(h, ()):
                k = 0
                while i + k < len(a) and j + k < len(b) and free_a[i + k] and free_b[j + k] and a[i + k] == b[j + k]:
                    k += 1
                if k >= size:
                    found.append((-k, i, j))
        for k, i, j in sorted(found):
            n = 0
            while n < -k and free_a[i + n] and free_b[j + n]:
                n += 1
            if n >= size:
                free_a[i : i + n] = free_b[j : j + n] = [False] * n
                covered += n
        if size == least:
            return covered
        size = max(least, size // 2)


def copies(text: str, question: str) -> bool:
    """Whether a text only gives back the question, also slightly changed or repeated."""
    q = [w.lower() for w in WORDS.findall(question)]
    t = [w.lower() for w in WORDS.findall(BRACKETED.sub(" ", visible(text)))]
    t = [w for i, w in enumerate(t) if not i or w != t[i - 1]]
    if len(q) < 3 or not 0.5 * len(q) <= len(t) <= 3.2 * len(q) + 4:
        return False
    again = q * max(1, round(len(t) / len(q)))
    enough = max(len(t) - max(3, 0.2 * len(t)), 0.65 * len(q))
    if (Counter(t) & Counter(again)).total() < enough:  # no tiling covers more than the common words
        return False
    return tiles(t, again) >= enough


def question_of(prompt: str | None) -> str:
    """The question in a prompt: the line behind or below a heading that names it, else the first line that asks."""
    lines = [x.strip() for x in (prompt or "").split("\n")]
    for k, x in enumerate(lines):
        m = re.match(r"^[#*\s\[<(]*(?:the )?(?:interview |interviewer'?s? )?(?:question|q|prompt|asked|interviewer)\b\s*(?:\d+)?[\]>)*]*\s*[:\-–]?\s*(.*)$", x, re.I)
        if m:
            rest = re.sub(r"[*\]>#]+$", "", m[1]).strip()
            if len(rest) > 8:
                return rest
            if not rest:
                return next((y for y in lines[k + 1 :] if y), "")
    return next((x for x in lines if x.endswith("?")), lines[0] if lines else "")


def english_share(text: str) -> tuple[float, float]:
    """Letters of a text that are not English, and all its letters, bracketed placeholders left out."""
    body = BRACKETED.sub(" ", visible(text)).partition("[")[0] if "[" in text else visible(text)
    words = WORDS.findall(body.lower())
    latin = len(LATIN.sub("", body))
    # letters of denser scripts stand for more text
    other = 0 if body.isascii() else len(OTHER.findall(body)) + len(DENSE.findall(body))
    hits = {k: sum(map(p.__contains__, words)) for k, p in PROFILES.items()}
    best = max(hits, key=lambda k: (hits[k], k == "en"))
    foreign = latin if best != "en" and hits[best] >= 2 and hits[best] > 1.3 * hits["en"] else 0
    return float(other + foreign), float(latin + other)


def foreign(texts: list[str]) -> bool:
    pairs = [english_share(t) for t in texts]
    total = sum(p[1] for p in pairs)
    return total > 0 and sum(p[0] for p in pairs) > 0.5 * total


MARKS = re.compile(r"(?P<fence>```)|<(?P<close>/?)(?P<tag>[a-zA-Z]\w*)[^<>]*?(?P<void>/?)>|(?P<item>(?:^|\n)[^\S\n]*(?:[-*•]|\d{1,2}[.)])(?=\s|$))|(?P<mark>[\"“”„«»「」『』()（）\[\]{}])|(?P<text>\w+)")
VOID = {"br", "hr", "img", "li", "p"}


def open_marks(text: str) -> list[str]:
    """What a pushdown parser finds still open at the end: fences, tags, quotations, brackets, entries of lists without text.

    A closing mark takes off the stack what was opened since its partner; one without a partner says nothing;
    inside a fence only its end counts.
    """
    stack: list[str] = []
    for m in MARKS.finditer(text):
        kind, c = m.lastgroup, m.group()
        if stack and stack[-1] == "item" and kind != "item":  # the entry has begun
            stack.pop()
        if kind == "text":
            continue
        if kind == "fence":
            stack = stack[: stack.index("```")] if "```" in stack else [*stack, "```"]
        elif "```" in stack:
            continue
        elif kind == "item":
            stack[:] = [x for x in stack if x != "item"] + ["item"]
        elif m["tag"]:
            name = "<" + m["tag"].lower()
            if m["close"]:
                if name in stack:
                    del stack[len(stack) - 1 - stack[::-1].index(name) :]
            elif not m["void"] and name[1:] not in VOID:
                stack.append(name)
        else:
            opened = [k for k, x in enumerate(stack) if x == c == '"' or OPENERS.get(x) == c]
            if opened:
                del stack[opened[-1] :]
            elif c == '"' or c in OPENERS:
                stack.append(c)
    return stack


def breaks_off(text: str) -> tuple[bool, str]:
    """Whether a text stops in the middle of a sentence, and else the last word where only its spelling can tell."""
    body = visible(text)
    while m := PLACEHOLDER.search(body):
        body = body[: m.start()]
    if not body:
        return False, ""
    left = open_marks(body)
    if "```" in left or "item" in left or "[" in left:
        return True, ""
    if TERMINAL.search(body):
        return False, ""
    if JOINING.search(body) and not (body[-1] == '"' and '"' not in left) or left:
        return True, ""
    words = WORDS.findall(body[-200:])
    if not words or CLOSED.search(body):
        return False, ""
    last = words[-1]
    if last.lower() in HANGING:
        return True, ""
    return False, "" if last[0].isdigit() else last.lower()


def judge(question: str, items: list[list[str | None]]) -> tuple[str | None, list[str]]:
    """The defect of a field, whose items each hold some texts; and last words left to a vocabulary."""
    texts = [t for item in items for t in item]
    said = [t for t in texts if t is not None and not says_nothing(t)]
    if not said:
        return "empty", []
    if any(refuses(t) for t in said):
        return "refusal", []
    if question and any(copies(t, question) for t in said):
        return "copy", []
    spoken = [[t for t in item if t is not None and not says_nothing(t)] for item in items]
    if any(foreign(item) for item in spoken if item):
        return "language", []
    found = [breaks_off(t) for t in said]
    if any(f for f, _ in found):
        return "truncated", []
    return None, [w for _, w in found if w]
