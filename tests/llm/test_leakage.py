import random

from gleanstone.llm.leakage import Index, leaks, squeeze

WORDS = "alpha river seven candle window garden paper mountain silver engine market yellow forest bridge signal winter copper button ladder ocean pocket thunder velvet harbor meadow".split()


def make(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 9)) * (rng.random() < 0.1) for _ in range(n))


def test_planted_leaks_and_decoys(spark):
    rng = random.Random(2)
    items = {i: make(rng, 60) for i in range(40)}
    docs, want = [], set()
    for d in range(300):
        body, i = make(rng, 80), rng.randrange(40)
        w = items[i].split()
        kind = d % 6
        if kind == 0:  # whole, other case and punctuation, time marks between the words
            body += "\n" + "".join(x.upper() + (", " if k % 3 else f"\n[{k}.5s] ") for k, x in enumerate(w)) + make(rng, 50)
        elif kind == 1:  # two thirds, every ninth word changed
            body += " " + " ".join("other" if k % 9 == 4 else x for k, x in enumerate(w[10:50]))
        elif kind == 2:  # too short a quotation
            body += " " + " ".join(w[5:20]) + " " + make(rng, 40)
        elif kind == 3:  # the item's words in another order
            body += " " + " ".join(rng.sample(w, len(w)))
        if kind < 2:
            want.add((d, i))
        docs.append((d, body))
    docs += [(900, None), (901, ""), (902, items[0]), (902, items[0])]
    want.add((902, 0))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS item_id", "0.5 AS share")
    it = spark.createDataFrame([*items.items(), (99, None), (98, ""), (97, "ab"), (0, items[0])], "item_id bigint, text string")
    got = leaks(df, it).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    assert leaks(df.limit(0), it).count() == 0 and leaks(df, it.limit(0)).count() == 0


def test_many_blocks_and_equal_items(spark):
    rng = random.Random(4)
    items = {i: make(rng, 50) for i in range(12)} | {20: None, 21: None}
    items[20] = items[21] = items[3]
    it = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    docs = spark.createDataFrame([(i, make(rng, 30) + " " + t) for i, t in items.items()], "doc_id bigint, text string")
    want = {(i, i) for i in items} | {(a, b) for a in (3, 20, 21) for b in (3, 20, 21)}
    assert {(r["doc_id"], r["item_id"]) for r in leaks(docs, it, block_chars=500).collect()} == want


def test_dense_scripts_and_long_texts(spark):
    ja = "旧市街の住宅窓口で薬局の助手をしていたとき、別拠点の見学の生徒と一緒に地下の来客の記録を整理しました。どうして別拠点の上司はタイル工場で五月の安全の確認表を整理したのでしょうか？"
    it = spark.createDataFrame([(1, ja)], "item_id bigint, text string")
    long = "次は確認します。" * 40_000
    docs = spark.createDataFrame([(1, long + ja[10:70] + long), (2, long), (3, ja[:20])], "doc_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in leaks(docs, it).collect()} == {(1, 1)}


def test_squeeze():
    s = "".join(map(chr, squeeze("A-b,\n[12.3s] c\\nD <b>e</b> \\u0e01 ß")))
    assert s == "abcdeกß"
    assert Index([1], [""], 0.4, 0.7).candidates([squeeze("abc")]) == []


def test_short_items_stand_whole(spark):
    it = spark.createDataFrame([(1, "Cabin!"), (2, "a b"), (3, "見学"), (4, "\U00030000\U00030001"), (5, "..."), (6, "one two three four five six seven")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "the old cabin, A-B"), (2, "cabins and abba"), (3, "学生の見学です"), (4, "x\U00030000\U00030001y"), (5, "..."), (6, "One, two\nthree four five SIX seven"), (7, "one two three four five six eight")], "doc_id bigint, text string")
    assert {(r["doc_id"], r["item_id"]) for r in leaks(docs, it).collect()} == {(1, 1), (1, 2), (3, 3), (4, 4), (6, 6)}


def test_the_lemma_holds(spark):
    """Changed words within the budget leave at least the asked q-grams."""
    from gleanstone.llm.leakage import grams, lemma, step

    rng = random.Random(7)
    for n in (60, 120, 300):
        text = squeeze("".join(rng.choice("abcdefghijklmnop") for _ in range(n)))
        for _ in range(50):
            other = text.copy()
            for _ in range(int(0.12 * n / 5)):
                a = rng.randrange(n - 5)
                other[a : a + 5] = ord("z")
            kept = sum(x in set(grams(other, 16)) for x in grams(text, 16)[rng.randrange(step(16)) :: step(16)])
            assert kept >= lemma(n, 16, 5, 0.12)


def test_marks_are_the_alternatives_spelled_out():
    import re

    from gleanstone.llm.leakage import MARKS

    plain = re.compile(r"\[\d+(?:[.:,]\d+)*\s?s?\]|\d\d?:\d\d:\d\d(?:[.,]\d+)?(?:\s*-->\s*\d\d?:\d\d:\d\d(?:[.,]\d+)?)?|\\[nrt\"]|<[^<>\n]{0,80}>|&[a-z]{2,6};|(?<=\w)-\n(?=\w)")
    rng, parts = random.Random(1), ["[", "1", "22", ":", ".", ",", " ", "s", "]", "\\", "n", '"', "<", "b", ">", "&", "amp", ";", "-", "\n", " --> ", "٣", "é", "12:34:56", "[1:2]"]
    for _ in range(20_000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert MARKS.sub(" ", s) == plain.sub(" ", s)


def test_in_order():
    import numpy as np

    from gleanstone.llm.leakage import in_order

    rng = np.random.default_rng(5)
    for top in (50, 1 << 40):  # fits side by side, and doesn't
        columns = [rng.integers(-top, top, 3000) for _ in range(4)]
        assert (in_order(*columns) == np.lexsort(columns)).all() or top == 50
        rows = np.stack(columns, 1)
        assert (rows[in_order(*columns)] == rows[np.lexsort(columns)]).all()


def test_alignment_against_every_cell():
    """The best local alignment's score and share, cell by cell; of equal scores the later start."""
    rng = random.Random(6)
    for _ in range(40):
        item = "".join(rng.choice("abcd") for _ in range(rng.randint(30, 60)))
        other = "".join(c * rng.choice((0, 1, 1, 1, 1, 1, 2)) if rng.random() > 0.1 else rng.choice("abcd") for c in item)
        ix = Index([1], [item], 0.4, 0.7)
        a, b = len(item), len(other)
        cell, best = [[(0.0, 0)] * (b + 1)], (0.0, 0, 0)
        for i in range(1, a + 1):
            row = [(0.0, i)]
            for j in range(1, b + 1):
                steps = [(cell[i - 1][j - 1], 1 if item[i - 1] == other[j - 1] else -1.5), (cell[i - 1][j], -1.5), (row[j - 1], -1.5)]
                row.append(max([(0.0, i)] + [(s + x, start) for (s, start), x in steps]))
            cell.append(row)
            top = max(row)
            if top[0] > best[0]:
                best = (top[0], top[1], i)
        (_, _, share, score), = ix._align([squeeze(other)], [(0, 0, 0, 0, a, 9)])
        span = best[2] - best[1]
        assert (share, score) == (span / a, best[0] / span)


def test_calls_of_an_alignment():
    """A letter of the alignment takes a few calls for all pairs together: over 20 before."""
    import cProfile
    import pstats

    rng = random.Random(8)
    items = [make(rng, 60) for _ in range(5)]
    ix, docs = Index(list(range(5)), items, 0.4, 0.7), [squeeze(t) for t in items]
    letters = max(len(d) for d in docs)
    with cProfile.Profile() as p:
        found = ix._align(docs, [(i, i, 0, 0, len(d), 9) for i, d in enumerate(docs)])
    assert [x[2:] for x in found] == [(1.0, 1.0)] * 5
    assert pstats.Stats(p).total_calls < 10 * letters
