"""Wu-Manber search against a brute-force word alignment."""

from __future__ import annotations

import random

from symloom.llm import leakage
from symloom.llm.words import words
from symloom.runtime import Scratch

SENTENCE = "Answer the question below."


def brute(item: list[bytes], text: list[bytes]) -> bool:
    """Some window of 20 item words of which 18 stand in order in some 30 words of the text."""

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    return any(
        lcs(item[p : p + 20], text[q : q + 30]) >= 18
        for p in range(len(item) - 19)
        for q in range(-10, len(text) - 10)
        for q in [max(0, q)]
    )


def make(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def test_matches_brute_force():
    rng = random.Random(3)
    items = {i: make(rng, 45) for i in range(4)}
    searcher = leakage.Searcher({i: words(" ".join(w)) for i, w in items.items()})
    for trial in range(60):
        text = make(rng, 60)
        if trial % 2:
            w = items[trial % 4][10 : 10 + rng.randrange(14, 34)]
            w = [("x" if rng.random() < 0.06 else t) for t in w if rng.random() > 0.04]
            text[20:20] = w
        ids = words(" ".join(text))
        want = sorted(i for i in items if brute(words(" ".join(items[i])), ids))
        got = sorted(searcher.leaks(" ".join(text)))
        # the brute force has no notion of a diagonal, so it may find a little more, never less
        assert set(got) <= set(want)
        assert len(want) - len(got) <= 1


def test_disguises_are_undone():
    rng = random.Random(5)
    w = make(rng, 40)
    searcher = leakage.Searcher({1: words(" ".join(w))})
    plain = " ".join(w[5:30])
    for text in (
        plain.upper(), "<p>" + plain.replace(" ", "</b> ") + "</p>", plain.replace(" ", "\n"), plain.replace(" ", " *"), plain.replace("w1", "w\u00ad1"),
        plain.replace("w", "\uff57"), plain.replace(" ", "\u00a0"), ", ".join(w[5:30]), "\ufeff" + plain.replace(" ", "\r\n"),
    ):
        assert searcher.leaks(text) == [1], text


def test_short_passages_and_instructions_do_not_count(spark):
    rng = random.Random(6)
    bodies = [make(rng, 40) for _ in range(3)]
    long_intro = "Please read the following passage of the workspace with care and then choose the one answer that fits it best of all the given."
    rows = [(i, "s", f"{long_intro} {' '.join(b)}") for i, b in enumerate(bodies)] + [(9, "t", " ".join(bodies[0])), (None, "s", "x"), (11, "s", " "), (12, None, None)]
    listed = leakage.item_words(spark.createDataFrame(rows, "item_id long, suite string, text string")).collect()
    items = {r.item_id: bytes(r.words).split() for r in listed}
    assert set(items) == {0, 1, 2, 9} and all(r.n == len(items[r.item_id]) for r in listed)
    assert items[0] == words(" ".join(bodies[0]))
    searcher = leakage.Searcher(items)
    assert searcher.leaks(long_intro) == []
    assert searcher.leaks(" ".join(bodies[1][:15])) == []
    assert sorted(searcher.leaks(" ".join(bodies[0]))) == [0, 9]


def test_rows(spark):
    rng = random.Random(8)
    w = make(rng, 60)
    docs = spark.createDataFrame(
        [(20, " ".join(w[:30]), 1), (40, None, 1), (60, "", 1), (None, " ".join(w), 1), (80, " ".join(make(rng, 5000) + w), 2), (20, " ".join(w[:30]), 3)],
        "doc_id long, text string, item_id int",
    )
    items = spark.createDataFrame([(7, "s", " ".join(w), "x"), (7, "s", " ".join(w), "y"), (8, None, None, "z")], "item_id long, suite string, text string, doc_id string")
    assert sorted(map(tuple, leakage.leaked_items(docs, items, Scratch(spark, "t")).collect())) == [(20, 7), (80, 7)]
    assert leakage.leaked_items(docs, items.where("false"), Scratch(spark, "t")).count() == 0
    assert leakage.leaked_items(docs.where("false"), items, Scratch(spark, "t")).count() == 0
    leakage.BLOCK_WORDS, was = 50, leakage.BLOCK_WORDS
    try:
        more = items.unionByName(spark.createDataFrame([(5, "q", " ".join(w[20:]), "x")], items.schema))
        assert sorted(map(tuple, leakage.leaked_items(docs, more, Scratch(spark, "t")).collect())) == [(20, 7), (80, 5), (80, 7)]
    finally:
        leakage.BLOCK_WORDS = was


def brute_any_length(item: list[bytes], text: list[bytes]) -> bool:
    """Some n >= 20 running item words of which all but n // 8 stand in order in n + n // 4 words of the text."""
    for p in range(len(item) - 19):
        for q in range(len(text)):
            if text[q] not in item[p : p + 1 + (len(item) - p) // 8]:  # the text may begin with a word that is there
                continue
            row = [0] * (len(text) - q + 1)
            for n, x in enumerate(item[p:], 1):
                new = [0]
                for j, y in enumerate(text[q:]):
                    new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
                row = new
                if n >= 20 and row[min(n + n // 4, len(row) - 1)] >= n - n // 8:
                    return True
    return False


def test_equals_brute_force_over_all_lengths():
    rng = random.Random(11)
    items = {i: make(rng, 60) for i in range(3)}
    searcher = leakage.Searcher({i: words(" ".join(w)) for i, w in items.items()})
    found = 0
    for trial in range(24):
        text = make(rng, 40)
        n = rng.randrange(18, 46)
        at = rng.randrange(61 - n)
        w = items[trial % 3][at : at + n]
        for x in rng.sample(range(n), n // 8 + rng.choice((0, 0, 1))):
            w[x] = rng.choice(("x", None))
        text[20:20] = [t for t in w if t]
        ids = words(" ".join(text))
        want = sorted(i for i in items if brute_any_length(words(" ".join(items[i])), ids))
        assert sorted(searcher.leaks(" ".join(text))) == want, (trial, n)
        found += len(want)
    assert 12 <= found < 24


def test_passages_that_no_window_of_20_words_holds():
    w = [f"w{i}" for i in range(60)]
    searcher = leakage.Searcher({1: words(" ".join(w))})

    def text(lo: int, hi: int, changed: tuple[int, ...]) -> str:
        return " ".join("x" if i in changed else w[i] for i in range(lo, hi))

    for n in range(24, 32):  # three changes, none of the windows of 20 words with fewer
        assert searcher.leaks(text(10, 10 + n, (10 + n // 2 - 4, 10 + n // 2, 10 + n // 2 + 4))) == [1], n
    assert searcher.leaks(text(10, 33, (16, 21, 26))) == []
    # the passage 8 to 27 begins behind runs of a stretch that is too much changed
    assert searcher.leaks(text(0, 28, (5, 6, 7, 20, 25))) == [1]


def test_recall_at_one_word_in_eight():
    rng = random.Random(21)
    items = {i: make(rng, 90, 4_000) for i in range(40)}
    searcher = leakage.Searcher({i: words(" ".join(w)) for i, w in items.items()})
    for n in range(20, 49, 2):
        found = 0
        for trial in range(40):
            at = rng.randrange(91 - n)
            w = items[trial][at : at + n]
            for x in rng.sample(range(n), n // 8):
                w[x] = rng.choice((f"y{x}", None))
            found += trial in searcher.leaks(" ".join(make(rng, 50, 4_000) + [t for t in w if t] + make(rng, 50, 4_000)))
        assert found >= 38, (n, found)


def test_long_tags_interrupt_no_passage():
    w = [f"w{i}" for i in range(40)]
    searcher = leakage.Searcher({1: words(" ".join(w))})
    tag = '<span class="' + "a b " * 200 + '" title="x > y">'
    assert searcher.leaks(" ".join(w[:12]) + tag + " ".join(w[12:24])) == [1]
    assert words("if a < b and c > d") == [b"if", b"a", b"b", b"and", b"c", b"d"]
