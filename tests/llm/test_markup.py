from __future__ import annotations

import pytest

from symloom.llm import markup
from symloom.llm.labelled_pages import pages


@pytest.fixture(scope="module")
def field():
    return markup.trained()


def test_held_out_pages(field):
    good = total = right = 0
    held_out = pages(4242, 200)
    for text, marks in held_out:
        blocks = markup.segment(text)
        want = [markup.label_at(marks, b.start) for b in blocks]
        got = [markup.LABELS[k] for k in field.decode(markup.features(blocks))]
        good += sum(a == b for a, b in zip(want, got))
        total += len(want)
        right += any(a != "plain" for a in want) == any(b != "plain" for b in got)
    assert good / total > 0.97 and right / len(held_out) > 0.97


@pytest.mark.parametrize(
    "text",
    ["Use <code>x</code> first.", "</div>", "a &lt; b", "&amp;lt;p&amp;gt; stays", "# Title\n\nText here.", "- one thing\n- two things", "See [this](a.md).", "Runs in $O(n \\log n)$ steps.",
     "\\item The one.", "''Lean'' text.", "== Part ==\nMore.", "[[Page|text]] is there.", "```\nx = 1\n```", "| a | b |\n|---|---|\n| 1 | 2 |", "<inheritdoc/>", "/// <summary>Text.</summary>", "/**\n * Uses `x` once.\n */"],
)
def test_markup_is_found(field, text):
    assert markup.holds_markup(text, field)


@pytest.mark.parametrize(
    "text",
    [None, "", "  \n ", "Plain words only.", "/**\n * Reads the file.\n * Then closes it.\n */", "/// Reads the file.", "@param x the value", ":param x: the value", "{@inheritDoc}", "------------", "////// part //////",
     "Gives Vec<Option<Row>> in order.", "Holds when a < b && b > c for all.", "Matches *.rs but not **/tests/* in it.", "Takes **kwargs and *args.", "Costs 5 $ or 6 $ a day.", "Reads $HOME and $TMPDIR before C:\\temp\\x.",
     "arr[i][j] holds it, table[kind](args) too.", "# noqa", "Skips __init__ and _private_name.", "Prints {0} and {1} in it."],
)
def test_plain_text_is_left(field, text):
    assert not markup.holds_markup(text, field)


def test_clean_keeps_structure(field):
    text = "# Title\n\nSome *bold* text with [a link](x.md) and $x_{1}$.\n\n- first `item`\n- second\n\n```\ncode *stays*\n```\n<p>End &amp; done.</p>"
    out = markup.clean(text, field)
    assert out.split("\n") == ["# Title", "Some bold text with a link and $x_{1}$.", "- first item", "- second", "```", "code *stays*", "```", "End & done."]


def test_rows(spark, field):
    df = spark.createDataFrame([("symbol_docs", 1, "<p>x", "a"), ("symbol_docs", 1, "<p>x", "b"), ("file_docs", 1, None, "c"), ("file_docs", 2, "y " * 50_000, "d")], "tab string, key_id long, doc string, markup string")
    got = markup.marked(df, field).collect()
    assert sorted((r.tab, r.key_id, r.markup) for r in got) == [("file_docs", 1, False), ("file_docs", 2, False), ("symbol_docs", 1, True), ("symbol_docs", 1, True)]
    assert markup.marked(df.where("false"), field).count() == 0
    assert [r.text for r in markup.cleaned(df.where("doc is null"), field).collect()] == [None]
