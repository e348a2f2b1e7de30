from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from symloom.functions import parsers as ps


@given(st.text(alphabet="ab \né中", max_size=400), st.integers(1, 60), st.integers(0, 70))
@settings(max_examples=150, deadline=None)
def test_chunks_cover_the_text(text, target, overlap):
    rows = ps.split_text(text, target, overlap)
    raw = text.encode()
    for _, chunk, first, last in rows:
        b = chunk.encode()
        assert len(b) <= max(target, 4)
        k = raw.find(b)
        assert k >= 0 and 1 <= first <= last
    if overlap < target:  # every run of letters is met by some chunk, if in parts
        met = "".join(c for _, c, _, _ in rows)
        assert set(text) - set(met) <= set(" \n")
    assert ("".join(text.split()) == "") == (rows == [])


def test_chunk_ends_at_blank_lines():
    text = "a" * 40 + "\n\n" + "b" * 40 + "\n" + "c" * 40
    rows = ps.split_text(text, 60, 5)
    assert rows[0][1] == "a" * 40 + "\n\n" and rows[0][2:] == (1, 2)
    assert rows[-1][1].endswith("c" * 40) and rows[-1][3] == 4


def test_sections_and_slugs():
    text = "# A b!\n\ntext\n## C\n```\n# no\n```\n## C\nD\n===\nend"
    assert ps.sections(text) == [(0, 1, "A b!", "a-b", 1, 8, -1), (1, 2, "C", "c", 4, 7, 0), (2, 2, "C", "c-1", 8, 8, 0), (3, 1, "D", "d", 9, 11, -1)]


def test_front_matter():
    text = "---\ntitle: 'T'\naliases: [a, \"b\"]\nrelated:\n  - x.md\n  - y\nother: z\n---\nbody"
    assert ps.front_matter(text) == [("title", "T"), ("aliases", "a"), ("aliases", "b"), ("related", "x.md"), ("related", "y")]
    assert ps.front_matter("no") == []


def test_links():
    text = "[a](b.md#c) ![i](p.png)\n`[x](no)` [[T#s|l]] ![[E]]\n```\n[n](o)\n```\n[[bad](x)]]"
    assert ps.links(text)[:4] == [(1, "link", "b.md", "c", "a"), (1, "image", "p.png", "", "i"), (2, "wiki", "T", "s", "l"), (2, "embed", "E", "", "")]
    assert all(t != "o" and t != "no" for _, _, t, _, _ in ps.links(text))


def test_css():
    css = "/* .no {} */\n.a .b-c, #d { --x: 1; @extend .q; }\n.e { @extend .a; composes: f g from './h.css'; .n { @extend .z } }\n@media x { .a {} }"
    assert ps.css_atoms(css) == [("class", "a", 2), ("class", "b-c", 2), ("class", "e", 3), ("class", "n", 3), ("id", "d", 2), ("property", "--x", 2)]
    assert sorted(ps.css_extends(css)) == [("e", "composes", "f"), ("e", "composes", "g"), ("e", "extend", "a"), ("n", "extend", "z")]
    assert ps.css_imports("@use 'x'; @import url(\"y.css\"); @import 'https://z'; // @use 'n'") == [("use", "x"), ("import", "y.css")]


def test_class_tokens():
    assert ps.string_tokens("<a className=\"x y\"> f('z')")[:2] == [(1, "x", True), (1, "y", True)]
    assert ps.module_members("import s from './a.scss'; s.btnPrimary; s['x-y']") == [("s", "btnPrimary", "./a.scss"), ("s", "x-y", "./a.scss")]
    assert ps.member_spellings("btnPrimary") == ["btnPrimary", "btn-primary"]


def test_sql():
    sql = "WITH c AS (SELECT 1) SELECT * FROM c JOIN s.t x ON 1; insert into \"U\" values ('from n'); DROP INDEX i; DROP VIEW v; select 1; create or replace view w as select * from gen(2); select * from {p}; ALTER TABLE a.b.d ADD e int"
    assert ps.sql_tables(sql) == [(0, "accesses", "s", "t"), (1, "accesses", "", "u"), (3, "alters", "", "v"), (5, "defines", "", "w"), (7, "alters", "a.b", "d")]
    assert ps.split_statements("a; 'b;c' -- d;\n; /* ; */") == ["a", "'b;c'"]


def test_html_and_xml():
    rows = ps.html_elements("<p id=a>x<br><b class='k l'>y</p><a href=u>")
    assert [(r[1], r[2], r[4], r[5], r[6]) for r in rows] == [(-1, "p", "a", None, None), (0, "br", None, None, None), (0, "b", None, "k l", None), (-1, "a", None, None, "u")]
    assert ps.html_elements("") == []
    assert [r[0] for r in ps.xml_elements("<a><b name='n'/><c/><c>t</c></a>")] == ["a", "a/b[n]", "a/c:1", "a/c:2"]
    assert ps.xml_elements("<a") == []


def test_literals():
    assert ps.literals('x("a\\"b") // "c"\n r#"d"e"#', "rust") == [(1, 'a\\"b'), (2, 'd"e')]
    assert ps.literals("f('a', `b\nc`) /* 'd' */", "typescript") == [(1, "a"), (1, "b\nc")]
    assert ps.literals('@"a""b" $"c"', "csharp") == [(1, 'a""b'), (1, "c")]
    assert ps.literals('"x"', "go") == []
