"""Small parsers of text formats, one text at a time; they run inside Arrow batches (see :func:`flat_map`)."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from itertools import accumulate
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from symloom.runtime import spread


def flat_map(df: DataFrame, fn: Callable[..., list[tuple]], schema: str) -> DataFrame:
    """Rows of ``fn(*row)`` for every row of ``df``; null texts give none. The first column is passed on as the key."""
    kind = StructType.fromDDL(schema)
    names = kind.fieldNames()
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(r[0], *out) for r in zip(*(c.to_pylist() for c in b.columns)) if r[1] is not None for out in fn(*r[1:])]
            cols = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], names)

    return spread(df).mapInArrow(run, kind)


# prose ---------------------------------------------------------------------------------------


def split_text(text: str, target: int = 1_000, overlap: int = 150) -> list[tuple[int, str, int, int]]:
    """ordinal, chunk, first and last line (from 1): chunks of at most ``target`` bytes that overlap.

    A chunk ends after the last blank line in its window, else after the last line break, else at the window's
    end; the next one starts ``overlap`` bytes before that, but always further on. Blank chunks are left out.
    """
    # all in letters: weight[i] is the number of bytes before letter i, so limits in bytes are looked up in it
    weight = range(len(text) + 1) if text.isascii() else [0, *accumulate(len(c.encode("utf-8", "replace")) for c in text)]
    lines = [m.end() for m in re.finditer("\n", text)]
    blanks = [m.end() + 1 for m in re.finditer("\n(?=\n)", text)]

    def within(breaks: list[int], low: int, high: int) -> int | None:
        at = bisect_right(breaks, high) - 1
        return breaks[at] if at >= 0 and breaks[at] >= low else None

    out, at = [], 0
    while at < len(text):
        reach = max(at + 1, bisect_right(weight, weight[at] + max(1, target)) - 1)
        if reach == len(text):
            end = reach
        else:
            end = within(blanks, at + 2, reach) or within(lines, at + 1, reach) or reach
        if text[at:end].strip():
            out.append((len(out), text[at:end], bisect_right(lines, at) + 1, bisect_right(lines, end - 1) + 1))
        if end == len(text):
            break
        back = bisect_right(weight, max(0, weight[end] - overlap)) - 1
        at = back if back > at else end
    return out


_FENCE = re.compile(r"^\s{0,3}(```|~~~)")
_HEADING = re.compile(r"^\s{0,3}(#{1,6})\s+(.*?)\s*#*\s*$")


def slugify(heading: str) -> str:
    return "".join(c.lower() if c.isalnum() else c if c in "_-" else "-" if c.isspace() else "" for c in heading)


def sections(text: str) -> list[tuple[int, int, str, str, int, int, int]]:
    """ordinal, level, title, slug, first line, last line, parent ordinal (-1 at the top) of Markdown headings.

    Repeated slugs are numbered; a section reaches to the next heading of its level or above. Fenced code holds
    no headings; setext underlines count.
    """
    lines = text.replace("\r\n", "\n").split("\n")
    found, fenced, seen = [], None, {}
    for i, line in enumerate(lines):
        f = _FENCE.match(line)
        if f:
            fenced = None if fenced == f[1] else fenced or f[1]
            continue
        if fenced:
            continue
        m = _HEADING.match(line)
        if m:
            found.append((i + 1, len(m[1]), m[2]))
        elif i and re.match(r"^\s{0,3}(=+|-{2,})\s*$", line) and lines[i - 1].strip() and not re.match(r"^\s*([-*+>#|]|\d+[.)])", lines[i - 1]):
            found.append((i, 1 if "=" in line else 2, lines[i - 1].strip()))
    out, stack = [], []
    for k, (line, level, title) in enumerate(found):
        slug = slugify(title)
        n = seen[slug] = seen.get(slug, -1) + 1
        last = next((b[0] - 1 for b in found[k + 1 :] if b[1] <= level), len(lines))
        while stack and found[stack[-1]][1] >= level:
            stack.pop()
        out.append((k, level, title, f"{slug}-{n}" if n else slug, line, last, stack[-1] if stack else -1))
        stack.append(k)
    return out


def front_matter(text: str) -> list[tuple[str, str]]:
    """key, value of title, aliases and related in a leading front matter; lists give one row an entry."""
    m = re.match(r"^---\r?\n(.*?)\r?\n---\s*(?:\n|$)", text, re.S)
    out, key = [], None
    for line in m[1].split("\n") if m else []:
        item = re.match(r"^\s+-\s+(.*)$|^-\s+(.*)$", line)
        pair = re.match(r"^(\w+):\s*(.*?)\s*$", line)
        if item and key:
            out.append((key, (item[1] or item[2]).strip("'\" ")))
        elif pair:
            key = pair[1] if pair[1] in ("title", "aliases", "related") else None
            value = pair[2].strip()
            if key and value.startswith("["):
                out += [(key, v.strip("'\" ")) for v in value.strip("[]").split(",") if v.strip("'\" ")]
            elif key and value:
                out.append((key, value.strip("'\"")))
    return out


def links(text: str) -> list[tuple[int, str, str, str, str]]:
    """line, kind (link, image, wiki, embed), target, anchor, label of Markdown links outside code."""
    text = text.replace("\r\n", "\n")
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    text = re.sub(r"(?ms)^\s{0,3}(```|~~~).*?(?:^\s{0,3}\1[^\n]*$|\Z)", blank, text)
    text = re.sub(r"(`+)(?!`)[^`\n]*?[^`\n]?\1(?!`)", blank, text)
    out = []
    for m in re.finditer(r"(!?)\[\[([^\[\]\n]+)\]\]|(!?)\[([^\[\]\n]*)\]\(\s*<?([^()\s<>]*)>?(?:\s+\"[^\"]*\")?\s*\)", text):
        line = text.count("\n", 0, m.start()) + 1
        if m[2] is not None:
            if "](" in m[2]:
                continue
            target, _, label = m[2].partition("|")
            target, _, anchor = target.partition("#")
            out.append((line, "embed" if m[1] else "wiki", target.strip(), anchor.strip(), label.strip()))
        else:
            target, _, anchor = m[5].partition("#")
            out.append((line, "image" if m[3] else "link", target, anchor, m[4]))
    return out


# style sheets --------------------------------------------------------------------------------


def _no_comments(css: str, line_comments: bool = True) -> str:
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    css = re.sub(r"/\*.*?(?:\*/|\Z)", blank, css, flags=re.S)
    return re.sub(r"(?m)(?<![:\w])//[^\n]*", blank, css) if line_comments else css


def _rules(css: str) -> Iterator[tuple[int, str, int, int]]:
    """offset, header, body start and end of every rule, nested ones too."""
    css, stack, start = _no_comments(css), [], 0
    for i, c in enumerate(css):
        if c == "{":
            stack.append((start, css[start:i], i + 1))
            start = i + 1
        elif c == "}":
            if stack:
                at, header, body = stack.pop()
                yield at + len(header) - len(header.lstrip()), header.strip(), body, i
            start = i + 1
        elif c == ";":
            start = i + 1


def css_atoms(css: str) -> list[tuple[str, str, int]]:
    """kind (class, id, property), name, first line: selectors and custom properties, once a file."""
    first: dict[tuple[str, str], int] = {}
    plain = _no_comments(css)
    for at, header, _, _ in _rules(css):
        if header.startswith("@"):
            continue
        header = re.sub(r"\"[^\"]*\"|'[^']*'|\[[^\]]*\]", "", header)
        for m in re.finditer(r"([.#])(-?[_a-zA-Z][\w-]*)", header):
            key = ("class" if m[1] == "." else "id", m[2])
            line = plain.count("\n", 0, at + m.start()) + 1
            first[key] = min(first.get(key, line), line)
    for m in re.finditer(r"(?m)(?:^|[{;\s])(--[\w-]+)\s*:", plain):
        key = ("property", m[1])
        line = plain.count("\n", 0, m.start(1)) + 1
        first[key] = min(first.get(key, line), line)
    return sorted((k, n, line) for (k, n), line in first.items())


def css_extends(css: str) -> list[tuple[str, str, str]]:
    """class, verb (extend, composes), target class: from rules whose header is one class alone."""
    plain, out = _no_comments(css), []
    for _, header, a, b in _rules(css):
        m = re.fullmatch(r"\.(-?[_a-zA-Z][\w-]*)", header)
        if not m:
            continue
        own = re.sub(r"[^;{}]*\{[^{}]*\}", "", plain[a:b])
        out += [(m[1], "extend", t) for t in re.findall(r"@extend\s+[.%]([\w-]+)", own)]
        for names in re.findall(r"composes\s*:\s*([^;]+)", own):
            out += [(m[1], "composes", t) for t in names.split(" from ")[0].split()]
    return out


def css_imports(css: str) -> list[tuple[str, str]]:
    """verb, target of quoted imports that are no address."""
    found = re.findall(r"@(import|use|forward)\s+(?:url\()?\s*[\"']([^\"']+)[\"']", _no_comments(css))
    return [(v, t) for v, t in found if not re.match(r"^(?:[a-z]+:)?//|^sass:", t)]


def string_tokens(code: str) -> list[tuple[int, str, bool]]:
    """line, token, marked: words of string literals; marked if a class marker stands within 64 signs before the quote."""
    out = []
    for m in re.finditer(r"\"([^\"\n\\]*(?:\\.[^\"\n\\]*)*)\"|'([^'\n\\]*(?:\\.[^'\n\\]*)*)'|`([^`\\]*(?:\\.[^`\\]*)*)`", code):
        body = m[1] or m[2] or m[3] or ""
        marked = bool(re.search(r"class(?:Name|List|es)?\b|\bcx\(|\bclsx\(", code[max(0, m.start() - 64) : m.start()]))
        line = code.count("\n", 0, m.start()) + 1
        out += [(line, t, marked) for t in dict.fromkeys(re.findall(r"-?[_a-zA-Z][\w-]*", body))]
    return out


def module_members(code: str) -> list[tuple[str, str, str]]:
    """binding, member, target file: members read from style-sheet modules."""
    out = []
    for binding, target in re.findall(r"import\s+(?:\*\s+as\s+)?(\w+)\s+from\s+[\"']([^\"']+\.(?:css|scss|sass))[\"']", code):
        names = re.findall(rf"\b{re.escape(binding)}\.([A-Za-z_]\w*)", code) + re.findall(rf"\b{re.escape(binding)}\[\s*[\"']([\w-]+)[\"']\s*\]", code)
        out += [(binding, n, target) for n in dict.fromkeys(names)]
    return out


def member_spellings(member: str) -> list[str]:
    """A member as written, in kebab and in camel case."""
    kebab = re.sub(r"(?<=[a-z0-9])([A-Z])", r"-\1", member).lower()
    camel = re.sub(r"-([a-z0-9])", lambda m: m[1].upper(), member)
    return list(dict.fromkeys([member, kebab, camel]))


# HTML and XML --------------------------------------------------------------------------------

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Elements(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[tuple[int, str]] = []

    def handle_starttag(self, tag, attrs):
        a = dict(reversed(attrs))
        self.rows.append([len(self.rows), self.open[-1][0] if self.open else -1, tag, self.getpos()[0], a.get("id"), a.get("class"), a.get("href") if "href" in a else a.get("src"), ""])
        if tag not in _VOID:
            self.open.append((len(self.rows) - 1, tag))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][1] == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        if self.open and self.open[-1][1] == "style":
            self.rows[self.open[-1][0]][7] += data


def html_elements(text: str) -> list[tuple]:
    """ordinal, parent (-1), tag, line, id, class, link (href or src), style of every element, however malformed."""
    p = _Elements()
    p.feed(text)
    p.close()
    return [tuple(r) for r in p.rows]


def xml_elements(text: str) -> list[tuple[str, str, str, str]]:
    """chain, tag, start tag, own text of every element; malformed texts give none.

    An element is told by its id or name, else by its ordinal among its siblings of that tag.
    """
    try:
        root = ElementTree.fromstring(text.encode("utf-8", "replace"))
    except ElementTree.ParseError:
        return []
    out: list[tuple[str, str, str, str]] = []

    def walk(e, chain: str) -> None:
        tag = e.tag.rsplit("}", 1)[-1]
        esc = lambda v: v.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;")
        sig = "<" + tag + "".join(f' {k.rsplit("}", 1)[-1]}="{esc(v)}"' for k, v in e.attrib.items()) + ">"
        own = " ".join("".join([e.text or "", *(c.tail or "" for c in e)]).split())
        out.append((chain, tag, sig, own))
        named = [(c, c.tag.rsplit("}", 1)[-1], c.get("id") or c.get("name")) for c in e]
        times: dict[tuple, int] = {}
        for _, t, n in named:
            times[t, n] = times.get((t, n), 0) + 1
        at: dict[str, int] = {}
        for c, t, n in named:
            at[t] = at.get(t, 0) + 1
            walk(c, f"{chain}/{t}[{n}]" if n and times[t, n] == 1 else f"{chain}/{t}:{at[t]}")

    walk(root, root.tag.rsplit("}", 1)[-1])
    return out


# SQL -----------------------------------------------------------------------------------------

SQL_VERBS = ("select", "insert", "update", "delete", "create", "alter", "drop", "merge", "with")
_NAME = r"(?:[\"`\[]?[\w$]+[\"`\]]?)(?:\s*\.\s*[\"`\[]?[\w$]+[\"`\]]?){0,2}"
_ROLE = re.compile(
    rf"\b(?P<c>create\s+(?:or\s+replace\s+)?(?:(?:global|local)\s+)?(?:temp(?:orary)?\s+)?(?:external\s+)?(?:materialized\s+)?(?:table|view)\s+(?:if\s+not\s+exists\s+)?)(?P<cn>{_NAME})"
    rf"|\b(?P<a>alter\s+(?:table|view)\s+(?:if\s+exists\s+)?(?:only\s+)?|drop\s+(?:materialized\s+)?(?:table|view)\s+(?:if\s+exists\s+)?)(?P<an>{_NAME})"
    rf"|\b(?P<r>from|join|into|update|using|references|table)\s+(?:only\s+)?(?P<rn>{_NAME})(?P<call>\s*\()?",
    re.I,
)


def split_statements(sql: str) -> list[str]:
    """Statements between semicolons that are in no literal or comment."""
    out, cur = [], ""
    for m in re.finditer(r"'(?:[^']|'')*'|\"[^\"]*\"|--[^\n]*|/\*.*?(?:\*/|\Z)|;|[^;'\"/-]+|.", sql, re.S):
        if m[0] == ";":
            out.append(cur)
            cur = ""
        elif not m[0].startswith(("--", "/*")):
            cur += m[0]
    return [s.strip() for s in [*out, cur] if s.strip()]


def sql_tables(sql: str) -> list[tuple[int, str, str, str]]:
    """ordinal, role (defines, alters, accesses), schema, table of each statement that names one.

    Names of common table expressions, table functions and names with placeholders are no tables.
    """
    out = []
    for k, s in enumerate(split_statements(sql)):
        ctes = {m.lower().strip("\"`[]") for m in re.findall(r"(?:\bwith\s+(?:recursive\s+)?|,\s*)([\w\"`]+)\s*(?:\([^()]*\)\s*)?as\s*(?:not\s+)?(?:materialized\s*)?\(", s, re.I)}
        plain = re.sub(r"'(?:[^']|'')*'", "''", s)
        plain = re.sub(r"\bextract\s*\([^()]*\)", " ", plain, flags=re.I)
        rows = []
        for m in _ROLE.finditer(plain):
            name = m["cn"] or m["an"] or m["rn"]
            role = "defines" if m["cn"] else "alters" if m["an"] else "accesses"
            end = m.end("cn") if m["cn"] else m.end("an") if m["an"] else m.end("rn")
            parts = [p.strip().strip("\"`[]") for p in name.split(".")]
            if plain[end : end + 1] in ("{", "}", ":", "@") or re.search(r"[{:@]$", plain[: m.start("cn") if m["cn"] else m.start("an") if m["an"] else m.start("rn")].rstrip() or " "):
                continue
            if parts[-1].lower() in ("select", "set", "values", "only", "lateral", "unnest", "where", "if", "as") or (m["call"] and m["r"].lower() in ("from", "join") and role == "accesses"):
                continue
            if len(parts) == 1 and parts[0].lower() in ctes:
                continue
            rows.append((k, role, ".".join(parts[:-1]).lower(), parts[-1].lower()))
        out += list(dict.fromkeys(rows))
    return out


# source literals -----------------------------------------------------------------------------


def literals(code: str, language: str | None) -> list[tuple[int, str]]:
    """line, value of string literals outside comments, for Rust, C# and the ECMAScript family; none for others."""
    forms = {
        "rust": r"//[^\n]*|/\*.*?(?:\*/|\Z)|r(?P<h>#*)\"(?P<raw>.*?)\"(?P=h)|b?\"(?P<s>(?:[^\"\\]|\\.)*)\"|'(?:[^'\\\n]|\\.)'",
        "csharp": r"//[^\n]*|/\*.*?(?:\*/|\Z)|\$?@\$?\"(?P<raw>(?:[^\"]|\"\")*)\"|\$?\"(?P<s>(?:[^\"\\\n]|\\.)*)\"|'(?:[^'\\\n]|\\.)'",
        "typescript": r"//[^\n]*|/\*.*?(?:\*/|\Z)|`(?P<raw>(?:[^`\\]|\\.)*)`|\"(?P<s>(?:[^\"\\\n]|\\.)*)\"|'(?P<t>(?:[^'\\\n]|\\.)*)'",
    }
    if language not in forms:
        return []
    out = []
    for m in re.finditer(forms[language], code, re.S):
        g = m.groupdict()
        value = next((g[k] for k in ("raw", "s", "t") if g.get(k) is not None), None)
        if value is not None:
            out.append((code.count("\n", 0, m.start()) + 1, value))
    return out
