"""Markup residue in text documents: a linear-chain conditional random field over DOM leaf blocks.

A text is taken apart into leaf blocks: lines, and the pieces between block-level tags, each with the
tags it stands in. A block's features are its ancestor tags and patterns of its text; the field's
transitions let a block depend on its neighbours (fences, tables, lists). It is trained here on
labelled pages that are put together from marked-up and unmarked fragments, and decoded by Viterbi.
The labels say how a block becomes clean text; a text holds markup if some block is not plain.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html.entities import html5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LABELS = ("plain", "inline", "heading", "item", "code", "formula", "table", "quote", "control")
SEED = 11
PAGES = 600  # labelled pages the field is trained on
EPOCHS = 100

# Tag names of HTML and of XML documentation comments.
BLOCK_TAGS = "p div ul ol li dl dt dd table thead tbody tr td th h1 h2 h3 h4 h5 h6 pre blockquote hr br section article header footer summary remarks para example list item description term returns value typeparam param exception permission".split()
INLINE_TAGS = "a abbr b big cite code del dfn em font i img ins kbd mark q s samp small span strike strong sub sup tt u var see seealso paramref typeparamref c inheritdoc ref nowiki math script style html head body title meta link center input button form label include".split()
_NAMES = "|".join(sorted({*BLOCK_TAGS, *INLINE_TAGS}, key=len, reverse=True))
TAG = re.compile(rf"<(?P<close>/?)(?P<name>{_NAMES})(?P<rest>(?:\s[^<>]*)?/?)>|<(?P<named>[A-Za-z][\w:.-]*)\s+[\w:-]+\s*=\s*[\"'][^<>]*>|<!--.*?(?:-->|$)|<!DOCTYPE[^<>]*>|<!\[CDATA\[", re.I | re.S)
_SHORT = {"a", "b", "c", "i", "p", "q", "s", "u", "tt", "item", "value", "list", "term", "label", "input", "title", "code", "span", "table", "link", "button", "form", "section", "example", "description", "script", "style", "header", "footer", "mark", "var", "sub", "ref", "include", "math", "meta", "body", "head", "font", "small", "big", "summary", "param"}
_ENTITY = re.compile(r"&(?:#\d{1,7}|#x[0-9a-f]{1,6}|([A-Za-z][A-Za-z0-9]{1,31}));", re.I)

_WORD = r"[^\W_]"
# Patterns of a block's text; each is one feature.
PATTERNS: dict[str, re.Pattern] = {
    "atx": re.compile(r"^\s{0,3}#{1,6}\s+[^a-z\s](?:[^.]*|.*[^.\s])\s*$"),
    "atx_lower": re.compile(r"^\s{0,3}#{1,6}\s+[a-z](?:[^.]*|.*[^.\s])\s*$"),
    "atx_sentence": re.compile(r"^\s{0,3}#{1,6}\s+\S.*\.\s*$"),
    "bullet": re.compile(r"^\s*[-*+•]\s+\S"),
    "number": re.compile(r"^\s*\d{1,3}[.)]\s+\S"),
    "task": re.compile(r"^\s*[-*+]\s+\[[ xX]\]\s"),
    "fence": re.compile(r"^\s*(?:```|~~~)"),
    "tick": re.compile(r"(?<![`\\])(`{1,2})(?=\S)[^`\n]+(?<=\S)\1(?!`)"),
    "star": re.compile(r"(?<![\w*/\\.])(\*{1,3})(?=[\w\"'(`<\[])[^*\n]*?(?<=[\w.!?)\"'>`:;,\]])\1(?![\w*/])"),
    "under": re.compile(r"(?<![\w/\\.])(_{1,3})(?=[^\W_])[^_\n]*\s[^_\n]*(?<=[\w.!?)])(?<!_)\1(?![\w/])"),
    "dunder": re.compile(r"(?<![\w/\\.])__(?=[^\W_])[^_\s]+__(?!\w)"),
    "strike": re.compile(r"~~(?=\S)[^~\n]+~~"),
    "link": re.compile(r"(?<![\w\])])!?\[[^\]\n]+\]\([^()\s]+(?:\s+\"[^\"]*\")?\)|!\[[^\]\n]*\]\([^()\n]*\)"),
    "reflink": re.compile(r"(?<![\w\])])!?\[[^\]\n]+\]\[[^\]\n]*\]"),
    "refdef": re.compile(r"^\s{0,3}\[[^\]\n]+\]:\s*\S"),
    "footnote": re.compile(r"\[\^[^\]\s]+\]"),
    "autolink": re.compile(r"<(?:https?|mailto|ftp):[^<>\s]+>"),
    "table_row": re.compile(r"^\s*\|(?![-}]).*\|\s*$"),
    "table_rule": re.compile(r"^\s*\|?\s*:?-{2,}:?\s*(?:\|\s*:?-{2,}:?\s*)+\|?\s*$"),
    "quote": re.compile(r"^\s{0,3}>\s+\S"),
    "setext": re.compile(r"^\s{0,3}(?:={3,}|-{3,})\s*$"),
    "wiki_heading": re.compile(r"^\s*(={2,6})\s*[^=\s][^=\n]*?\s*\1\s*$"),
    "wiki_link": re.compile(r"\[\[[^\[\]\n]+\]\]"),
    "wiki_template": re.compile(r"\{\{[^\s{}][^{}\n]*\}\}"),
    "wiki_quote": re.compile(r"(?<![\w'])'{2,5}(?=[^\s'])[^'\n]+(?:'[^'\n]+)*'{2,5}(?!\w)"),
    "wiki_table": re.compile(r"^\s*(?:\{\||\|\}|\|-|\|\+)"),
    "wiki_cell": re.compile(r"^\s*[!|]\s+\S[^|]*$"),
    "wiki_list": re.compile(r"^\s*[*#:;]{2,}\s*\S"),
    "redirect": re.compile(r"^\s*#REDIRECT\b", re.I),
    "magic": re.compile(r"__(?:TOC|NOTOC|FORCETOC|NOEDITSECTION)__"),
    "tex_command": re.compile(r"\\[A-Za-z]{2,}\*?(?:\[[^\]\n]*\])?\{"),
    "tex_env": re.compile(r"^\s*\\(?:begin|end)\s*\{"),
    "tex_item": re.compile(r"^\s*\\item\b"),
    "tex_section": re.compile(r"^\s*\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph|title|caption)\*?\s*\{"),
    "tex_break": re.compile(r"(?<!\S)\\\\(?:\s|$)|\\(?:newline|newpage|linebreak|noindent|hline|maketitle|par)\b"),
    "tex_symbol": re.compile(r"(?<![\w:\\/])\\(?:alpha|beta|gamma|delta|epsilon|lambda|mu|pi|sigma|theta|omega|phi|psi|rho|tau|sum|prod|int|frac|sqrt|le|ge|leq|geq|neq|approx|infty|log|in|cdot|times|ldots|dots|to|rightarrow|forall|exists|partial|nabla)(?![A-Za-z])"),
    "dollars": re.compile(r"\$\$.+?\$\$|^\s*\$\$\s*$"),
    "dollar": re.compile(r"(?<![\w$\\])\$(?=[^\s$])[^$\n]*?[\\^_{}=+<>()][^$\n]*?(?<=[^\s$\\])\$(?![\w$])|(?<![\w$\\])\$[A-Za-z]\$(?![\w$])"),
    "tex_paren": re.compile(r"\\\(.+?\\\)|\\\[.+?\\\]|^\s*\\[\[\]]\s*$"),
    "tex_escape": re.compile(r"(?<!\\)\\[%&#_$](?=[\s\w{])(?<![:\w\\]..)"),
    "tie": re.compile(r"\w~\\"),
    # code-like notation of running text: it tells against markup
    "generic": re.compile(r"\w<[\w&\[\], <>|?*]+>"),
    "glob": re.compile(r"\*\*?[/.]\S"),
    "call": re.compile(r"\w\([^()]*\)"),
    "shell": re.compile(r"\$[A-Z_]{2,}\b"),
    "compare": re.compile(r"\s(?:<|>|<=|>=|=>|&&|\|\||<<|>>)\s"),
    "assign": re.compile(r"^\s*\w[\w. ]*=[^=].*;?\s*$"),
    "semicolon": re.compile(r"[;{}]\s*$"),
    "doc_tag": re.compile(r"^\s*(?:[@\\]\w+\b|:\w+[^:]*:)"),
    "indented": re.compile(r"^(?: {4}|\t| {2}(?=\S))"),
    "ruler": re.compile(r"^\W*$"),
    "sentence": re.compile(r"[a-z][.!?]\s*$"),
    "title": re.compile(rf"^\s*{_WORD}+(?:\s+{_WORD}+){{0,5}}\s*$"),
}

_LEADERS = (re.compile(r"^[ \t]*///?!?(?!/)[ \t]?"), re.compile(r"^[ \t]*#(?![#\w!\[])[ \t]?"), re.compile(r"^[ \t]*\*(?![*\w/])[ \t]?"), re.compile(r"^[ \t]*--(?!-)[ \t]"), re.compile(r"^[ \t]*;;?[ \t]"), re.compile(r"^[ \t]*%(?!\w)[ \t]?"))


@dataclass
class Block:
    """A leaf of the text: where it starts, its text, the tags around it and the tags within it."""

    start: int
    text: str
    ancestors: tuple[str, ...]
    tags: tuple[str, ...]


def uncomment(text: str) -> str:
    """Without comment delimiters and line leaders, which are no markup; offsets are not kept."""
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\ufeff", "")
    bare = text.strip()
    inside = bare.startswith("/*")
    if inside or bare.endswith("*/"):
        text = re.sub(r"^\s*/\*+!?", "", text)
        text = re.sub(r"\*+/\s*$", "", text)
    text = re.sub(r'^\s*"""|"""\s*$', "", text)
    lines = text.split("\n")
    full = [x for x in lines if x.strip()]
    for leader in _LEADERS:
        # a leader leads every line; one line alone may as well be a heading or an item
        led = [x for x in full[1 if inside and full and not leader.match(full[0]) else 0 :] if leader.match(x)]
        star, slash = leader is _LEADERS[2], leader is _LEADERS[0]
        if full and len(led) >= len(full) - (inside and star) and (slash or len(led) > 1 or (star and inside)):
            if not star or inside:
                lines = [leader.sub("", x, count=1) for x in lines]
                break
    return "\n".join(lines)


def tag_name(m: re.Match, text: str) -> str | None:
    """Name of a tag match, or None where it is rather a type parameter such as List<item>."""
    if m["named"]:
        return m["named"].lower()
    if not m["name"]:
        return "comment"
    name = m["name"].lower()
    generic = m.start() > 0 and (text[m.start() - 1].isalnum() or text[m.start() - 1] in "_<,")
    if name in _SHORT and generic and not m["close"] and not m["rest"] and f"</{name}" not in text[m.end() :].lower():
        return None
    return name


def segment(text: str) -> list[Block]:
    """Leaf blocks of a text without comment leaders. Blank lines and empty pieces without tags are left out."""
    out: list[Block] = []
    stack: list[str] = []
    buffer, start, tag_at, tags = [], None, 0, []
    around: tuple[str, ...] = ()

    def flush() -> None:
        nonlocal start
        said = "".join(buffer)
        if said.strip() or tags:
            out.append(Block(start if start is not None else tag_at, said.strip("\n"), around, tuple(tags)))
        buffer.clear()
        tags.clear()
        start = None

    def take(piece: str, at: int) -> None:
        nonlocal start, around
        for k, line in enumerate(piece.split("\n")):
            if k:
                flush()
            if line:
                if start is None and line.strip():
                    start = at + len(line) - len(line.lstrip())
                if not buffer:
                    around = tuple(stack)
                buffer.append(line)
            at += len(line) + 1

    at = 0
    for m in TAG.finditer(text) if "<" in text else ():
        name = tag_name(m, text)
        if name is None:
            continue
        take(text[at : m.start()], at)
        at = m.end()
        if name in _BLOCKS:
            flush()
            tag_at = m.start()
            if m["close"]:
                while name in stack:
                    if stack.pop() == name:
                        break
            elif not (m["rest"] or "").endswith("/") and name not in ("br", "hr", "p"):
                stack.append(name)
            around = tuple(stack)
            tags.append(name)
        else:
            if start is None:
                start = m.start()
            if not buffer:
                around = tuple(stack)
            tags.append(name)
    take(text[at:], at)
    flush()
    return out


_BLOCKS = frozenset(BLOCK_TAGS)


def features(blocks: list[Block]) -> list[list[str]]:
    out = []
    for b in blocks:
        f = ["bias"]
        t = b.text
        if not t.strip():
            f.append("empty")
        else:
            f += [name for name, p in _screen(t) if p.search(t)]
            if "&" in t and any(not e[1] or f"{e[1]};" in html5 for e in _ENTITY.finditer(t)):
                f.append("entity")
        f += [f"in:{a}" for a in dict.fromkeys(b.ancestors)]
        if b.tags:
            f.append("tag")
            f += [f"tag:{a}" for a in dict.fromkeys(b.tags)]
        out.append(f)
    for i, f in enumerate(out):
        # underlines make a heading of a short line without an end before them
        if "setext" in f and i and blocks[i - 1].text.strip():
            before = out[i - 1]
            if "title" in before and "sentence" not in before:
                f.append("underline")
                before.append("underlined")
    inside = False
    for f in out:
        if "fence" in f:
            inside = not inside
        elif inside:
            f.append("fenced")
    depth = 0
    for b, f in zip(blocks, out):
        for m in re.finditer(r"\\(begin|end)\s*\{(\w+)\*?\}", b.text):
            depth = m[2] if m[1] == "begin" else 0
        if depth and "tex_env" not in f:
            f.append(f"env:{'math' if depth in _MATH else 'other'}")
    return out


_MATH = {"equation", "align", "gather", "displaymath", "math", "eqnarray", "multline"}
_CHEAP = ("indented", "ruler", "sentence", "title", "setext", "number", "assign", "semicolon", "doc_tag", "call")
_SIGNS = {
    "atx": "#", "atx_lower": "#", "atx_sentence": "#", "bullet": "-*+•", "task": "[", "fence": "`~", "tick": "`", "star": "*", "under": "_", "dunder": "_", "strike": "~", "link": "[", "reflink": "[",
    "refdef": "[", "footnote": "[", "autolink": "<", "table_row": "|", "table_rule": "-", "quote": ">", "wiki_heading": "=", "wiki_link": "[", "wiki_template": "{", "wiki_quote": "'", "wiki_table": "|",
    "wiki_cell": "!|", "wiki_list": "*#:;", "redirect": "#", "magic": "_", "tex_command": "\\", "tex_env": "\\", "tex_item": "\\", "tex_section": "\\", "tex_break": "\\", "tex_symbol": "\\",
    "dollars": "$", "dollar": "$", "tex_paren": "\\", "tex_escape": "\\", "tie": "~", "generic": "<", "glob": "*", "shell": "$", "compare": "<>&|=",
}
_BY_SIGN: dict[str, list[str]] = {}
for _n, _cs in _SIGNS.items():
    for _c in _cs:
        _BY_SIGN.setdefault(_c, []).append(_n)
_SIGN = re.compile("[" + re.escape("".join(_BY_SIGN)) + "]")


def _screen(text: str) -> list[tuple[str, re.Pattern]]:
    """The patterns whose characters occur in the text at all."""
    names = dict.fromkeys(_CHEAP)
    for c in set(_SIGN.findall(text)):
        names.update(dict.fromkeys(_BY_SIGN[c]))
    return [(n, PATTERNS[n]) for n in names]


class Field:
    """A linear-chain conditional random field with sparse binary features."""

    def __init__(self, names: list[str]):
        self.index = {n: i for i, n in enumerate(names)}
        k = len(LABELS)
        self.emit = np.zeros((len(names) + 1, k))  # the last row stays zero: unknown features
        self.step = np.zeros((k, k))
        self.first = np.zeros(k)
        self.__setstate__({})

    KEPT = 50_000  # feature sets and sequences whose result is kept before the tables start anew

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._emitted: dict[tuple[str, ...], np.ndarray] = {}
        self._paths: dict[tuple[tuple[str, ...], ...], list[int]] = {}

    def _emission(self, f: tuple[str, ...]) -> np.ndarray:
        e = self._emitted.get(f)
        if e is None:
            if len(self._emitted) >= self.KEPT:
                self._emitted.clear()
            e = self._emitted[f] = self.emit[[i for i in map(self.index.get, f) if i is not None]].sum(axis=0)
        return e

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The most probable labels, by Viterbi. Texts of one form have one sequence of features, which is decoded once."""
        if not rows:
            return []
        key = tuple(map(tuple, rows))
        path = self._paths.get(key)
        if path is None:
            path = self._viterbi(key)
            if len(key) <= 64:
                if len(self._paths) >= self.KEPT:
                    self._paths.clear()
                self._paths[key] = path
        return path

    def _viterbi(self, rows: tuple[tuple[str, ...], ...]) -> list[int]:
        best = self.first + self._emission(rows[0])
        back = []
        for f in rows[1:]:
            through = best[:, None] + self.step
            back.append(through.argmax(axis=0))
            best = through.max(axis=0) + self._emission(f)
        at = int(best.argmax())
        path = [at]
        for b in reversed(back):
            at = int(b[at])
            path.append(at)
        return path[::-1]

    @classmethod
    def train(cls, pages: list[tuple[list[list[str]], list[int]]], epochs: int = EPOCHS, rate: float = 0.5, ridge: float = 2e-5) -> Field:
        """Maximum likelihood by AdaGrad over all pages at once, padded to the longest."""
        names = sorted({n for rows, _ in pages for f in rows for n in f})
        self = cls(names)
        k, p, t = len(LABELS), len(pages), max(len(y) for _, y in pages)
        y = np.zeros((p, t), dtype=int)
        live = np.zeros((p, t))
        pairs = []  # (feature, cell) of every feature that is on
        for i, (rows, labels) in enumerate(pages):
            for j, (f, label) in enumerate(zip(rows, labels)):
                pairs += [(self.index[n], i * t + j) for n in f]
                y[i, j], live[i, j] = label, 1
        by_cell = np.array(sorted(pairs, key=lambda q: q[1]))
        by_feature = np.array(sorted(pairs))
        cells, cell_starts = np.unique(by_cell[:, 1], return_index=True)
        feature_starts = np.unique(by_feature[:, 0], return_index=True)[1]
        gold = np.eye(k)[y] * live[..., None]
        gold_step = np.einsum("ptk,ptl->kl", gold[:, :-1], gold[:, 1:])
        sums = [np.full_like(w, 1e-8) for w in (self.emit, self.step, self.first)]
        for _ in range(epochs):
            e = np.zeros((p * t, k))
            e[cells] = np.add.reduceat(self.emit[by_cell[:, 0]], cell_starts)
            e = e.reshape(p, t, k)
            fwd, bwd = np.zeros((p, t, k)), np.zeros((p, t, k))
            fwd[:, 0] = self.first + e[:, 0]
            for j in range(1, t):
                new = _lse(fwd[:, j - 1, :, None] + self.step, 1) + e[:, j]
                fwd[:, j] = np.where(live[:, j, None] > 0, new, fwd[:, j - 1])
            for j in range(t - 2, -1, -1):
                new = _lse(self.step + (e[:, j + 1] + bwd[:, j + 1])[:, None, :], 2)
                bwd[:, j] = np.where(live[:, j + 1, None] > 0, new, bwd[:, j + 1])
            total = _lse(fwd[:, -1], 1)
            node = np.exp(fwd + bwd - total[:, None, None]) * live[..., None]
            both = fwd[:, :-1, :, None] + self.step + (e + bwd)[:, 1:, None, :] - total[:, None, None, None]
            pair = np.exp(np.minimum(both, 0)) * live[:, 1:, None, None]
            diff = gold - node
            g_emit = np.zeros_like(self.emit)
            g_emit[: len(names)] = np.add.reduceat(diff.reshape(p * t, k)[by_feature[:, 1]], feature_starts)
            grads = (g_emit / p - ridge * self.emit, (gold_step - pair.sum(axis=(0, 1))) / p - ridge * self.step, diff[:, 0].mean(axis=0) - ridge * self.first)
            for w, g, s in zip((self.emit, self.step, self.first), grads, sums):
                s += g * g
                w += rate * g / np.sqrt(s)
            self.emit[-1] = 0
        return self


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return np.log(np.exp(a - m).sum(axis=axis)) + m.squeeze(axis)


@lru_cache(maxsize=1)
def trained() -> Field:
    """The field, trained once a process on the labelled pages of :mod:`symloom.llm.labelled_pages`."""
    from symloom.llm.labelled_pages import pages

    rows = []
    for text, marks in pages(SEED, PAGES):
        blocks = segment(text)
        rows.append((features(blocks), [LABELS.index(label_at(marks, b.start)) for b in blocks]))
    return Field.train([r for r in rows if r[1]])


def label_at(marks: list[tuple[int, str]], at: int) -> str:
    """The label whose mark is the last at or before an offset."""
    found = marks[0][1]
    for start, label in marks:
        if start > at:
            break
        found = label
    return found


def labels(text: str | None, field: Field) -> list[tuple[Block, str]]:
    """Blocks of a text with their decoded labels; null and blank texts have none."""
    if not text or not text.strip():
        return []
    blocks = segment(uncomment(text))
    return [(b, LABELS[k]) for b, k in zip(blocks, field.decode(features(blocks)))]


def holds_markup(text: str | None, field: Field) -> bool:
    return any(label != "plain" for _, label in labels(text, field))


def _inline(t: str) -> str:
    """A block's text without inline markup; links keep their text, formulas stay as they are."""
    kept: list[str] = []

    def keep(m: re.Match) -> str:
        kept.append(m[0])
        return f"\x00{len(kept) - 1}\x00"

    for p in ("dollars", "dollar", "tex_paren"):
        t = PATTERNS[p].sub(keep, t)
    t = TAG.sub(lambda m: "" if tag_name(m, t) else m[0], t)
    t = html.unescape(html.unescape(t)).replace("\u00a0", " ") if "&" in t else t
    t = re.sub(r"!?\[([^\]\n]*)\]\([^()\n]*\)", r"\1", t)
    t = re.sub(r"(?<![\w\])])!?\[([^\]\n]+)\]\[[^\]\n]*\]", r"\1", t)
    t = PATTERNS["footnote"].sub("", t)
    t = re.sub(r"\[\[(?:Category|File|Image):[^\[\]]*\]\]", "", t)
    t = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]+)\]\]", r"\1", t)
    t = PATTERNS["wiki_template"].sub("", t)
    t = re.sub(r"(?<!\w)'{2,5}|'{2,5}(?!\w)", "", t)
    for p in ("star", "under"):
        t = PATTERNS[p].sub(lambda m: m[0][len(m[1]) : -len(m[1])], t)
    t = re.sub(r"~~(?=\S)([^~\n]+)~~", r"\1", t)
    t = re.sub(r"(?<![`\\])(`{1,2})(?=\S)([^`\n]+?)\1(?!`)", r"\2", t)
    t = re.sub(r"\\footnote\{([^{}]*)\}", r" (\1)", t)
    t = re.sub(r"~?\\(?:cite[a-z]*|ref|label|eqref|pageref)\*?(?:\[[^\]]*\])?\{[^{}]*\}", "", t)
    for _ in range(3):
        t = re.sub(r"\\[A-Za-z]{2,}\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}", r"\1", t)
    t = re.sub(r"(?<!\S)\\\\(?=\s|$)|\\item\b", " ", t)
    t = re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m[1])], t)
    return re.sub(r"[ \t]{2,}", " ", t).strip()


def clean(text: str | None, field: Field) -> str:
    """Clean text: headings as "# ", items as "- ", code between fences, cells between bars, quotes after "> "."""
    out: list[str] = []
    open_code = False
    for b, label in labels(text, field):
        if open_code and label != "code":
            out.append("```")
            open_code = False
        t = b.text
        if label == "plain":
            out.append(t.strip())
        elif label == "code":
            if PATTERNS["fence"].match(t):
                continue
            if not open_code:
                out.append("```")
                open_code = True
            out.append(html.unescape(TAG.sub("", t)))
        elif label == "formula":
            out.append(t.strip())
        elif label == "heading":
            name = re.sub(r"^\s*#{1,6}\s*|^\s*={2,6}\s*|\s*={2,6}\s*$", "", t)
            out.append("# " + _inline(name))
        elif label == "item":
            out.append("- " + _inline(re.sub(r"^\s*(?:[-*+•#:;]+|\d{1,3}[.)]|\\item)\s+(?:\[[ xX]\]\s+)?", "", t)))
        elif label == "table":
            if not PATTERNS["table_rule"].match(t):
                out.append(" | ".join(_inline(c) for c in re.split(r"\|", t.strip().strip("|!")) if c.strip()))
        elif label == "quote":
            out.append("> " + _inline(re.sub(r"^\s*>\s*", "", t)))
        elif label == "inline":
            out.append(_inline(t))
    if open_code:
        out.append("```")
    return "\n".join(x for x in out if x)


def marked(rows: DataFrame, field: Field) -> DataFrame:
    """``rows`` (tab, key_id, doc) with ``markup``: whether the doc holds markup, and ``clean``."""
    shared = rows.sparkSession.sparkContext.broadcast(field)  # a few thousand numbers

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs = b.column(2).to_pylist()
            found = pa.array([holds_markup(d, shared.value) for d in docs], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), found], ["tab", "key_id", "markup"])

    return rows.select("tab", F.col("key_id").cast("long"), "doc").mapInArrow(read, "tab string, key_id long, markup boolean")


def cleaned(rows: DataFrame, field: Field) -> DataFrame:
    """tab, key_id, text: clean text of every doc; null docs give null."""
    shared = rows.sparkSession.sparkContext.broadcast(field)  # a few thousand numbers

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs = b.column(2).to_pylist()
            text = pa.array([None if d is None else clean(d, shared.value) for d in docs], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), text], ["tab", "key_id", "text"])

    return rows.select("tab", F.col("key_id").cast("long"), "doc").mapInArrow(read, "tab string, key_id long, text string")
