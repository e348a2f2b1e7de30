"""Labelled pages for the markup field: texts put together from fragments whose blocks have known labels."""

from __future__ import annotations

import random

# Words the fragments are filled with.
NOUNS = "kernel socket packet vector matrix thread channel driver router server client table column record branch commit patch tensor layer sensor motor engine signal filter mirror gateway device window dialog canvas pixel shader palette lexer grammar scanner loader linker mapper reducer worker planner".split()
VERBS = "opens closes reads writes checks sends drops merges sorts groups counts loads stores maps scans moves holds keeps clears fills locks frees returns skips".split()
ADJECTIVES = "small large empty full open old new shared private remote local static dynamic partial stable broken active idle fast slow".split()
TYPES = "int str bool Row Node Leaf Block Error Config Token State Handle".split()

Piece = tuple[str, str]


class Writer:
    def __init__(self, rng: random.Random):
        self.r = rng

    def noun(self) -> str:
        return self.r.choice(NOUNS)

    def name(self) -> str:
        a, b = self.r.choice(VERBS)[:-1], self.noun()
        return self.r.choice((f"{a}_{b}", f"{a}{b.title()}", f"{a.title()}{b.title()}", f"{a}_{b}_{self.noun()}"))

    def words(self, n: int) -> str:
        return " ".join(self.r.choice((self.noun(), self.r.choice(ADJECTIVES))) for _ in range(n))

    def sentence(self) -> str:
        r = self.r
        n = self.noun
        return r.choice((
            f"The {r.choice(ADJECTIVES)} {n()} {r.choice(VERBS)} the {n()}.",
            f"{r.choice(VERBS).title()} every {n()} of the {r.choice(ADJECTIVES)} {n()}, then the {n()}.",
            f"If the {n()} is {r.choice(ADJECTIVES)}, the {n()} {r.choice(VERBS)} {r.randint(2, 90)} {n()}s and {self.name()} {r.choice(VERBS)} the rest.",
            f"{r.choice(VERBS).title()} the {n()} once: the second {n()} {r.choice(VERBS)} nothing.",
            f"Not {r.choice(ADJECTIVES)}.", f"{r.choice(ADJECTIVES).title()} {n()}s are never {r.choice(ADJECTIVES)}; callers keep the {n()}.",
        ))

    def notation(self) -> str:
        """Code-like notation of running text, which is no markup."""
        r, n, t = self.r, self.noun, lambda: r.choice(TYPES)
        return r.choice((
            f"Holds a {t()}<{t()}, List<{t()}>> keyed by {n()}.", f"Gives Option<{self.name()}> or Vec<Option<{t()}>> in order.", f"Maps &{t()} -> Result<{self.name()}, E> and A & B -> C.",
            f"True when a < b && b > c for every {n()}.", f"Needs x <= y and y => z of the {n()}.", f"Masks with ~m and shifts by 1 << k, at least 3 > 2 times.",
            f"Takes {r.randint(2, 9)} * k * n {n()}s, see issue #{r.randint(10, 900)}.", f"Value is x^2 + y_1 when the {n()} is {r.choice(ADJECTIVES)}.",
            f"Finds *.rs and *.py but not **/{n()}s/* in the {n()}.", f"Takes **kwargs and *args and passes them to {self.name()}.", f"Called as {self.name()}(x, [y], *rest).", f"Calls table[kind](args) for each {n()}.",
            f"Entry arr[i][j] holds the {n()} of {self.name()}.", f"Covers the range [0, n) of the {n()}.", f"Skips __init__ and __main__ and _private_{n()}.", f"Reads $HOME and $TMPDIR before C:\\temp\\{n()}.", f"Looks under C:\\users\\{n()}\\{n()} and \\\\{n()}\\share.",
            f"Costs about {r.randint(2, 9)} $ or {r.randint(2, 9)} $ a {n()}.", f"Costs ${r.randint(2, 9)} to ${r.randint(10, 90)} on the {n()} plan.", f"Between 10% and 90% of the {n()}s, i.e. ~{r.randint(10, 90)} on average.", f"Expands ~/{n()} and ../{n()} but not /{n()}.",
            f"One of open | closed | {r.choice(ADJECTIVES)}.", f"Meant for C# and F# callers of the {n()}.", f"Lines that start with # or ; are {r.choice(ADJECTIVES)}.", f"Prints {{0}} and {{1}} in the {n()}.", f"Prints {{{n()}}} and ${{{n()}}} of the {n()}.",
            f"Sets a_{n()}_b and __{n()}__ of {self.name()}.", f"Uses a ? b : c and !x || y of the {n()}.", f"Returns -1 when the {n()} is absent.", f"O(n) in the number of {n()}s.", f"Key=value pairs of the {n()}, a=b;c=d.", f"Ends with \\n or \\t; \\{n()} is kept.", f"The {n()}'s owner doesn't keep 'it' open.",
        ))

    def inline(self) -> str:
        """A sentence or its part with inline markup."""
        r, n = self.r, self.noun
        s = self.sentence()
        return r.choice((
            f"The *{n()}* part comes {r.choice(ADJECTIVES)}.", f"**{n().title()}** {s}", f"**Note:** {s}", f"Calls `{self.name()}` once.", f"Use `{self.name()}({n()})` or ``{n()}`` first.", f"~~{s}~~", f"{s} ~~{s}~~", f"_{s[:-1]}_ is meant.", f"The __{self.words(2)}__ stays.",
            f"See [the {n()} guide](docs/{n()}.md#{self.name()}).", f"See [{n()}][1] and ![{self.name()}](img/{n()}.png).", f"![{n()}]({n()}.png)", f"Old {n()}s keep the {n()} form.[^1]", f"Read <https://{n()}.example/{n()}> first.", f"Older {n()}s keep the __{n()}__ form.[^{r.randint(1, 9)}]",
            f"See [[{self.name()}|the {n()} page]].", f"Part of [[{n()}]].", f"'''{n()}''' {s}", f"{s} ''{s}''", f"{{{{{r.choice(('note', 'see', 'stub', 'main'))}|{n()}}}}}", f"{{{{{n()}}}}} {s}",
            f"The \\emph{{{n()}}} is \\texttt{{{self.name()}}}.", f"\\textbf{{{n().title()}.}} {s}", f"As shown in~\\cite{{{self.name()}}} and \\ref{{fig:{n()}}}.", f"{s}\\footnote{{{s}}}", f"{s} \\\\", f"{s} \\\\ {s}", f"About 5\\% of \\_{n()}\\_ and R\\&D.",
            f"Runs in $O(n \\log n)$ for $n$ of them.", f"The cost is $\\sum_{{i=1}}^{{k}} c_i$ a {n()}.", "Here \\(x_i \\le y_i\\) holds.", f"With $x_{{1}} + y$ each {n()} is {r.choice(ADJECTIVES)}.", f"Where \\alpha and \\beta are the {n()}s.",
            f"Use <code>{self.name()}</code> first.", f"<b>Note:</b> {s}", f"<B>{n().title()}</B> {s}", f"<i>{s}", f"{s} <em>{n()}</em>", f'<a href="../{n()}.html#{self.name()}">{n()}</a> {s}', f'See <see cref="{self.name()}"/> for the {n()}.', f"{s}<ref name=\"{n()}\">{s}</ref>", f"{s}<ref>{n()}",
            f"The {n()}&#8217;s owner keeps it&nbsp;open.", f"The key &quot;{self.name()}&quot; &amp; its {n()} come first.", f"&amp;lt;{n()}&amp;gt; is kept as written.", f"&lt;b&gt;{n()}&lt;/b&gt; is bold.", f"a &lt; b &mdash; c", f'<paramref name="{n()}"/> is {r.choice(ADJECTIVES)}.', f"<span class='x'>{n()}</span> {s}", f"{s} <!-- {n()} -->", f"<strong>{n()}</strong>: {s}", f"Line one<sup>2</sup> and H<sub>2</sub>O.",
        ))

    def fragment(self) -> list[Piece]:
        """One marked-up construct, line by line (a line break is part of the text)."""
        r, n, s = self.r, self.noun, self.sentence
        any_line = lambda: r.choice((s(), s(), self.inline(), self.notation()))
        kind = r.randrange(30)
        if kind == 0:
            return [("#" * r.randint(1, 4) + f" {self.words(r.randint(1, 3)).title()}\n", "heading")]
        if kind == 1:
            return [(f"{n().title()} {r.choice(('rules', 'notes', 'usage'))}\n", "heading"), (r.choice("=-") * r.randint(3, 14) + "\n", "heading")]
        if kind == 2:
            return [(f"{r.choice('-*+')} {any_line()}\n", "item") for _ in range(r.randint(2, 4))]
        if kind == 3:
            return [(f"- {r.choice(('[ ]', '[x]'))} {any_line()}\n", "item") for _ in range(r.randint(1, 3))]
        if kind == 4:
            return [(f"{k}{r.choice('..)')} {r.choice((any_line(), f'`{self.name()}`'))}\n", "item") for k in range(1, r.randint(2, 5))] + [(f"   * {s()}\n", "item")] * r.randint(0, 1)
        if kind == 5:
            return [(f"- **{n()}**: {any_line()}\n", "item") for _ in range(r.randint(1, 3))]
        if kind == 6:
            body = [(r.choice((f"{self.name()}({n()});", f"let {n()} = {self.name()}({r.randint(1, 9)});", "# setup", f"  return {n()}", f"* {n()}", f"$ run {n()} --all")) + "\n", "code") for _ in range(r.randint(1, 4))]
            return [(f"```{r.choice(('', 'rust', 'python', 'sh'))}\n", "code"), *body, ("```\n", "code")]
        if kind == 7:
            return [(f"| {n()} | {n()} |\n", "table"), (r.choice(("|---|:--:|\n", "| --- | --- |\n")), "table"), *((f"| {r.randint(1, 99)} | {self.name()} |\n", "table") for _ in range(r.randint(1, 3)))]
        if kind == 8:
            return [(f"> {any_line()}\n", "quote") for _ in range(r.randint(1, 2))]
        if kind == 9:
            return [(f"[{r.choice(('1', '^1', n()))}]: {r.choice(('../' + n() + '.md', any_line()))}\n", "control")]
        if kind == 10:
            return [(("=" * (k := r.randint(2, 4))) + f" {self.words(r.randint(1, 2)).title()} " + "=" * k + "\n", "heading")]
        if kind == 11:
            return [(f"* [[{self.name()}]]\n", "item"), (f"** ''{n()}''\n", "item")]
        if kind == 12:
            return [('{| class="wikitable"\n', "control"), (f"! {n()}\n", "table"), ("|-\n", "control"), (f"| {self.name()}\n", "table"), ("|}\n", "control")]
        if kind == 13:
            return [(f"#REDIRECT [[{self.name()}]]\n", "control")]
        if kind == 14:
            return [(f"[[Category:{n()}]]\n", "control")]
        if kind == 15:
            return [(f"\\{r.choice(('section', 'subsection', 'paragraph'))}{{{n()}}}\n", "heading")]
        if kind == 16:
            env = r.choice(("itemize", "enumerate"))
            return [(f"\\begin{{{env}}}\n", "control"), *((f"\\item {any_line()}\n", "item") for _ in range(r.randint(1, 3))), (f"\\end{{{env}}}\n", "control")]
        if kind == 17:
            return [(f"\\item {s()}{r.choice(('', ' ' + chr(92) * 2))}\n", "item")]
        if kind == 18:
            env = r.choice(("equation", "align"))
            return [(f"\\begin{{{env}}}\n", "control"), ("  s = \\alpha t + (1 - \\alpha) u\n", "formula"), (f"\\end{{{env}}}\n", "control")]
        if kind == 19:
            return [("$$ w_{ij} = \\frac{c_{ij}}{\\sum_k c_{ik}} $$\n", "formula")]
        if kind == 20:
            items: list[Piece] = [("<ul>", "control")]
            for _ in range(r.randint(1, 3)):
                items += [("<li>", "control"), (s(), "item"), ("</li>", "control")]
            return [*items, ("</ul>", "control"), ("\n", "plain")]
        if kind == 21:
            return [("<table>", "control"), ("<tr>", "control"), ("<th>", "control"), (n(), "table"), ("</th>", "control"), ("<td>", "control"), (self.name(), "table"), ("</td></tr></table>\n", "control")]
        if kind == 22:
            return [(r.choice(("<PRE class='x'>", "<pre>")), "control"), ("\n", "plain"), (f"  {self.name()}({r.randint(1, 99)})\n", "code"), (r.choice(("</PRE>", "</pre>")), "control"), ("\n", "plain")]
        if kind == 23:
            return [(r.choice(("<p>", "<P>")), "control"), (s(), "inline"), (r.choice(("</p>\n", "\n")), "control")]
        if kind == 24:
            return [(r.choice(("<p></p>\n", "<summary></summary>\n", "<inheritdoc/>\n", "<hr/>\n", "<div>\n", "</div>\n", "<inheritdoc />\n", '<param name="x"></param>\n', "<br>\n")), "control")]
        if kind == 25:
            return [("<summary>", "control"), ("\n", "plain"), (s() + "\n", "plain" if r.random() < 0 else "inline"), ("</summary>", "control"), ("\n", "plain")]
        if kind == 26:
            return [("<h3>", "control"), (n(), "heading"), ("</h3>", "control"), (s(), "inline"), ("\n", "plain")]
        if kind == 27:
            return [(f"<!-- {n()} -->\n", "control")]
        if kind == 28:
            return [(f"{s()}", "plain"), ("<br>", "control"), (s() + "\n", "inline")]
        return [(f"{s()}", "plain"), (r.choice(("</p>", "</div>", "</summary>")), "control"), ("\n", "plain")]

    def bare(self) -> list[Piece]:
        """Lines of comments that are no markup."""
        r, n = self.r, self.noun
        return r.choice((
            lambda: [(f"@param {n()} {self.sentence()}\n", "plain"), (f"@return {r.choice(('', 'the result', n()))}\n", "plain")],
            lambda: [(f":param {n()}: {r.choice(('', 'the ' + n(), self.sentence()))}\n", "plain"), (":returns: value\n", "plain")],
            lambda: [("{@inheritDoc}\n", "plain")], lambda: [(r.choice(("-", "=", "/", "*", "#", "~")) * r.randint(8, 30) + "\n", "plain")],
            lambda: [("-" * 12 + "\n", "plain"), (f"This {n()} was written by a {n()}.\n", "plain"), (f"Changes to this {n()} are lost when it is written again.\n", "plain"), ("-" * 12 + "\n", "plain")],
            lambda: [(f"---- {n()} ----\n", "plain")], lambda: [(f"////// {n()} //////\n", "plain")], lambda: [("Args:\n", "plain"), (f"    {n()}: {n()}\n", "plain"), ("Returns:\n", "plain"), (f"    {n()}\n", "plain")],
            lambda: [(f"let {n()} = {self.name()}({n()});\n", "plain"), (f"return {n()};\n", "plain")], lambda: [(f"{r.choice(('TODO', 'wip', 'n/a', '...', '--', '-', 'xxx', 'noqa: E501', 'NOLINT', '#pragma once', '# noqa', '# type: ignore', '# nolint', '# fmt: off', 'type: ignore', '@generated', '@todo later'))}\n", "plain")],
            lambda: [(f"fn {self.name()}({n()}: Vec<{r.choice(TYPES)}>) -> Option<{r.choice(TYPES)}>\n", "plain")], lambda: [(f"def {self.name()}({n()}: list[{r.choice(TYPES)}], {n()}: {r.choice(TYPES)} | None) -> int:\n", "plain")],
            lambda: [(f"public List<{r.choice(TYPES)}> {self.name()}({r.choice(TYPES)} {n()}, string {n()})\n", "plain")], lambda: [(f"#[inline]\n", "plain"), (f"pub fn {self.name()}(x: &str) -> u32\n", "plain")], lambda: [(f"{n()} {self.name()}\n", "plain")],
            lambda: [(f"(c) 20{r.randint(10, 30)} {n().title()} project, all rights reserved.\n", "plain")], lambda: [(f"source: api/{n()}.proto\n", "plain")], lambda: [(f"[Pure]\n", "plain"), (f"internal int {self.name()}()\n", "plain")],
        ))()

    def plain_line(self) -> list[Piece]:
        r = self.r
        parts = [r.choice((self.sentence, self.sentence, self.notation))() for _ in range(r.randint(1, 4))]
        return [(" ".join(parts) + "\n", "plain")]

    def inline_line(self) -> list[Piece]:
        r = self.r
        parts = [r.choice((self.sentence, self.notation))() for _ in range(r.randint(0, 3))]
        parts.insert(r.randint(0, len(parts)), self.inline())
        return [(" ".join(parts) + "\n", "inline")]


def pages(seed: int, count: int) -> list[tuple[str, list[tuple[int, str]]]]:
    """(text, marks): a mark is an offset and the label of the text from there on."""
    rng = random.Random(seed)
    w = Writer(rng)
    out = []
    for _ in range(count):
        kinds = rng.choice(((w.plain_line,), (w.plain_line, w.bare), (w.plain_line, w.inline_line), (w.fragment, w.plain_line), (w.fragment, w.inline_line, w.plain_line), (w.bare,)))
        text, marks = "", []
        for _ in range(rng.randint(1, 4)):
            for piece, label in rng.choice(kinds)():
                marks.append((len(text), label))
                text += piece
            if rng.random() < 0.4:
                text += "\n"
        out.append((text, marks))
    return out
