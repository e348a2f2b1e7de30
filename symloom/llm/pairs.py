"""Functions paired with their documentation, leaving out documentation that says nothing.

A qualified symbol table (id, qualified name, name, kind) is built over all files; every documented
declaration is reduced to a normalised signature (name and parameter types) and joined through the
qualified name with the definitions, which may stand in other files. An overload is told by its
signature; a documentation row without a declaration speaks for all overloads of its symbol. The
filter comes last: what is left of a comment after delimiters, notices, directives, pointers and code
are taken out is kept if it has a word that neither the name nor the declaration nor a word list of
empty phrases has.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.markup import TAG, tag_name
from symloom.runtime import Scratch

KINDS = ("function", "method", "constructor", "destructor", "operator")

_BLOCK = re.compile(r"/\*.*?\*/|\"\"\".*?\"\"\"|'''.*?'''|<!--.*?-->", re.S)
_LINE = re.compile(r"^[ \t]*(?:///?!?|#(?![\[!\w])|--(?=\s)|;;)[^\n]*$", re.M)
_DIRECTIVE_LINE = re.compile(r"^[ \t]*#(?:pragma|region|endregion|nullable)\b[^\n]*$", re.M)
_LEADER = re.compile(r"^\s*(?:/\*+!?|\*+/|///?!?|\*(?!\*)|#(?!\w)|--(?=\s)|;;+|\"\"\"|''')\s?|\s*(?:\*+/|\"\"\"|''')\s*$")
_DOC_TAG = re.compile(r"\{@\w+\s*\}")
_SEPARATOR = re.compile(r"^\W*([-=/#*~_])\1{2,}.*\1{2,}\W*$")
_PARAM = re.compile(r"^\s*(?:[@\\](?:param|arg|tparam|typeparam)\s+(?:\{[^}]*\}\s*)?|:(?:param|arg|type)\s+)(\w+)\s*:?\s*-?\s*(.*)$", re.I)
_RETURN = re.compile(r"^\s*(?:[@\\](?:returns?|throws|raises|yields)\b|:(?:returns?|rtype|raises|yields)\s*\w*:)\s*(.*)$", re.I)
_SECTION = re.compile(r"^\s*(?:args|arguments|parameters|params|returns|raises|yields|attributes|example|examples|note)\s*:\s*$", re.I)
_ENTRY = re.compile(r"^\s*\*{0,2}(\w+)(?:\s*\([^)]*\))?\s*:\s+(.*)$")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_TOKEN = re.compile(r"[^\W\d_]+|\d+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")

# Lines that are notices, licences, directives or placeholders.
NOTICE = re.compile(
    r"\bauto[- ]?generated\b|\bcode generated\b|\bgenerated (?:by|from|with|using|code|file)\b|@generated|\bwas generated\b|\bdo not edit\b|\bdo not modify\b"
    r"|\bwritten by a tool\b|\bchanges (?:to this file )?(?:will be|are) lost\b|^\s*tool version\s*:|^\s*(?:input|source)\s*:\s*\S+\s*$"
    r"|\bcopyright\b|\(c\)\s*\d{4}|©|\bspdx-|\blicen[cs]ed under\b|\ball rights reserved\b|\byou may not use this file\b|\bsee the licen[cs]e file\b|\bpermission is hereby granted\b|\bwithout (?:any )?warrant"
    r"|\bthis file is part of\b|\bmay be (?:used|copied|redistributed)\b.*\bunder\b|\bterms of the\b.*\blicen[cs]e\b|\bsee the file (?:copying|licen[cs]e)\b"
    r"|\bexcept (?:as it allows|in compliance)\b",
    re.I,
)
# Every notice holds one of these; texts without them, nearly all, need no search.
NOTICE_HINTS = ("generated", "do not", "written by", "lost", "tool version", "input", "source", "copyright", "(c)", "©", "spdx", "licen", "rights", "may not", "permission", "warrant", "part of", "may be", "copying", "except")
DIRECTIVE = re.compile(
    r"^\W*(?:noqa\b|nolint\b|nosec\b|type:\s*ignore|eslint-|tslint:|jshint\b|prettier-ignore|rustfmt::|clippy::|allow\(|pylint:|flake8:|mypy:|pragma\b|#pragma\b|@ts-|@suppress|swiftlint:|clang-format|istanbul ignore|c8 ignore|checkstyle:|resharper\b|go:\w+|\+build\b|fmt:\s*(?:on|off|skip)|isort:|coverage:|region\b|endregion\b|vim:|-\*-)",
    re.I,
)
PLACEHOLDER = re.compile(
    r"^\W*(?:(?:@?todo|fixme|xxx|tbd|wip|hack)\b.*|n/?a|none|nil|null|undocumented|no (?:documentation|description|docs|comment|summary)(?: (?:available|provided|yet|given))?|(?:description|documentation|summary|comment|docs?|text)(?: (?:goes |is )?(?:here|missing|needed|pending))?|missing (?:documentation|docs?|description)|add (?:documentation|docs?|description)(?: here)?|lorem ipsum.*|placeholder|stub|method stub|to be (?:documented|done|written|determined)|inherited|inherit ?doc|as above|see above|see below|ditto|same as (?:above|below))\W*$",
    re.I,
)
POINTER = re.compile(r"^\W*(?:see(?: also)?|refer to|cf|inherited from|inherits from|same as|overrides|implements|defined in|documented in)\b[^.!?]*(?:\.\w[^.!?]*)*[.!?]?\s*$", re.I)
# Words by which a sentence gives a reason, a condition or a limit and so tells more than where to look.
REASON = re.compile(r"\b(?:so|because|why|when(?:ever)?|if|unless|until|till|while|since|before|after|once|but|otherwise|instead|except|only|never|always|must|cannot|not)\b", re.I)
# Words that mark a text as one still to be written, and those that may stand beside them.
FILLER = frozenset("placeholder todo fixme tbd wip bla blah lorem ipsum foo bar baz dummy".split())
BESIDE_FILLER = frozenset("text later replace fill write add describe me here now soon please some more goes real actual content words sentence doc docs dolor sit amet".split())
CODE = re.compile(
    r"[;{}]\s*$|^\s*(?:let|var|const|return|import|from|use|using|package|else|elif)\b.*[=;(){}]|^\s*(?:if|for|while|switch|match)\s*\(.*\)\s*\{?\s*$|^\s*\w+(?:[.:]{1,2}\w+)*\s*(?:[-+*/]?=)\s*\S.*[;)]\s*$"
    r"|^\s*[\w.:]+\([^()]*\)\s*$|^\s*(?:pub(?:\(\w+\))?\s+|public\s+|private\s+|protected\s+|internal\s+|static\s+|export\s+|async\s+|override\s+|virtual\s+)*(?:fn|def|func|function|class|struct|enum|trait|interface|namespace|mod|module|property|field|case|const|constant|variable|type_alias|enum_member)\s+[\w~:.]+\s*(?:[(<:{].*)?$|^\s*#\[.*\]\s*$|^\s*@\w+\s*$|^\s*\[\w+\]\s*$",
)
# Words that a restatement may add to the name without saying more.
EMPTY_WORDS = frozenset(
    "a an the this that these it its is are be does do did to of for from in on with by and or as "
    "method function func fn constructor destructor operator procedure routine member class struct enum trait property field case mod module namespace const constant variable type alias interface "
    "return returns result value values object instance given param parameter params argument arguments arg args self default "
    "get gets getter set sets setter comment documentation description helper implementation wrapper which".split()
)


def notice(text: str) -> bool:
    low = text.lower()
    return any(h in low for h in NOTICE_HINTS) and NOTICE.search(text) is not None


@lru_cache(maxsize=100_000)
def stem(w: str) -> str:
    """A word without its inflection, enough to match a name's verb."""
    w = w.lower()
    for end in ("ing", "ies", "es", "ed", "s"):
        if w.endswith(end) and len(w) - len(end) >= 3:
            w = w[: -len(end)]
            break
    if len(w) > 3 and w[-1] == w[-2] and w[-1] not in "aeioul":
        w = w[:-1]
    return w.rstrip("ey") or w


def tokens(text: str) -> list[str]:
    """Words of text or code, identifiers taken apart at case changes and underscores."""
    return [p for t in _TOKEN.findall(text) for p in ((t,) if t[1:].islower() or t.isdigit() else _CAMEL.split(t))]


def split_declaration(sig: str | None) -> tuple[str, str]:
    """The declaration and the comments of a signature text, wherever they stand in it."""
    if not sig:
        return "", ""
    said = _BLOCK.findall(sig)
    rest = _BLOCK.sub("\n", sig)
    for pattern in (_DIRECTIVE_LINE, _LINE):
        said += pattern.findall(rest)
        rest = pattern.sub("", rest)
    return "\n".join(x for x in rest.split("\n") if x.strip()).strip(), "\n".join(said)


def _squeeze(x: str) -> str:
    return re.sub(r"\s+", " ", x).strip()


def normal_signature(declaration: str) -> str:
    """Name and parameter types: overloads differ in it, redeclarations do not."""
    text = _squeeze(re.sub(r"^(?:\s*(?:#\[[^\]]*\]|@\w+(?:\([^)]*\))?|\[\w+\]))+", "", declaration))
    m = re.search(r"([~\w]+)\s*(?:<[^()]*>)?\s*\((?P<p>.*)\)", text[text.find(")") + 1 :] if text.startswith("func (") else text)
    if not m:
        return text.rstrip("{;: ").split(" ")[-1] if text else ""
    parts, depth, cur = [], 0, ""
    for c in m["p"]:
        depth += (c in "<([{") - (c in ">)]}")
        if c == "," and depth == 0:
            parts.append(cur)
            cur = ""
        else:
            cur += c
        if depth < 0:
            break
    parts.append(cur)
    kinds = []
    for p in (_squeeze(p.split("=")[0].rstrip(")")) for p in parts):
        if p and p not in ("self", "&self", "&mut self"):
            kinds.append(p.split(":", 1)[1].strip() if ":" in p else p.rsplit(" ", 1)[0] if " " in p else p)
    return f"{m[1]}({','.join(kinds)})"


def statements(text: str, declaration: str) -> list[str]:
    """What a comment states, sentence by sentence, without everything that tells nothing by its form."""
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\ufeff", "")
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if declaration:
        flat = _squeeze(declaration)
        if flat and flat in _squeeze(text):
            text = re.sub(r"\s+".join(map(re.escape, flat.split(" "))), "\n", text)
    out: list[str] = []
    part: list[str] = []
    known: set[str] = set()
    in_section = fenced = False

    def flush() -> None:
        for s in _SENTENCE.split(" ".join(part)):
            if s and not PLACEHOLDER.match(s) and not notice(s) and not filler(s) and (not POINTER.match(s) or REASON.search(s)):
                out.append(s)
        part.clear()

    for raw in text.split("\n"):
        if _SEPARATOR.match(raw):
            flush()
            continue
        line = raw
        while (cut := _LEADER.sub("", line)) != line:
            line = cut
        if "<" in line:
            line = TAG.sub(lambda m: " " if tag_name(m, line) else m[0], line)
        line = _DOC_TAG.sub(" ", line)
        if line.lstrip().startswith("```"):
            fenced = not fenced
            continue
        if not line.strip():
            flush()
            in_section = in_section and not raw.strip()
            continue
        if fenced or notice(line) or DIRECTIVE.match(line) or PLACEHOLDER.match(line) or CODE.search(line):
            flush()
            continue
        if not re.search(r"\w", line) or _SEPARATOR.match(line):
            flush()
            continue
        if _SECTION.match(line):
            flush()
            in_section = True
            continue
        m = _PARAM.match(line)
        if m is None and in_section:
            m = _ENTRY.match(line)
        if m:
            flush()
            known.update(stem(x) for x in tokens(m[1]))
            said = m[2]
        elif (r := _RETURN.match(line)) is not None:
            flush()
            said = r[1]
        elif in_section and len(line.split()) <= 2:
            flush()
            said = line
        else:
            part.append(line.strip())
            continue
        if adds(said, known):
            out.append(said.strip())
    flush()
    return out


def filler(text: str) -> bool:
    """Whether a sentence only holds the place of one: a word of filler, and no word that is more."""
    said = {t.lower() for t in tokens(text)} - EMPTY_WORDS
    return not said.isdisjoint(FILLER) and said <= FILLER | BESIDE_FILLER


def adds(text: str, known: set[str]) -> bool:
    """Whether some word is neither known nor empty."""
    return any(t.lower() not in EMPTY_WORDS and stem(t) not in known for t in tokens(text) if not t.isdigit())


def pair(name: str | None, sig: str | None, doc: str | None) -> tuple[str, str, str]:
    """declaration, normalised signature and description; an empty description tells nothing."""
    declaration, said = split_declaration(sig)
    known = {stem(t) for t in tokens(f"{name or ''} {declaration}")}
    kept = [s for x in (said, doc) if x for s in statements(x, declaration) if adds(s, known)]
    return declaration, normal_signature(declaration), "\n".join(dict.fromkeys(kept))


def function_table(symbols: DataFrame) -> DataFrame:
    """sym_id, name, qualified: the functions and methods, one row an id (its newest row)."""
    rows = symbols.where("id is not null").groupBy("id").agg(F.max(F.struct("loaded_at", "kind", "name", "pub_id")).alias("m"))
    rows = rows.where(F.col("m.kind").isin(*KINDS))
    # the ordinal after ~ tells overloads apart and is no part of the qualified name
    return rows.select(
        F.col("id").alias("sym_id"), F.col("m.name").alias("name"), F.regexp_replace("m.pub_id", r"~\d+$", "").alias("qualified")
    )


def declared(symbols: DataFrame, docs: DataFrame) -> DataFrame:
    """sym_id, qualified, name, declaration, norm_sig, description of all documentation rows; an empty description tells nothing.

    Repeated rows are reduced before the join, so a symbol with very many rows is no hot key of the join.
    Rows of unknown symbols are left out.
    """
    rows = docs.where("sym_id is not null").select("sym_id", "sig", "doc").distinct()
    joined = rows.join(function_table(symbols), "sym_id").select("sym_id", "qualified", "name", "sig", "doc")
    schema = "sym_id long, qualified string, name string, declaration string, norm_sig string, description string"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [pair(*r) for r in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)))]
            cols = [pa.array([g[i] for g in got], pa.string()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), *cols], ["sym_id", "qualified", "name", "declaration", "norm_sig", "description"]
            )

    return joined.mapInArrow(read, schema)


def documented(symbols: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of :func:`declared` that tell something; null and blank texts tell nothing."""
    return declared(symbols, docs).where("description <> ''")


def function_pairs(symbols: DataFrame, docs: DataFrame, defs: DataFrame, files: DataFrame) -> DataFrame:
    """sym_id, qualified, norm_sig, declaration, description, def_id, path, body_start_line, body_end_line, n_definitions.

    Each documented declaration with its definitions. Declarations and definitions meet in classes of one
    qualified name and one normalised signature, by all declarations of a symbol, undocumented ones included.
    Where a symbol has no signature, it takes that of its name, if the name has no two of them; with several
    it belongs to none. A declaration has a row for its own definition, if placed, and one for its class if that
    is led by another symbol: the leader is the class's newest definition, ``n_definitions`` the class's size,
    and its members are the symbols of that name and signature, so copies are not expanded into all pairs. A
    declaration without any placed definition has one row with nulls. The newest placed definition of a symbol counts.
    """
    scratch = Scratch(docs.sparkSession, "pairs")
    rows = declared(symbols, docs).groupBy("sym_id", "qualified", "norm_sig").agg(F.max(F.struct(F.length("description"), "description", "declaration")).alias("m"))
    rows = scratch.save(rows.select("sym_id", F.col("qualified").alias("q"), "norm_sig", F.col("m.description").alias("description"), F.col("m.declaration").alias("declaration")))
    placed = defs.where("sym_id is not null and start_line > 0").groupBy("sym_id").agg(
        F.max(F.struct("loaded_at", "file_id", "body_start_line", "body_end_line")).alias("p")
    )
    paths = files.where("id is not null").groupBy("id").agg(F.max(F.struct("loaded_at", "path")).alias("f")).select(F.col("id").alias("fid"), "f.path")
    names = function_table(symbols).select(F.col("sym_id").alias("def_id"), F.col("qualified").alias("q"))
    where = names.join(placed, names.def_id == placed.sym_id).select("def_id", "q", "p.*")
    where = where.join(paths, where.file_id == paths.fid, "left").select("def_id", "q", "loaded_at", "path", "body_start_line", "body_end_line")
    where = scratch.save(where)

    sigs = rows.where("norm_sig <> ''").select(F.col("sym_id").alias("of"), F.col("norm_sig").alias("sig"))
    sole = rows.where("norm_sig <> ''").groupBy("q").agg(F.min("norm_sig").alias("low"), F.max("norm_sig").alias("high"))

    def resolved(side: DataFrame) -> DataFrame:
        """``sig`` of rows (q, sig): that of the name where there is none; no row where the name has several."""
        one = F.when(F.col("low").isNull(), "").when(F.col("low") == F.col("high"), F.col("low"))
        return side.join(sole, "q", "left").withColumn("sig", F.coalesce("sig", one)).where("sig is not null").drop("low", "high")

    at = ["loaded_at", "def_id", "path", "body_start_line", "body_end_line"]
    members = resolved(where.join(sigs, where.def_id == sigs.of, "left").drop("of"))
    classes = members.groupBy("q", "sig").agg(F.max(F.struct(*at)).alias("lead"), F.count(F.lit(1)).cast("int").alias("n_definitions"))
    told = rows.select("sym_id", "q", "norm_sig")
    bare = told.where("norm_sig = ''").join(sigs, F.col("sym_id") == F.col("of"), "left").drop("of")
    told = resolved(told.where("norm_sig <> ''").withColumn("sig", F.col("norm_sig")).unionByName(bare))
    led = told.join(classes, ["q", "sig"]).where("lead.def_id <> sym_id").select("sym_id", "norm_sig", "lead.def_id", "lead.path", "lead.body_start_line", "lead.body_end_line", "n_definitions")
    own = rows.select("sym_id", "norm_sig").join(where, F.col("sym_id") == F.col("def_id"))
    own = own.select("sym_id", "norm_sig", *at[1:], F.lit(None).cast("int").alias("n_definitions"))
    found = own.unionByName(led).distinct()
    # the filter comes last: declarations that tell nothing have served to tell overloads apart
    out = rows.join(found, ["sym_id", "norm_sig"], "left").where("description <> ''")
    return out.select("sym_id", F.col("q").alias("qualified"), "norm_sig", "declaration", "description", *at[1:], "n_definitions")
