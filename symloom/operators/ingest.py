"""Ingest transforms: indexer frames and occurrences become records.

Frames carry ``pos``, their position in the stream: the first sighting wins wherever repeats meet.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom import model

# Wire names of kinds; any other name is a variable.
WIRE_KINDS = {
    "namespace": "namespace", "module": "module", "class": "class", "struct": "struct", "interface": "interface", "enum": "enum", "enum_member": "enum_member", "delegate": "type_alias", "type": "type_alias",
    "constructor": "constructor", "destructor": "destructor", "method": "method", "accessor": "method", "function": "function", "property": "property", "event": "property", "field": "field", "const": "constant", "symbol": "variable",
}
# A comment block with one of these is a licence.
LICENCE_MARKERS = (
    "spdx-license-identifier", "copyright (c)", "copyright ©", "all rights reserved", "licensed under", "apache license", "bsd license", "isc license", "mozilla public license", "eclipse public license",
    "gnu general public license", "gnu lesser general public license", "permission is hereby granted", "subject to the following conditions", "redistribution and use", "redistributions of source code",
    "the software is provided", "without warranty",
)
# Role bits of an occurrence.
DEFINITION, IMPORT, WRITE, READ = 1, 2, 4, 8
ERRORS_LISTED = 32


def first_sightings(frames: DataFrame, key: list[str]) -> DataFrame:
    """The first frame of each key by position; repeats emit nothing. Combined before the shuffle."""
    rest = [c for c in frames.columns if c not in key]
    m = frames.groupBy(*key).agg(F.min_by(F.struct(*rest), "pos").alias("m"))
    return m.select(*key, *(F.col(f"m.{c}").alias(c) for c in rest))


def hex_hash(c: Column) -> Column:
    """A hexadecimal 64-bit hash as the signed number of the same bits; anything else is 0."""
    return F.when(c.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(c, 16, -10).cast("long")).otherwise(F.lit(0).cast("long"))


def intern_files(frames: DataFrame) -> DataFrame:
    """path, language, test, external, content_hash of each path's first frame."""
    f = first_sightings(frames, ["path"])
    return f.withColumn("content_hash", hex_hash(F.col("content_hash")))


def intern_packages(frames: DataFrame) -> DataFrame:
    """name, version, external, id: one row a (name, version), ids in order of first sight from 1."""
    f = first_sightings(frames, ["name", "version"])
    # packages are few against symbols: their order of sight is one sorted pass
    return f.withColumn("id", F.row_number().over(Window.orderBy("pos")).cast("long"))


def resolve_symbols(frames: DataFrame) -> DataFrame:
    """One row a (language, pub_id): its first full frame, else its first stub, which becomes external.

    ``frames``: language, pub_id, stub, external, pos and any payload.
    """
    key = ["language", "pub_id"]
    rest = [c for c in frames.columns if c not in key]
    m = frames.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("stub", "pos")).alias("m"))
    out = m.select(*key, *(F.col(f"m.{c}").alias(c) for c in rest))
    return out.withColumn("external", F.col("external") | F.col("stub"))


def duplicates(frames: DataFrame) -> DataFrame:
    """frame rows with ``verdict``: first, part (another part: a definition only), upgrade (of a stub) or duplicate (its edges are dropped)."""
    w = Window.partitionBy("language", "pub_id").orderBy("pos")
    full = (~F.col("stub")).cast("int")
    seen = F.coalesce(F.sum(full).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    n = F.row_number().over(w)
    verdict = (
        F.when(F.col("stub"), F.when(n == 1, "first").otherwise("duplicate"))
        .when(seen == 0, F.when(n == 1, "first").otherwise("upgrade"))
        .when(F.col("partial"), "part")
        .otherwise("duplicate")
    )
    return frames.withColumn("verdict", verdict)


def build_defs(ranges: DataFrame) -> DataFrame:
    """Store positions from wire ranges (0-based lines): all-zero ranges stay placeholders, a body is optional."""
    r = F.col("range")
    zero = (r[0] == 0) & (r[1] == 0) & (r[2] == 0) & (r[3] == 0)
    up = lambda c: F.when(zero, 0).otherwise(c + 1).cast("int")
    body = lambda i: F.when(F.size("body") >= 2, F.col("body")[i] + 1).otherwise(0).cast("int")
    return ranges.select(
        "sym_id", "file_id", up(r[0]).alias("start_line"), r[1].cast("int").alias("start_col"), up(r[2]).alias("end_line"), r[3].cast("int").alias("end_col"), body(0).alias("body_start_line"), body(1).alias("body_end_line")
    )


def resolve_edges(frames: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """src_id, target_id, kind, field_op: the source must be a symbol, the target a symbol or else a file.

    ``symbols`` and ``files``: ref, id. Unknown kinds and field accesses without a valid operation are dropped.
    """
    kinds = F.create_map(*(F.lit(x) for kv in model.EDGE_KINDS.items() for x in kv))
    ops = F.create_map(*(F.lit(x) for kv in model.FIELD_OPS.items() for x in kv))
    e = frames.withColumn("kind", kinds[F.col("edge_kind")]).withColumn("op", ops[F.col("field_op")]).where("kind is not null")
    e = e.where((F.col("edge_kind") != "field_access") | F.col("op").isNotNull())
    s = symbols.select(F.col("ref").alias("source"), F.col("id").alias("src_id"))
    t = symbols.select(F.col("ref").alias("target"), F.col("id").alias("t_sym"))
    f = files.select(F.col("ref").alias("target"), F.col("id").alias("t_file"))
    j = e.join(s, "source").join(t, "target", "left").join(f, "target", "left").withColumn("target_id", F.coalesce("t_sym", "t_file")).where("target_id is not null")
    return j.select("src_id", "target_id", "kind", F.when(F.col("edge_kind") == "field_access", F.col("op")).alias("field_op"))


def decode_kind(c: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in WIRE_KINDS.items() for x in kv))[c], F.lit("variable"))


def strip_markers(block: Column) -> Column:
    """A comment block without its markers, line by line."""
    t = F.transform(F.split(F.regexp_replace(block, "\r\n", "\n"), "\n"), lambda x: F.regexp_replace(x, r"^\s*(?://!|///|//|/\*\*|/\*|\*/|\*)?", ""))
    t = F.transform(t, lambda x: F.rtrim(F.regexp_replace(F.regexp_replace(x, r"\*/$", ""), "^ ", "")))
    return F.array_join(t, "\n")


def file_docs(blocks: DataFrame) -> DataFrame:
    """file_id, doc: the comment blocks (file_id, blocks) that are no licence, joined by blank lines; none left, no row."""
    kept = F.filter("blocks", lambda b: ~F.exists(F.array(*map(F.lit, LICENCE_MARKERS)), lambda m: F.contains(F.lower(b), m)))
    prose = F.filter(F.transform(kept, strip_markers), lambda x: F.trim(x) != "")
    return blocks.select("file_id", F.array_join(prose, "\n\n").alias("doc")).where("doc <> ''")


def fold_errors(frames: DataFrame) -> DataFrame:
    """language, n_failed, n_warnings, failed: counts, and the first messages of failures."""
    bad = F.col("severity") != "warning"
    rn = F.row_number().over(Window.partitionBy("language", bad.cast("int")).orderBy("pos"))
    listed = frames.withColumn("rn", rn)
    first = F.array_sort(F.collect_list(F.when(bad & (F.col("rn") <= ERRORS_LISTED), F.struct("pos", "message"))))  # at most 32 an entry
    return listed.groupBy("language").agg(
        F.sum(bad.cast("long")).alias("n_failed"), F.sum((~bad).cast("long")).alias("n_warnings"), F.array_join(F.transform(first, lambda x: x.message), "|").alias("failed")
    )


def smallest_enclosing(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """points (file_id, pt, line, col) with the symbol of the smallest range that holds each; ties to the smaller symbol.

    The interval join is bound to the file and to blocks of lines, so a file that holds a large share of all
    ranges is spread over its blocks.
    """
    block = 256
    r = ranges.select("file_id", "sym", "sl", "sc", "el", "ec").where("el >= sl")
    r = r.withColumn("blk", F.explode(F.sequence(F.floor(F.col("sl") / block), F.floor(F.col("el") / block))))
    p = points.withColumn("blk", F.floor(F.col("line") / block))
    hit = p.join(r, ["file_id", "blk"]).where("line between sl and el and not (line = sl and col < sc) and not (line = el and col > ec)")
    size = F.when(F.col("el") == F.col("sl"), F.col("ec") - F.col("sc")).otherwise((F.col("el") - F.col("sl")).cast("long") * 1_000_000 + F.col("ec") - F.col("sc"))
    return hit.groupBy("file_id", "pt", "line", "col").agg(F.min(F.struct(size.alias("size"), "sym")).alias("m")).select("file_id", "pt", "line", "col", F.col("m.sym").alias("owner"))


def classify_edge(roles: Column, symbol: Column, target_kind: Column) -> Column:
    """Edge kind of an occurrence: write, import, read of data, else a type use that its target's kind may raise."""
    has = lambda bit: roles.bitwiseAND(F.lit(bit)) != 0
    data = F.when(symbol.rlike(r"[.#/)\]!:]$"), symbol.endswith(".") & ~symbol.contains("().")).otherwise(F.lit(True))
    call = target_kind.isin("method", "function") | (symbol.endswith(".") & symbol.contains("()."))
    return (
        F.when(has(WRITE), "field_access").when(has(IMPORT), "imports").when(has(READ) & data, "field_access")
        .when(target_kind.isin("method", "function"), "calls").when(target_kind == "constructor", "instantiates").when(call, "calls").otherwise("type_use")
    )


def derive_edges(occurrences: DataFrame, ranges: DataFrame, targets: DataFrame) -> DataFrame:
    """src, target, kind: distinct edges from the smallest definition around each occurrence.

    ``occurrences``: file_id, pt, line, col, symbol, roles. Definitions and local symbols make no edge, nor do
    targets defined more than once (``targets``: symbol, def_count, kind) and references to oneself.
    """
    o = occurrences.where((F.col("roles").bitwiseAND(F.lit(DEFINITION)) == 0) & ~F.col("symbol").startswith("local "))
    o = o.join(targets.where("def_count <= 1"), "symbol")
    owned = smallest_enclosing(o.select("file_id", "pt", "line", "col"), ranges)
    j = o.join(owned.select("file_id", "pt", "owner"), ["file_id", "pt"]).where("owner <> symbol")
    return j.select(F.col("owner").alias("src"), F.col("symbol").alias("target"), classify_edge(F.col("roles"), F.col("symbol"), F.col("kind")).alias("kind")).distinct()


def kind_of_descriptor(symbol: Column) -> Column:
    """Kind by the last sign of a descriptor."""
    return (
        F.when(symbol.rlike(r"\(\+?\d*\)\.$"), "method").when(symbol.endswith("/"), "namespace").when(symbol.endswith("#"), "class").when(symbol.endswith("."), "field")
        .when(symbol.endswith("]"), "type_parameter").when(symbol.endswith(")"), "parameter").when(symbol.endswith(":"), "constant").when(symbol.endswith("!"), "macro").otherwise("variable")
    )


# Numbers of symbol kinds in the occurrence format.
NUMBERED_KINDS = {
    7: "class", 8: "constant", 9: "constructor", 11: "enum", 12: "enum_member", 13: "variable", 15: "field", 17: "function", 21: "interface", 25: "macro", 26: "method", 29: "module", 30: "namespace",
    34: "operator", 35: "package", 37: "parameter", 41: "property", 49: "struct", 53: "trait", 55: "type_alias", 56: "type_alias", 60: "type_parameter", 63: "variable", 66: "method", 70: "method", 72: "method",
}


def kind_of(number: Column, symbol: Column) -> Column:
    """Kind by the number of its symbol, else by the last sign of its descriptor."""
    table = F.create_map(*(F.lit(x) for pair in NUMBERED_KINDS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, number.cast("int")), kind_of_descriptor(symbol))


def test_path(path: Column, globs: tuple[str, ...]) -> Column:
    """Whether a path matches one of the globs: ** crosses directories, * and ? do not."""
    hit = F.lit(False)
    for g in globs:
        pattern = "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(x, re.escape(x)) for x in re.split(r"(\*\*/|\*\*|\*|\?)", g) if x)
        hit = hit | path.rlike(f"^{pattern}$")
    return F.coalesce(hit, F.lit(False))


def is_test_symbol(language: Column, kind: Column, pub_id: Column) -> Column:
    """Whether a public id names test code, by the conventions of its language."""
    native = F.regexp_extract(pub_id, r"^[^:]+:(.*)$", 1)
    rust = F.transform(F.split(native, "::"), lambda s: F.regexp_replace(s, "[/.#]+$", ""))
    marks = F.array(*map(F.lit, ("tests", "test", "bench", "benches")))
    inner = F.arrays_overlap(F.slice(rust, F.lit(1), F.greatest(F.size(rust) - 1, F.lit(0))), marks)
    leaf = F.array_contains(marks, F.element_at(rust, -1)) & kind.isin(*model.SCOPES)
    go = F.exists(F.split(native, "[/.]"), lambda s: s.endswith("_test") | s.isin("tests", "test"))
    py, last = F.split(native, r"\."), F.element_at(F.split(native, r"\."), -1)
    above = F.slice(py, F.lit(1), F.greatest(F.size(py) - 1, F.lit(0)))
    named = lambda s: s.isin("tests", "test", "__tests__") | s.endswith("_test")
    python = (
        F.exists(above, named) | F.exists(py, lambda s: s.startswith("test_")) | (named(last) & kind.isin(*model.SCOPES)) | (last == "conftest")
        | (kind.isin(*model.CLASS_LIKE) & (last.startswith("Test") | last.endswith("Test") | last.endswith("TestCase")))
    )
    return F.when(language == "rust", inner | leaf).when(language == "go", go).when(language == "python", python).otherwise(F.lit(False))


def merge_runs(rows: DataFrame) -> DataFrame:
    """language, pub_id, first_path, n_paths, collides: the first symbol of each id over runs; ids defined in several paths collide."""
    g = rows.groupBy("language", "pub_id").agg(F.min_by("path", "pos").alias("first_path"), F.countDistinct("path").alias("n_paths"))
    return g.withColumn("collides", F.col("n_paths") > 1)


def impl_edges(impls: DataFrame, names: DataFrame) -> DataFrame:
    """src, dst of implementations whose type and trait each have one candidate in their document."""
    one = names.groupBy("doc", "name").agg(F.countDistinct("sym").alias("n"), F.min("sym").alias("sym")).where("n = 1").select("doc", "name", "sym")
    j = impls.join(one.select("doc", F.col("name").alias("type_name"), F.col("sym").alias("src")), ["doc", "type_name"])
    return j.join(one.select("doc", F.col("name").alias("trait_name"), F.col("sym").alias("dst")), ["doc", "trait_name"]).select("src", "dst").distinct()
