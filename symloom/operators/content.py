"""Content producers: joins that turn parsed texts into graded edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symloom.functions import parsers as ps
from symloom.functions.identifiers import basename, dirname, join_path
from symloom.runtime import Scratch

SQL_WORDS = r"(?i)\b(select|insert|update|delete|create|alter|drop|merge|with)\b"
SQL_LEAST = 12
# Endings of media files.
MEDIA = ("png", "jpg", "jpeg", "gif", "svg", "webp", "ico", "bmp", "mp3", "mp4", "wav", "webm", "ogg", "pdf", "woff", "woff2", "ttf")


def looks_like_sql(c: Column) -> Column:
    """A whole-word verb in a text of twelve signs at least: the filter before any parse."""
    return (F.length(c) >= SQL_LEAST) & c.rlike(SQL_WORDS)


def chunks(docs: DataFrame, target: int = 1_000, overlap: int = 150) -> DataFrame:
    """key, ordinal, chunk, first_line, last_line of (key, text)."""
    return ps.flat_map(docs, lambda t: ps.split_text(t, target, overlap), "key long, ordinal int, chunk string, first_line int, last_line int")


def text_graph(chunk_rows: DataFrame, docs: DataFrame) -> DataFrame:
    """src, dst, kind of documents (key, path) and their chunks, named stem#ordinal."""
    stem = F.regexp_replace(basename(F.col("path")), r"\.[^.]*$", "")
    c = chunk_rows.select("key", "ordinal").join(docs.select("key", stem.alias("stem")), "key")
    node = F.concat("stem", F.lit("#"), "ordinal")
    return c.select(F.col("key").cast("string").alias("src"), node.alias("dst"), F.lit("contains").alias("kind")).unionByName(
        c.select(node.alias("src"), F.col("key").cast("string").alias("dst"), F.lit("defined_in").alias("kind"))
    )


def common_dirs(a: Column, b: Column) -> Column:
    """Number of leading directories that two paths share."""
    x, y = F.split(dirname(a), "/"), F.split(dirname(b), "/")
    same = F.zip_with(x, y, lambda p, q: (p == q) & p.isNotNull() & (p != ""))
    return F.aggregate(same, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, e: F.struct((s.n + F.when(s.on & F.coalesce(e, F.lit(False)), 1).otherwise(0)).alias("n"), (s.on & F.coalesce(e, F.lit(False))).alias("on"))).n


def resolve_links(found: DataFrame, docs: DataFrame, names: DataFrame, anchors: DataFrame) -> DataFrame:
    """key, line, target, anchor, dst, grade: wiki and inline links to documents, by the first tier that answers.

    ``found``: key, path, line, kind, target, anchor; ``docs``: id, path; ``names``: id, name, what (alias, title);
    ``anchors``: id, slug. Wiki links try path, stem, alias, title; inline links the path as written, then from
    the source's directory (both exact), then equal stems: those whose path ends in the target, then the nearest
    (drifted). Several left are ambiguous and all kept; none is dangling. A missing anchor worsens exact to drifted.
    """
    stem = lambda p: F.lower(F.regexp_replace(basename(p), r"\.[^.]*$", ""))
    d = docs.select(F.col("id").alias("dst"), F.lower("path").alias("p"), stem(F.col("path")).alias("s"), F.col("path").alias("dpath"))
    links = found.distinct().withColumn("n", F.struct("key", "line", "kind", "target", "anchor"))
    t = F.lower("target")
    bare = F.regexp_replace(t, r"\.md$", "")
    wiki = links.where(F.col("kind").isin("wiki", "embed"))
    tiers = [
        wiki.select("n", F.explode(F.array(t, F.concat(t, F.lit(".md")))).alias("p")).join(d, "p").select("n", "dst", F.lit(0).alias("tier")),
        wiki.withColumn("s", bare).join(d, "s").select("n", "dst", F.lit(1).alias("tier")),
    ]
    for at, what in ((2, "alias"), (3, "title")):
        nm = names.where(F.col("what") == what).select(F.col("id").alias("dst"), F.lower("name").alias("nm"))
        tiers.append(wiki.withColumn("nm", t).join(nm, "nm").select("n", "dst", F.lit(at).alias("tier")))
    inline = links.where(F.col("kind").isin("link", "image"))
    tiers.append(inline.withColumn("p", t).join(d, "p").select("n", "dst", F.lit(0).alias("tier")))
    tiers.append(inline.withColumn("p", F.lower(join_path(dirname(F.col("path")), F.col("target")))).join(d, "p").select("n", "dst", F.lit(1).alias("tier")))
    near = inline.withColumn("s", stem(F.col("target"))).join(d, "s")
    clean = F.regexp_replace(t, r"^(\.\.?/)+", "")
    score = F.when(F.col("p").endswith(F.concat(F.lit("/"), clean)) | (F.col("p") == clean), 1_000).otherwise(0) + common_dirs(F.col("path"), F.col("dpath"))
    near = near.withColumn("score", score)
    best = near.groupBy("n").agg(F.max("score").alias("score"))
    tiers.append(near.join(best, ["n", "score"]).select("n", "dst", F.lit(5).alias("tier")))
    hits = tiers[0]
    for x in tiers[1:]:
        hits = hits.unionByName(x)
    hits = hits.distinct()
    first = hits.groupBy("n").agg(F.min("tier").alias("tier"))
    hits = hits.join(first, ["n", "tier"])
    count = hits.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    j = links.join(hits, "n", "left").join(count, "n", "left")
    j = j.join(anchors.select(F.col("id").alias("dst"), F.col("slug").alias("anchor"), F.lit(True).alias("has")).distinct(), ["dst", "anchor"], "left")
    grade = (
        F.when(F.col("dst").isNull(), "dangling").when(F.col("k") > 1, "ambiguous")
        .when((F.col("tier") == 5) | ((F.col("anchor") != "") & F.col("has").isNull()), "drifted").otherwise("exact")
    )
    return j.select("key", "line", "kind", "target", "anchor", "dst", grade.alias("grade"))


def resolve_code(refs: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """key, ref, what (file, symbol), dst, grade: code spans of prose against files and symbols.

    A ref with a dot-suffixed path goes to files of its basename, one that equals the ref first; any other to
    symbols of its last name part, narrowed by the qualifier before it. More than one left is ambiguous.

    What a ref means is settled once for each text, not for each key: its own hits, else all of its name. Only
    these are joined to the keys, so no more pairs are made than there are rows of the result.
    """
    scratch = Scratch(refs.sparkSession, "refs")
    asked = scratch.save(refs.select("key", "ref").where("ref is not null").distinct(), "asked")
    path_like = F.col("ref").contains("/") | F.col("ref").rlike(r"\.[a-z]{1,4}$")
    parts = F.split("ref", r"::|\.|#")
    one = asked.select("ref").distinct()
    words = one.where(~path_like).withColumn("name", F.lower(F.element_at(parts, -1))).withColumn("qual", F.when(F.size(parts) > 1, F.lower(F.element_at(parts, -2))))
    s = symbols.select(F.col("id").alias("dst"), F.col("name_lower").alias("name"), F.lower("pub_id").alias("pub"))
    s = scratch.save(s.join(words.select("name").distinct(), "name", "left_semi"), "symbols")
    f = files.where("path is not null").select(F.col("id").alias("dst"), "path")
    # every ending of a path by equality: the whole path is place 0
    dirs = F.split("path", "/")
    ends = f.select("dst", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(dirs)), lambda i: F.array_join(F.slice(dirs, i, F.size(dirs)), "/"))).alias("tier", "ref"))
    near = one.where(path_like).join(ends, "ref").groupBy("ref", "dst").agg(F.least(F.min("tier"), F.lit(1)).alias("tier"))
    near = near.join(near.groupBy("ref").agg(F.min("tier").alias("tier")), ["ref", "tier"]).select("ref", F.lit("file").alias("what"), "dst", "tier")
    named = words.where("qual is not null").join(s, "name").where(F.col("pub").contains(F.col("qual"))).select("ref", F.lit("symbol").alias("what"), "dst", F.lit(0).alias("tier")).distinct()
    hits = scratch.save(near.unionByName(named), "hits")
    wide = s.select("name", F.lit("symbol").alias("what"), "dst").unionByName(f.select(basename(F.col("path")).alias("name"), F.lit("file").alias("what"), "dst")).distinct()
    targets = hits.select(F.lit("ref").alias("via"), F.col("ref").alias("name"), "what", "dst", "tier").unionByName(wide.select(F.col("what").alias("via"), "name", "what", "dst", F.lit(2).alias("tier")))
    own = hits.select("ref", F.lit(True).alias("own")).distinct()
    via = F.when(F.col("own"), "ref").when(path_like, "file").otherwise("symbol")
    name = F.when(F.col("own"), F.col("ref")).when(path_like, basename(F.col("ref"))).otherwise(F.lower(F.element_at(parts, -1)))
    asked = asked.join(one.join(own, "ref", "left").select("ref", via.alias("via"), name.alias("name")), "ref")
    out = blocked_join(asked, targets, ["via", "name"], scratch, "k")
    return out.select("key", "ref", "what", "dst", F.when(F.col("k") > 1, "ambiguous").when(F.col("tier") == 0, "exact").otherwise("drifted").alias("grade"))


def blocked_join(left: DataFrame, right: DataFrame, on: list[str], scratch: Scratch, count: str, rows: int = 1_000_000) -> DataFrame:
    """Inner join of few rows into many, with the number of right rows of the key as ``count``.

    The rows of ``left`` of a key are dealt to blocks of about ``rows`` pairs, to each of which its right rows are
    sent, and blocks to as many tasks as there are: sizes before a join say nothing of what comes out of it.
    """
    sizes = left.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).join(right.groupBy(*on).agg(F.count(F.lit(1)).alias(count)), on)
    pairs = F.col("__n") * F.col(count)
    sizes = scratch.save(sizes.withColumn("__blocks", F.least(F.col("__n"), F.ceil(pairs / rows))), "sizes")
    tasks = max(left.sparkSession.sparkContext.defaultParallelism, -(-(sizes.agg(F.sum(pairs)).collect()[0][0] or 0) // rows))
    dealt = left.join(sizes.select(*on, "__blocks"), on).withColumn("__block", F.pmod(F.xxhash64(*(c for c in left.columns if c not in on)), F.col("__blocks"))).drop("__blocks")
    sent = right.join(sizes.drop("__n"), on).withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__blocks") - 1))).drop("__blocks")
    by = [*on, "__block"]
    return dealt.repartition(tasks, *by).join(sent.repartition(tasks, *by), by).drop("__block")


def mine_usage(tokens: DataFrame, classes: DataFrame, utilities: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, name, dst, grade) of tokens (key, token, marked) that are classes (id, name), and marked names without any."""
    n = classes.groupBy("name").agg(F.countDistinct("id").alias("k"))
    t = tokens.groupBy("key", F.col("token").alias("name")).agg(F.max(F.col("marked").cast("int")).alias("m"))
    hit = t.join(classes.select(F.col("id").alias("dst"), "name").distinct(), "name").join(n, "name")
    grade = F.when(F.col("k") > 1, "ambiguous").when(F.col("m") == 1, "exact").otherwise("fuzzy")
    lost = t.where("m = 1").join(n, "name", "left_anti")
    if utilities is not None:
        lost = lost.join(utilities.select("name").distinct(), "name", "left_anti")
    return hit.select("key", "name", "dst", grade.alias("grade")), lost.select("key", "name")


def element_ids(elements: DataFrame) -> DataFrame:
    """key, ordinal, owner: the nearest element with an id at or above each element (-1: the document), by doubling."""
    scratch = Scratch(elements.sparkSession, "elements")
    return _owners(scratch.save(elements.select("key", "ordinal", "parent", "id"), "elements"), scratch)


def _owners(e: DataFrame, scratch: Scratch) -> DataFrame:
    """As :func:`element_ids`, of written elements. Each round goes twice as far up and is written, so that plans stay
    short and nothing is parsed again; only elements still on their way are joined."""
    cur = e.select("key", "ordinal", F.when(F.col("id").isNotNull(), F.col("ordinal")).alias("owner"), F.when(F.col("id").isNull(), F.col("parent")).alias("up"))
    going = F.col("owner").isNull() & F.col("up").isNotNull()
    while not cur.where(going).isEmpty():
        b = cur.select("key", F.col("ordinal").alias("up"), F.col("owner").alias("o"), F.col("up").alias("u"))
        moved = cur.where(going).join(b, ["key", "up"], "left").select("key", "ordinal", F.col("o").alias("owner"), F.col("u").alias("up"))
        cur = scratch.save(cur.where(~going).unionByName(moved), "owners")
    return cur.select("key", "ordinal", F.coalesce("owner", F.lit(-1)).alias("owner"))


def css_import_targets(imports: DataFrame, sheets: DataFrame) -> DataFrame:
    """key, target, path, dst: imports (key, path of the sheet, target) with the sheet (id, path) they mean.

    A target is joined to the importing sheet's directory; of its spellings as it stands, with an ending, as a
    partial and as an index the first that exists counts. An import of no sheet has no row.
    """
    whole = join_path(dirname(F.col("path")), F.regexp_replace("target", r"^(\./)+", ""))
    folder, stem = dirname(F.col("whole")), basename(F.col("whole"))
    partial = F.concat(F.when(folder == "", "").otherwise(F.concat(folder, F.lit("/"))), F.lit("_"), stem)
    spellings = [F.col("whole"), *(F.concat("whole", F.lit(e)) for e in (".scss", ".sass", ".css")), *(F.concat(partial, F.lit(e)) for e in (".scss", ".sass")), *(F.concat("whole", F.lit(e)) for e in ("/_index.scss", "/index.scss"))]
    asked = imports.select("key", "path", "target").distinct().withColumn("whole", whole).select("key", "path", "target", F.posexplode(F.array(*spellings)).alias("at", "spelling"))
    known = sheets.groupBy(F.col("path").alias("spelling")).agg(F.min("id").alias("dst"))
    best = asked.join(known, "spelling").groupBy("key", "path", "target").agg(F.min(F.struct("at", "spelling", "dst")).alias("m"))
    return best.select("key", "target", F.col("m.spelling").alias("path"), F.col("m.dst").alias("dst"))


def id_correspondence(elements: DataFrame, css_ids: DataFrame) -> DataFrame:
    """src, dst, name, direction: an element's id and the style sheets' ids of that name, each way.

    ``elements``: key, id; ``css_ids``: sheet, name. Of one page the first element with an id counts.
    """
    html = elements.where("id <> ''").select("key", F.col("id").alias("name")).distinct()
    j = html.join(css_ids.where("name <> ''").select("sheet", "name").distinct(), "name")
    there = j.select(F.col("key").alias("src"), F.col("sheet").alias("dst"), "name", F.lit("html_css").alias("direction"))
    return there.unionByName(j.select(F.col("sheet").alias("src"), F.col("key").alias("dst"), "name", F.lit("css_html").alias("direction")))


def page_links(elements: DataFrame, files: DataFrame, anchors: DataFrame) -> DataFrame:
    """key, target, anchor, dst, what, grade of the local links of pages; links with a scheme or host are left out.

    ``elements``: key, path (of the page), link; ``files``: id, path; ``anchors``: id (of a file), anchor. A target
    is seen from the page's directory, an empty one is the page itself. A file that is there is exact, drifted
    if the anchor is missing; one that is not there is dangling. ``what`` tells media, for which a stub stands.
    """
    e = elements.where("link is not null and not link rlike '^([A-Za-z][A-Za-z0-9+.-]*:|//)'")
    part = F.split("link", "#")
    e = e.select("key", "path", F.regexp_replace(part[0], r"\?.*$", "").alias("target"), F.coalesce(F.try_element_at(part, F.lit(2)), F.lit("")).alias("anchor"))
    e = e.withColumn("whole", F.when(F.col("target") == "", F.col("path")).otherwise(join_path(dirname(F.col("path")), F.col("target"))))
    there = files.groupBy(F.col("path").alias("whole")).agg(F.min("id").alias("dst"))
    has = anchors.select(F.col("id").alias("dst"), "anchor", F.lit(True).alias("has")).distinct()
    j = e.join(there, "whole", "left").join(has, ["dst", "anchor"], "left")
    media = F.lower(F.regexp_extract("target", r"\.([^./]+)$", 1)).isin(*MEDIA)
    grade = F.when(F.col("dst").isNull(), "dangling").when((F.col("anchor") != "") & F.col("has").isNull(), "drifted").otherwise("exact")
    return j.select("key", "target", "anchor", "dst", F.when(media, "media").otherwise("page").alias("what"), grade.alias("grade"))


def html_class_usage(elements: DataFrame, classes: DataFrame) -> DataFrame:
    """key, owner, name, dst, grade: classes that elements name, from the nearest element with an id (-1: the document).

    ``classes``: id, name of the style sheets' classes. A name of several is ambiguous and all are kept, one of
    none is dangling.
    """
    scratch = Scratch(elements.sparkSession, "classes")
    e = scratch.save(elements.select("key", "ordinal", "parent", "id", "class"), "elements")
    names = e.where("class is not null").select("key", "ordinal", F.explode(F.split(F.trim("class"), r"\s+")).alias("name")).where("name <> ''")
    used = names.join(_owners(e, scratch), ["key", "ordinal"]).select("key", "owner", "name").distinct()
    c = classes.select(F.col("id").alias("dst"), "name").distinct()
    n = c.groupBy("name").agg(F.count(F.lit(1)).alias("k"))
    j = used.join(c, "name", "left").join(n, "name", "left")
    return j.select("key", "owner", "name", "dst", F.when(F.col("k").isNull(), "dangling").when(F.col("k") > 1, "ambiguous").otherwise("exact").alias("grade"))


def table_identities(names: DataFrame) -> DataFrame:
    """schema, tbl, identity: a qualified name is itself; a bare one takes the single schema known for it, else stays bare."""
    known = names.where("schema <> ''").groupBy("tbl").agg(F.countDistinct("schema").alias("k"), F.min("schema").alias("one"))
    n = names.select("schema", "tbl").distinct().join(known, "tbl", "left")
    schema = F.when(F.col("schema") != "", F.col("schema")).when(F.col("k") == 1, F.col("one")).otherwise(F.lit(""))
    return n.select("schema", "tbl", F.when(schema != "", F.concat(schema, F.lit("."), "tbl")).otherwise(F.col("tbl")).alias("identity"))


def owners(points: DataFrame, bodies: DataFrame, block: int = 256) -> DataFrame:
    """points (file_id, pt, line) with the symbol of the smallest body around; ties to the smaller id, none: dropped."""
    b = bodies.where("body_end_line >= body_start_line and body_start_line > 0").withColumn("blk", F.explode(F.sequence(F.floor(F.col("body_start_line") / block), F.floor(F.col("body_end_line") / block))))
    p = points.withColumn("blk", F.floor(F.col("line") / block))
    hit = p.join(b.select("file_id", "blk", "sym_id", "body_start_line", "body_end_line"), ["file_id", "blk"]).where("line between body_start_line and body_end_line")
    best = hit.groupBy("file_id", "pt").agg(F.min(F.struct((F.col("body_end_line") - F.col("body_start_line")).alias("span"), "sym_id")).alias("m"))
    return best.select("file_id", "pt", F.col("m.sym_id").alias("sym_id"))


def xml_table_refs(elements: DataFrame, rules: DataFrame) -> DataFrame:
    """key, chain, tbl, role: table names in attributes, by rules (attribute, element or null, role)."""
    j = elements.crossJoin(F.broadcast(rules)).where("element is null or element = tag")  # rules are configuration: a few rows
    value = F.expr("regexp_extract(sig, concat(' ', attribute, '=\"([^\"]*)\"'), 1)")
    return j.withColumn("tbl", F.lower(value)).where("tbl <> ''").select("key", "chain", "tbl", "role")

