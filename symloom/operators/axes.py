"""Axis analytics over the rolled-up graph: packages, domains, contracts, tables, documents, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom import model
from symloom.operators.analytics import weighted_degree
from symloom.operators.rollup import UNANCHORED
from symloom.runtime import Scratch

CONTAINERS = model.SCOPES
# What public ids of a language begin with.
ROOT_PREFIX = {"rust": "rs", "csharp": "cs", "typescript": "ts", "go": "go", "python": "py", "swift": "sw"}
OUT_CAP, IN_CAP, CENTRAL_CAP = 8, 24, 8
MIN_PKG_MEMBERS, MIN_DOMAIN_LINKS, MIN_DOMAIN_SIZE = 2, 2, 4
MIN_AREA = 5


def first_party(nodes: DataFrame) -> DataFrame:
    """Internal, anchored nodes of a programming language."""
    return nodes.where((F.col("anchor_name") != UNANCHORED) & ~F.col("external") & F.col("language").isin(*model.CODE_LANGUAGES))


def pair_weights(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """src_pkg, dst_pkg, kind, weight between first-party packages."""
    n = first_party(nodes).select("id", "anchor_name")
    e = edges.join(n.select(F.col("id").alias("src_id"), F.col("anchor_name").alias("src_pkg")), "src_id")
    e = e.join(n.select(F.col("id").alias("dst_id"), F.col("anchor_name").alias("dst_pkg")), "dst_id").where("src_pkg <> dst_pkg")
    return e.groupBy("src_pkg", "dst_pkg", "kind").agg(F.sum("weight").alias("weight"))


def couplings(pairs: DataFrame) -> DataFrame:
    """pkg, direction, other, weight, relations, n_total, w_total: capped rows with totals from before the cap."""
    o = pairs.select(F.col("src_pkg").alias("pkg"), F.lit("out").alias("direction"), F.col("dst_pkg").alias("other"), "kind", "weight")
    i = pairs.select(F.col("dst_pkg").alias("pkg"), F.lit("in").alias("direction"), F.col("src_pkg").alias("other"), "kind", "weight")
    key = ["pkg", "direction"]
    listed = F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), "kind")))  # at most one entry a kind
    per = o.unionByName(i).groupBy(*key, "other").agg(F.sum("weight").alias("weight"), F.array_join(F.transform(listed, lambda x: x.kind), ",").alias("relations"))
    totals = per.groupBy(*key).agg(F.count(F.lit(1)).alias("n_total"), F.sum("weight").alias("w_total"))
    rn = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("weight"), "other"))
    cap = F.when(F.col("direction") == "out", OUT_CAP).otherwise(IN_CAP)
    return per.withColumn("rn", rn).where(F.col("rn") <= cap).join(totals, key).drop("rn")


def role(w_in: Column, w_out: Column, tests: Column, total: Column) -> Column:
    """tests, isolated, provider, consumer or layer by the share of outgoing weight."""
    share = w_out / (w_in + w_out)
    return F.when(2 * tests > total, "tests").when(w_in + w_out == 0, "isolated").when(share <= 0.25, "provider").when(share >= 0.75, "consumer").otherwise("layer")


def packages(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """pkg, n_symbols, language, used_by, uses, role: all first-party packages."""
    n = first_party(nodes)
    per = n.groupBy("anchor_name", "language").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("test").cast("long")).alias("t"))
    base = per.groupBy(F.col("anchor_name").alias("pkg")).agg(
        F.sum("n").alias("n_symbols"), F.sum("t").alias("tests"), F.min(F.struct(-F.col("n"), "language")).alias("l")
    )
    p = pair_weights(nodes, edges)
    out = p.groupBy(F.col("src_pkg").alias("pkg")).agg(F.countDistinct("dst_pkg").alias("uses"), F.sum("weight").alias("w_out"))
    inn = p.groupBy(F.col("dst_pkg").alias("pkg")).agg(F.countDistinct("src_pkg").alias("used_by"), F.sum("weight").alias("w_in"))
    j = base.join(out, "pkg", "left").join(inn, "pkg", "left").na.fill(0, ["uses", "used_by", "w_out", "w_in"])
    return j.select("pkg", "n_symbols", F.col("l.language").alias("language"), "used_by", "uses", role(F.col("w_in"), F.col("w_out"), F.col("tests"), F.col("n_symbols")).alias("role"))


def central_symbols(nodes: DataFrame, pairs: DataFrame, top: int = CENTRAL_CAP) -> DataFrame:
    """pkg, rank, id, name, degree: the most connected symbols of each package, no containers, tests only where tests prevail."""
    n = first_party(nodes)
    tests = n.groupBy("anchor_name").agg((2 * F.sum(F.col("test").cast("long")) > F.count(F.lit(1))).alias("tests"))
    n = n.join(tests, "anchor_name").where(~F.col("kind").isin(*CONTAINERS) & (~F.col("test") | F.col("tests")))
    n = n.join(weighted_degree(pairs), "id")
    rn = F.row_number().over(Window.partitionBy("anchor_name").orderBy(F.desc("degree"), "name", "id"))
    return n.withColumn("rank", rn).where(F.col("rank") <= top).select(F.col("anchor_name").alias("pkg"), "rank", "id", "name", "degree")


def common_prefix(rows: DataFrame, key: str, value: str, sep: str) -> DataFrame:
    """key, prefix: the common leading segments of all values; the least and the greatest value tell it."""
    # segments are compared with a separator that sorts before all other signs
    v = F.replace(F.col(value), F.lit(sep), F.lit("\u0001"))
    m = rows.groupBy(key).agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    a, b = F.split("lo", "\u0001"), F.split("hi", "\u0001")
    same = F.transform(F.sequence(F.lit(1), F.least(F.size(a), F.size(b))), lambda i: F.when(F.slice(a, F.lit(1), i) == F.slice(b, F.lit(1), i), i).otherwise(0))
    return m.select(key, F.array_join(F.slice(a, F.lit(1), F.array_max(same)), sep).alias("prefix"))


def package_roots(paths: DataFrame) -> DataFrame:
    """pkg, root: the common directory of a package's paths (pkg, path) without a trailing source folder."""
    dirs = paths.select("pkg", F.regexp_replace("path", r"/?[^/]*$", "").alias("dir"))
    p = common_prefix(dirs, "pkg", "dir", "/")
    return p.select("pkg", F.regexp_replace("prefix", r"(^|/)(src|source|sources|lib)$", "").alias("root"))


def directory_histogram(paths: DataFrame) -> DataFrame:
    """pkg, dir, n: paths per first directory below the package's root; "(root)" for files at it."""
    j = paths.join(package_roots(paths), "pkg")
    rel = F.when(F.col("root") == "", F.col("path")).otherwise(F.expr("substring(path, length(root) + 2)"))
    top = F.when(rel.contains("/"), F.split(rel, "/")[0]).otherwise(F.lit("(root)"))
    return j.groupBy("pkg", top.alias("dir")).agg(F.count(F.lit(1)).alias("n"))


def components(paths: DataFrame) -> DataFrame:
    """dir, n: sub-areas of the dominant package with enough symbols, if there are two of them at least."""
    h = directory_histogram(paths)
    size = h.groupBy("pkg").agg(F.sum("n").alias("total"))
    dominant = size.agg(F.max_by("pkg", F.struct("total", "pkg")).alias("pkg"), F.max("total").alias("most"), F.sum("total").alias("all")).where("2 * most > all").select("pkg")
    areas = h.join(dominant, "pkg").where((F.col("n") >= MIN_AREA) & (F.col("dir") != "(root)"))
    enough = areas.groupBy("pkg").agg(F.count(F.lit(1)).alias("k")).where("k >= 2").select("pkg")
    return areas.join(enough, "pkg", "left_semi").select("dir", "n")


def domains(nodes: DataFrame, edges: DataFrame, membership: DataFrame, scratch: Scratch) -> DataFrame:
    """community_id, size, n_links, n_packages, hub: communities that span packages by links of their own.

    ``membership``: id, community_id. Members are first-party, named, no containers, tests or examples. A
    package supports a span with two members and a link to another such package; distinct node pairs count.
    Where one package holds a strict majority of the nodes, a community within one package counts too.
    """
    n = first_party(nodes)
    m = n.where(~F.col("test") & ~F.col("example") & (F.col("name") != "") & ~F.col("kind").isin(*CONTAINERS))
    m = m.join(membership, "id").select("id", "name", F.col("anchor_name").alias("pkg"), "community_id")
    size = m.groupBy("community_id").agg(F.count(F.lit(1)).alias("raw"), F.countDistinct("pkg").alias("pkgs")).where(F.col("raw") >= MIN_DOMAIN_SIZE)
    m = scratch.save(m.join(size, "community_id"), "members")
    a, b = (m.select(F.col("id").alias(f"{x}_id"), F.col("pkg").alias(f"{x}_pkg"), F.col("community_id").alias(f"{x}_c")) for x in ("src", "dst"))
    inner = edges.join(a, "src_id").join(b, "dst_id").where("src_c = dst_c")
    inner = scratch.save(inner.groupBy("src_id", "dst_id", "src_c", "src_pkg", "dst_pkg").agg(F.sum("weight").alias("weight")), "inner")
    links = inner.where("src_pkg <> dst_pkg").select("src_id", "dst_id", "src_c", "src_pkg", "dst_pkg")
    links = links.groupBy(F.col("src_c").alias("community_id"), F.least("src_pkg", "dst_pkg").alias("p"), F.greatest("src_pkg", "dst_pkg").alias("q")).agg(F.count(F.lit(1)).alias("n"))
    cand = m.groupBy("community_id", "pkg").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") >= MIN_PKG_MEMBERS).select("community_id", "pkg")
    ok = links.join(cand.withColumnRenamed("pkg", "p"), ["community_id", "p"], "left_semi").join(cand.withColumnRenamed("pkg", "q"), ["community_id", "q"], "left_semi")
    ok = scratch.save(ok, "links")
    span = ok.groupBy("community_id").agg(F.sum("n").alias("n_links")).where(F.col("n_links") >= MIN_DOMAIN_LINKS)
    kept = ok.select("community_id", F.col("p").alias("pkg")).union(ok.select("community_id", "q")).distinct().join(span, "community_id")
    spanning = m.join(kept, ["community_id", "pkg"])
    top = first_party(nodes).groupBy("anchor_name").agg(F.count(F.lit(1)).alias("n"))
    single = top.agg((2 * F.max("n") > F.sum("n")).alias("single"))
    alone = m.where("pkgs = 1").join(span.select("community_id"), "community_id", "left_anti").crossJoin(single).where("single")  # one row
    rows = spanning.select("community_id", "id", "name", "pkg", "n_links").unionByName(alone.select("community_id", "id", "name", "pkg", F.lit(0).cast("long").alias("n_links")))
    ends = inner.select(F.col("src_id").alias("id"), "weight").union(inner.select("dst_id", "weight")).groupBy("id").agg(F.sum("weight").alias("deg"))
    rows = rows.join(ends, "id", "left").withColumn("deg", F.coalesce("deg", F.lit(0)))
    return rows.groupBy("community_id").agg(
        F.count(F.lit(1)).alias("size"), F.max("n_links").alias("n_links"), F.countDistinct("pkg").alias("n_packages"), F.min(F.struct(-F.col("deg"), "name", "id")).alias("h")
    ).select("community_id", "size", "n_links", "n_packages", F.col("h.name").alias("hub"), F.col("h.id").alias("hub_id"))


def list_domains(found: DataFrame, symbols: DataFrame, domain: str | None = None) -> DataFrame:
    """symbol, title, size, packages_count, links, rank of :func:`domains` rows, the largest first, ties by title.

    ``symbol`` is the hub's public id; a domain whose hub has no symbol is left out. ``domain`` names one by
    that id or by its title. ``hub_id`` tells the hub.
    """
    s = symbols.select(F.col("id").alias("hub_id"), F.col("pub_id").alias("symbol"), F.col("name").alias("title"))
    j = found.join(s, "hub_id")
    if domain is not None:
        j = j.where((F.col("symbol") == domain) | (F.col("title") == domain))
    first = j.orderBy(F.desc("size"), "title", "community_id")
    return first.select("symbol", "title", "size", F.col("n_packages").alias("packages_count"), F.col("n_links").alias("links"))


def root_symbols(nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """pkg, root_id, pub_id: the symbol that stands for a whole package, where the store has it.

    Candidates by language: the crate module of a Rust package, else the package's name behind the language's prefix.
    """
    p = packages_language(nodes)
    prefix = F.coalesce(*(F.when(F.col("language") == k, F.lit(v)) for k, v in ROOT_PREFIX.items()))
    tail = F.when(F.col("language") == "rust", F.lit("::crate")).otherwise(F.lit(""))
    cand = p.select("pkg", F.concat(prefix, F.lit(":"), "pkg", tail).alias("pub_id")).where("pub_id is not null")
    hit = symbols.groupBy("pub_id").agg(F.min("id").alias("root_id"))
    return cand.join(hit, "pub_id").select("pkg", "root_id", "pub_id")


def packages_language(nodes: DataFrame) -> DataFrame:
    """pkg, language: the most frequent language of each first-party package, the smaller name on ties."""
    per = first_party(nodes).groupBy(F.col("anchor_name").alias("pkg"), "language").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("pkg").agg(F.min(F.struct(-F.col("n"), "language")).alias("m")).select("pkg", F.col("m.language").alias("language"))


def root_documents(roots: DataFrame, files: DataFrame, docs: DataFrame, precedence: dict[str, list[str]]) -> DataFrame:
    """pkg, path, doc: the documentation of a package's root file.

    ``roots``: pkg, language, root; ``files``: id, path; ``docs``: file_id, doc. Of the documented files at or
    below the root whose name is one of the language's, that of the earliest name counts, then the shallowest,
    then the first by path. A file finds its root by the equality of one of its directories.
    """
    name = F.element_at(F.split("path", "/"), -1)
    order = F.coalesce(*(F.when(F.col("language") == k, F.array_position(F.array(*map(F.lit, v)), name)) for k, v in precedence.items()), F.lit(0))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    d = docs.where("doc <> ''").groupBy("file_id").agg(F.min("doc").alias("doc"))
    f = files.join(d, files.id == d.file_id).select("path", "doc", F.explode(above).alias("root"))
    j = f.join(roots, "root").withColumn("order", order).where(F.col("order") > 0)
    best = j.groupBy("pkg").agg(F.min(F.struct("order", F.size(F.split("path", "/")).alias("depth"), "path", "doc")).alias("m"))
    return best.select("pkg", "m.path", "m.doc")


def contracts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, name, span, implementers: types that two packages at least implement or extend."""
    n = first_party(nodes).where((F.col("name") != "") & ~F.col("test"))
    e = edges.where(F.col("kind").isin("implements", "extends_type")).select("src_id", "dst_id").distinct()
    e = e.join(n.select(F.col("id").alias("src_id"), F.col("anchor_name").alias("pkg")), "src_id").join(n.select(F.col("id").alias("dst_id"), "name"), "dst_id")
    g = e.groupBy(F.col("dst_id").alias("id"), "name").agg(F.countDistinct("pkg").alias("span"), F.countDistinct("src_id").alias("implementers"))
    return g.where("span >= 2").orderBy(F.desc("span"), F.desc("implementers"), "name", "id")


def tables(sql_tables: DataFrame, refs: DataFrame) -> DataFrame:
    """name, internal, file_span, language_span, total_refs of every table, unreferenced ones with zeros.

    ``refs``: table_id, file_id, language, kind; a table is internal if some reference defines it.
    """
    declares = F.max((F.col("kind") == model.EDGE_KINDS["defines_table"]).cast("int"))
    g = refs.groupBy("table_id").agg(declares.alias("d"), F.countDistinct("file_id").alias("file_span"), F.countDistinct("language").alias("language_span"), F.count(F.lit(1)).alias("total_refs"))
    j = sql_tables.join(g, sql_tables.id == g.table_id, "left").na.fill(0, ["d", "file_span", "language_span", "total_refs"])
    return j.select("name", (F.col("d") == 1).alias("internal"), "file_span", "language_span", "total_refs").orderBy(F.desc("file_span"), F.desc("language_span"), F.desc("total_refs"), "name")


def documents(files: DataFrame) -> DataFrame:
    """dir, n_files: top directories with non-external files and no code file; files at the top do not count."""
    f = files.where(~F.col("external") & F.col("path").contains("/")).withColumn("dir", F.split("path", "/")[0])
    code = F.max(F.col("language").isin(*model.CODE_LANGUAGES).cast("int"))
    return f.groupBy("dir").agg(F.count(F.lit(1)).alias("n_files"), code.alias("code")).where("code = 0").select("dir", "n_files")


def supernodes(nodes: DataFrame, degrees: DataFrame) -> DataFrame:
    """anchor_name, n_nodes, degree: one node an anchor."""
    n = nodes.join(degrees, "id", "left")
    return n.groupBy("anchor_name").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum(F.coalesce("degree", F.lit(0))).alias("degree"))


def bundles(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, weight, n: collapsed pairs bundled between anchors."""
    x = nodes.select(F.col("id").alias("a"), F.col("anchor_name").alias("xa"))
    y = nodes.select(F.col("id").alias("b"), F.col("anchor_name").alias("xb"))
    j = pairs.join(x, "a").join(y, "b").where("xa <> xb")
    return j.groupBy(F.least("xa", "xb").alias("a"), F.greatest("xa", "xb").alias("b")).agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))
