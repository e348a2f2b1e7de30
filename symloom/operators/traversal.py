"""Edge traversal: listings, usages and provenance, for all nodes of a batch in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symloom import model
from symloom.runtime import Scratch


@dataclass(frozen=True)
class Narrow:
    """Row narrowing: every given field must hold; values within a field are alternatives.

    An unknown package name matches nothing.
    """

    external: bool = False
    tests: bool = False
    packages: tuple[str, ...] | None = None
    kinds: tuple[str, ...] | None = None
    languages: tuple[str, ...] | None = None

    def apply(self, rows: DataFrame, packages: DataFrame | None = None) -> DataFrame:
        if not self.external:
            rows = rows.where("not external")
        if not self.tests:
            rows = rows.where("not test")
        if self.kinds:
            rows = rows.where(F.col("kind").isin(*self.kinds))
        if self.languages:
            rows = rows.where(F.col("language").isin(*self.languages))
        if self.packages:
            known = packages.where(F.col("name").isin(*self.packages)).select(F.col("id").alias("pkg_id")).distinct()
            rows = rows.join(known, "pkg_id", "left_semi")
        return rows


def adjacent(edges: DataFrame, kind: str, outbound: bool) -> DataFrame:
    """node, other: distinct pairs of one kind."""
    a, b = ("src_id", "target_id") if outbound else ("target_id", "src_id")
    return edges.where(F.col("kind") == model.EDGE_KINDS[kind]).select(F.col(a).alias("node"), F.col(b).alias("other")).distinct()


def listing(
    edges: DataFrame, nodes: DataFrame, kind: str, outbound: bool, limit: int = model.PAGE, after: int = 0,
    narrow: Narrow = Narrow(), packages: DataFrame | None = None, wanted: DataFrame | None = None,
) -> DataFrame:
    """node, id, name, total, more: the first ``limit`` neighbours above ``after`` in id order.

    ``total`` counts the distinct neighbour ids above the cursor before narrowing, as the reader of a page
    sees it; ``more`` tells that the page is full and the total is not reached. Nodes default to all.
    """
    pairs = adjacent(edges, kind, outbound).where(F.col("other") > after)
    if wanted is not None:
        pairs = pairs.join(wanted.select(F.col(wanted.columns[0]).alias("node")).distinct(), "node", "left_semi")
    totals = pairs.groupBy("node").agg(F.count(F.lit(1)).alias("total"))
    rows = narrow.apply(pairs.join(nodes, pairs.other == nodes.id), packages)
    w = Window.partitionBy("node").orderBy("id")
    page = rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit)
    sizes = page.groupBy("node").agg(F.count(F.lit(1)).alias("size"))
    out = page.select("node", "id", "name").join(totals.join(sizes, "node"), "node")
    return out.select("node", "id", "name", "total", ((F.col("size") == limit) & (F.col("size") < F.col("total"))).alias("more"))


def both_ways(edges: DataFrame, nodes: DataFrame, kind: str, limit: int = model.PAGE, narrow: Narrow = Narrow()) -> DataFrame:
    """Inbound and outbound listings, told apart by ``direction``."""
    parts = [listing(edges, nodes, kind, out, limit, narrow=narrow).withColumn("direction", F.lit(d)) for out, d in ((False, "inbound"), (True, "outbound"))]
    return parts[0].unionByName(parts[1])


def module_files(edges: DataFrame, files: DataFrame, limit: int = model.PAGE) -> DataFrame:
    """module, id, path: targets of ``contains`` are files, whose ids are another number space."""
    pairs = adjacent(edges, "contains", True)
    rows = pairs.join(files, pairs.other == files.id).withColumn("rn", F.row_number().over(Window.partitionBy("node").orderBy("id")))
    return rows.where(F.col("rn") <= limit).select(F.col("node").alias("module"), "id", "path")


def usages(edges: DataFrame, nodes: DataFrame, kinds: tuple[str, ...] = model.LISTED_USAGES, page: int = model.PAGE, narrow: Narrow = Narrow()) -> DataFrame:
    """node, id, via, pos: users of every symbol, kind after kind, each kind at most one page, one page in all."""
    order = _kind_order(edges, kinds)
    pairs = edges.join(F.broadcast(order), "kind").select(F.col("target_id").alias("node"), F.col("src_id").alias("id"), "ordinal", "via").distinct()  # a row a kind
    rows = narrow.apply(pairs.join(nodes, "id"))
    per_kind = Window.partitionBy("node", "ordinal").orderBy("id")
    rows = rows.withColumn("rn", F.row_number().over(per_kind)).where(F.col("rn") <= page)
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("node").orderBy("ordinal", "id")))
    return rows.where(F.col("pos") <= page).select("node", "id", "via", "pos")


def _kind_order(edges: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    rows = [(i, k, model.EDGE_KINDS[k]) for i, k in enumerate(kinds)]
    return edges.sparkSession.createDataFrame(rows, "ordinal int, via string, kind int")


def resolve_names(queries: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """q, target_id, is_file: a public id, else a file path, else a name, external and test symbols included."""
    q = queries.select(F.col(queries.columns[0]).alias("q")).distinct()
    by_pub = q.join(symbols.groupBy("pub_id").agg(F.min("id").alias("target_id")), q.q == F.col("pub_id")).select("q", "target_id", F.lit(False).alias("is_file"), F.lit(0).alias("tier"))
    by_path = q.join(files.groupBy("path").agg(F.min("id").alias("target_id")), q.q == F.col("path")).select("q", "target_id", F.lit(True).alias("is_file"), F.lit(1).alias("tier"))
    by_name = q.join(symbols.select("name_lower", F.col("id").alias("target_id")), F.lower("q") == F.col("name_lower")).select("q", "target_id", F.lit(False).alias("is_file"), F.lit(2).alias("tier"))
    hits = by_pub.unionByName(by_path).unionByName(by_name)
    best = hits.groupBy("q").agg(F.min("tier").alias("tier"))
    return hits.join(best, ["q", "tier"]).select("q", "target_id", "is_file")


def find_usages(queries: DataFrame, symbols: DataFrame, files: DataFrame, edges: DataFrame, page: int = model.PAGE, targets: int = 10) -> DataFrame:
    """q, target_id, id, via, pos, n_targets, truncated: users of whatever each query names.

    One target is walked over the usage kinds in their order; of several the first ten are, in one flat
    list, truncated to a page. A query that names nothing has no row.
    """
    hits = resolve_names(queries, symbols, files)
    n = hits.groupBy("q").agg(F.count(F.lit(1)).alias("n_targets"))
    kept = hits.withColumn("rn", F.row_number().over(Window.partitionBy("q").orderBy("target_id"))).where(F.col("rn") <= targets)
    order = _kind_order(edges, model.USAGE_KINDS)
    files_kinds = F.col("via").isin("links_to_file", "imports")
    used = edges.join(F.broadcast(order), "kind").select("src_id", "target_id", "ordinal", "via").distinct()  # a row a kind
    rows = kept.join(used, "target_id").where(F.when(F.col("is_file"), files_kinds).otherwise(F.col("via") != "links_to_file"))
    live = symbols.where("not external and not test").select(F.col("id").alias("src_id"))
    rows = rows.join(live, "src_id", "left_semi")
    size = rows.groupBy("q").agg(F.count(F.lit(1)).alias("n_rows"))
    w = Window.partitionBy("q").orderBy("rn", "ordinal", "src_id")
    rows = rows.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= page).join(n, "q").join(size, "q")
    return rows.select("q", "target_id", F.col("src_id").alias("id"), "via", "pos", "n_targets", ((F.col("n_targets") > 1) & (F.col("n_rows") > page)).alias("truncated"))


def closure(links: DataFrame, scratch: Scratch, most_rounds: int = 64) -> DataFrame:
    """src, dst: everything reachable over (src, dst), by doubling; nodes on a cycle reach themselves.

    The number of rounds is the logarithm of the longest path. The result may be quadratic in one component.
    """
    reach = scratch.save(links.select("src", "dst").where("src is not null and dst is not null").distinct(), "reach")
    size = reach.count()
    for _ in range(most_rounds):
        a, b = reach.alias("a"), reach.alias("b")
        longer = a.join(b, F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))
        reach = scratch.save(reach.unionByName(longer).distinct(), "reach")
        if (grown := reach.count()) == size:
            break
        size = grown
    return reach


def predecessors(findings: DataFrame, scratch: Scratch) -> DataFrame:
    """id, predecessor: everything that a finding's parent_ids lead to; ids other than fnd_ ones are leaves.

    A finding on a cycle comes to itself, as in the store.
    """
    links = findings.select(F.col("id").alias("src"), F.explode("parent_ids").alias("dst")).where("src is not null and dst is not null").distinct()
    within = F.col("src").startswith("fnd_")
    reach = closure(links.where(within), scratch)
    first = links.where(~within)  # no path leads on through these, but one may begin there
    beyond = first.join(reach.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst"))
    return reach.unionByName(first).unionByName(beyond).distinct().select(F.col("src").alias("id"), F.col("dst").alias("predecessor"))


def successors(findings: DataFrame, scratch: Scratch) -> DataFrame:
    """id, successor: the findings that derive from a finding or a code node, itself left out."""
    links = findings.select(F.explode("parent_ids").alias("src"), F.col("id").alias("dst"))
    return closure(links, scratch).where("src <> dst").select(F.col("src").alias("id"), F.col("dst").alias("successor"))
