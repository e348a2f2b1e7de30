"""The rolled-up graph: aggregates, weighted directed edges, anchors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom import model
from symloom.runtime import Scratch

UNANCHORED = "<unanchored>"
EXAMPLE_DIRS = ("example", "examples", "sample", "samples", "demo", "demos", "fixtures")


def aggregate_ids(symbols: DataFrame, scratch: Scratch) -> DataFrame:
    """id, agg_id: the nearest enclosing class or document, else the nearest internal module, else the symbol.

    Paths are composed by doubling: a segment of a path knows its first class, its first module and where it
    goes on, so chains of depth d take log2(d) rounds. Loops end as soon as a round changes nothing.
    """
    leaf = F.when(F.col("kind").isin(*model.LEAVES), F.col("id"))
    module = F.when(F.col("kind").isin(*model.SCOPES) & ~F.col("external"), F.col("id"))
    s = symbols.select("id", leaf.alias("leaf"), module.alias("fallback"), F.col("enclosing_sym_id").alias("up"))
    known = symbols.select(F.col("id").alias("known")).distinct()
    on = F.when(s.leaf.isNull() & (s.up != 0) & (s.up != s.id), F.col("known"))
    s = scratch.save(s.join(known, s.up == known.known, "left").select("id", "leaf", "fallback", on.alias("up")), "steps")
    before = None
    while True:
        open_ = s.where("up is not null").agg(F.count(F.lit(1)).alias("n"), F.count("fallback").alias("f")).collect()[0]  # one row
        if not open_.n or tuple(open_) == before:
            break
        before = tuple(open_)
        b = s.select(F.col("id").alias("b"), F.col("leaf").alias("b_leaf"), F.col("fallback").alias("b_fallback"), F.col("up").alias("b_up"))
        j = s.join(b, s.up == b.b, "left")
        s = scratch.save(j.select("id", F.coalesce("leaf", "b_leaf").alias("leaf"), F.coalesce("fallback", "b_fallback").alias("fallback"), F.when(F.col("b_leaf").isNull(), F.col("b_up")).alias("up")), "steps")
    return s.select("id", F.coalesce("leaf", "fallback", "id").alias("agg_id"))


def aggregate_edges(edges: DataFrame, aggregates: DataFrame, symbols: DataFrame) -> DataFrame:
    """src_id, dst_id, kind, weight: every distinct pair of a kept kind weighs once; loops are dropped.

    Imports count between modules only. Pairs with an unknown end are dropped.
    """
    weights = edges.sparkSession.createDataFrame([(model.EDGE_KINDS[k], k, w) for k, w in model.ROLLUP_WEIGHTS.items()], "code int, kind_name string, w long")
    e = edges.select("src_id", "target_id", F.col("kind").alias("code")).join(F.broadcast(weights), "code").distinct()  # ten rows
    scopes = symbols.select(F.col("id").alias("sid"), F.col("kind").isin(*model.SCOPES).alias("scope"))
    a = aggregates.join(scopes, aggregates.agg_id == scopes.sid).select("id", "agg_id", "scope")
    src = a.select(F.col("id").alias("src_id"), F.col("agg_id").alias("s"), F.col("scope").alias("s_scope"))
    dst = a.select(F.col("id").alias("target_id"), F.col("agg_id").alias("d"), F.col("scope").alias("d_scope"))
    m = e.join(src, "src_id").join(dst, "target_id").where("s <> d and (kind_name <> 'imports' or (s_scope and d_scope))")
    return m.groupBy(F.col("s").alias("src_id"), F.col("d").alias("dst_id"), F.col("kind_name").alias("kind")).agg(F.sum("w").alias("weight"))


def primary_files(defs: DataFrame) -> DataFrame:
    """sym_id, file_id: the smallest file of each symbol."""
    return defs.where("file_id <> 0").groupBy("sym_id").agg(F.min("file_id").alias("file_id"))


def example_path(path: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(path), r"[/\\]"), F.array(*(F.lit(x) for x in EXAMPLE_DIRS)))


def covering_manifest(paths: DataFrame, manifests: DataFrame) -> DataFrame:
    """path, anchor: the deepest manifest directory (rel_dir, anchor) that holds each path.

    Every ancestor directory of a path is looked up by equality, so the prefix match is an equi-join.
    """
    parts = F.split("path", "/")
    dirs = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    up = paths.select("path").distinct().select("path", F.explode(dirs).alias("rel_dir"))
    hit = up.join(manifests, "rel_dir")
    return hit.groupBy("path").agg(F.max_by("anchor", F.struct(F.length("rel_dir"), "anchor")).alias("anchor"))


def aggregate_nodes(agg_edges: DataFrame, symbols: DataFrame, packages: DataFrame, defs: DataFrame, files: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """The ends of kept edges with their anchor: package name, else manifest, else first path segment.

    Anchor ids count the sorted anchor names from 1.
    """
    ends = agg_edges.select(F.col("src_id").alias("id")).union(agg_edges.select("dst_id")).distinct()
    n = symbols.join(ends, "id", "left_semi").select("id", "kind", "name", "language", "external", "test", "pkg_id")
    pk = packages.where(F.col("name").rlike(r"[\p{L}\p{N}]")).select(F.col("id").alias("pkg_id"), F.col("name").alias("pkg"))
    paths = primary_files(defs).join(files.select(F.col("id").alias("file_id"), "path"), "file_id").select(F.col("sym_id").alias("id"), "path")
    n = n.join(pk, "pkg_id", "left").join(paths, "id", "left")
    n = n.join(covering_manifest(paths, manifests), "path", "left") if manifests is not None else n.withColumn("anchor", F.lit(None).cast("string"))
    first = F.regexp_extract("path", r"^/*([^/]+)", 1)
    n = n.withColumn("anchor_name", F.coalesce("pkg", "anchor", F.when(first != "", first), F.lit(UNANCHORED)))
    names = n.select("anchor_name").distinct()
    # one row an anchor: the names of packages, never of symbols
    ids = names.withColumn("anchor_id", F.row_number().over(Window.orderBy("anchor_name")).cast("long"))
    n = n.join(ids, "anchor_name")
    return n.select("id", "kind", "name", "language", "external", "test", F.coalesce(example_path(F.col("path")), F.lit(False)).alias("example"), "anchor_id", "anchor_name")


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
