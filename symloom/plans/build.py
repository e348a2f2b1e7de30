"""The write path in one go: roll-up, analytics, knowledge rows and statistics of a graph, published as a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.operators import analytics as an
from symloom.operators import finalize as fin
from symloom.operators import rollup as ru
from symloom.runtime import Scratch
from symloom.sources.snapshot import SnapshotStore


def build_snapshot(spark: SparkSession, store: SnapshotStore, run: str, graph: dict[str, DataFrame], cluster: bool = True) -> None:
    """Derive all tables of ``graph`` (symbols, symbol_docs, defs, edges, files, packages) and publish them as ``run``.

    Derived tables read the written inputs, so nothing is computed twice; nothing is seen before the end. With
    ``cluster`` false the communities, the one iterative step, are left out.
    """
    scratch = Scratch(spark, "build")
    store.write(run, {**graph, "defs": fin.purge_placeholders(graph["defs"])}, {"edges": "kind"})
    written = {t: spark.read.parquet(f"{store.root}/runs/{run}/{t}") for t in graph}
    symbols = written["symbols"]
    edges = scratch.save(ru.aggregate_edges(written["edges"], ru.aggregate_ids(symbols, scratch), symbols), "edges")
    nodes = scratch.save(ru.aggregate_nodes(edges, symbols, written["packages"], written["defs"], written["files"]), "nodes")
    degrees = scratch.save(an.weighted_degree(an.collapse(edges)), "degrees")
    gods = an.god_nodes(nodes, degrees)
    derived = {
        "aggregate_nodes": nodes, "aggregate_edges": edges, "analysis_god_nodes": gods,
        "knowledge_names": fin.name_rows(symbols, written["symbol_docs"]), "knowledge_docs": fin.doc_rows(symbols, written["symbol_docs"]),
        "name_words": fin.name_words(symbols), "stats": fin.entity_stats(symbols, written["files"], written["defs"], written["packages"]),
    }
    if cluster:
        inner = nodes.where("not external").select("id", F.lit("all").alias("part"))
        flat = scratch.save(an.dense_communities(an.communities(inner, an.clustering_pairs(nodes, edges), scratch), scratch), "flat")
        derived["analysis_flat_communities"] = an.community_records(nodes, degrees, flat)
        derived["analysis_node_membership"] = an.membership_records(nodes, flat)
    store.write(run, derived)
    store.publish(run)
