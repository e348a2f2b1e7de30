"""Whole-graph analytics over aggregate nodes and edges."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symloom import model
from symloom.runtime import Scratch, numbered

SENT_NODES = 2_000_000  # nodes whose communities are sent to all executors; of more they are joined by a shuffle


def collapse(edges: DataFrame) -> DataFrame:
    """a, b, weight: one row an unordered pair, summed over kinds and directions."""
    return edges.groupBy(F.least("src_id", "dst_id").alias("a"), F.greatest("src_id", "dst_id").alias("b")).agg(F.sum("weight").alias("weight"))


def weighted_degree(pairs: DataFrame) -> DataFrame:
    """id, degree: summed weights of the incident pairs."""
    ends = pairs.select(F.col("a").alias("id"), "weight").union(pairs.select("b", "weight"))
    return ends.groupBy("id").agg(F.sum("weight").alias("degree"))


def god_nodes(nodes: DataFrame, degrees: DataFrame, top: int = 20) -> DataFrame:
    """filter, rank (from 0), short_id, weighted_degree, name: the most connected live, test and external nodes."""
    n = nodes.join(degrees, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    n = n.withColumn("filter", F.when(F.col("external"), "external").when(F.col("test"), "test").otherwise("live"))
    rank = F.row_number().over(Window.partitionBy("filter").orderBy(F.desc("degree"), "id"))
    # filtered as it is ranked, so each partition keeps its first ``top`` before the shuffle
    return n.withColumn("rn", rank).where(F.col("rn") <= top).select("filter", (F.col("rn") - 1).alias("rank"), F.col("id").alias("short_id"), F.col("degree").alias("weighted_degree"), "name")


def clustering_pairs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Collapsed pairs of internal nodes; is-a edges count four times."""
    inner = nodes.where("not external").select("id")
    e = edges.join(inner.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(inner.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi")
    boost = F.lit(1)
    for kind, times in model.CLUSTER_BOOST.items():
        boost = F.when(F.col("kind") == kind, times).otherwise(boost)
    return collapse(e.withColumn("weight", F.col("weight") * boost))


def communities(nodes: DataFrame, pairs: DataFrame, scratch: Scratch, passes: int = 20) -> DataFrame:
    """id, community: one level of modularity optimisation, set at a time.

    ``nodes``: id and ``part``; communities never cross parts, so one run serves a whole forest of
    subgraphs. In each pass half of the nodes, by hash, look at the communities of their neighbours and
    move where the gain k_in - tot * k / 2m is greatest, if it beats staying; ties go to the smaller
    community. Neighbours' moves are seen in the next pass, so results do not depend on any order, but the
    partition may differ from one found node by node. A node without edges stays alone.
    """
    spark = nodes.sparkSession
    inside = nodes.select("id", "part")
    both = pairs.where("a <> b").select(F.col("a").alias("id"), F.col("b").alias("nbr"), "weight").union(pairs.where("a <> b").select("b", "a", "weight"))
    part_of = inside.select(F.col("id").alias("nbr"), F.col("part").alias("nbr_part"))
    both = both.join(inside, "id").join(part_of, "nbr").where(F.col("part").eqNullSafe(F.col("nbr_part"))).select("id", "nbr", "weight", "part")
    both = scratch.save(both, "arcs")
    degree = both.groupBy("id", "part").agg(F.sum("weight").cast("double").alias("k"))
    totals = degree.groupBy("part").agg(F.sum("k").alias("m2")).withColumnRenamed("part", "p")
    state = scratch.save(degree.join(totals, F.col("part").eqNullSafe(F.col("p"))).select("id", F.col("id").alias("community"), "k", "m2"), "state")
    # arcs of a node stay in one partition, so that no pass shuffles them; communities of neighbours are sent to them while they fit
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    arcs = both.select("id", "nbr", "weight").repartition(parts, "id").sortWithinPartitions("id").persist(StorageLevel.DISK_ONLY)
    arcs.count()  # how kept rows lie is known to a plan only once they are there
    few = state.count() <= SENT_NODES
    quiet = 0
    for turn in range(2 * passes):
        due = F.pmod(F.xxhash64("id", F.lit(turn // 2)), F.lit(2)) == turn % 2
        tot = state.groupBy("community").agg(F.sum("k").alias("tot"), F.count(F.lit(1)).alias("members"))
        c = state.select("id", "community").join(tot, "community").select(F.col("id").alias("nbr"), F.col("community").alias("to"), "tot", (F.col("members") == 1).alias("lone"))
        into = arcs.where(due).join(F.broadcast(c) if few else c, "nbr").groupBy("id", "to").agg(F.sum("weight").cast("double").alias("k_in"), F.max("tot").alias("tot"), F.max("lone").alias("lone"))
        cur = state.where(due).join(tot.select("community", F.col("tot").alias("own_tot")), "community")
        options = into.join(cur.hint("shuffle_hash"), "id")
        own = F.col("to") == F.col("community")
        gain = F.col("k_in") - (F.col("tot") - F.when(own, F.col("k")).otherwise(0.0)) * F.col("k") / F.col("m2")
        options = options.withColumn("gain", gain).withColumn("own", own)
        stay = F.max(F.when(F.col("own"), F.col("gain")))
        # two lone nodes would swap for ever; only the one with the greater community moves
        move = F.max(F.when(~F.col("own") & ~(F.col("lone") & (F.col("to") > F.col("community"))), F.struct("gain", (-F.col("to")).alias("to"))))
        best = options.groupBy("id").agg(*(F.max(x).alias(x) for x in ("community", "k", "m2", "own_tot")), stay.alias("stay"), move.alias("best"))
        # staying without any neighbour in the own community gains nothing but the penalty of its other members
        kept = F.coalesce("stay", -(F.col("own_tot") - F.col("k")) * F.col("k") / F.col("m2"))
        goes = F.coalesce(F.col("best.gain") > kept + 1e-9, F.lit(False))
        after = best.select("id", F.when(goes, -F.col("best.to")).otherwise(F.col("community")).alias("community"), "k", "m2", goes.alias("moved"))
        after = scratch.save(after.unionByName(state.where(~due).withColumn("moved", F.lit(False))), "state")
        moved = after.where("moved").limit(1).count()
        state = after.drop("moved")
        quiet = 0 if moved else quiet + 1
        if quiet == 2:
            break
    arcs.unpersist()
    state = state.select("id", "community")
    rest = inside.join(state.select("id"), "id", "left_anti").select("id", F.col("id").alias("community"))
    return state.unionByName(rest)


def modularity(pairs: DataFrame, membership: DataFrame) -> DataFrame:
    """One row: the modularity of a partition (id, community)."""
    p = pairs.where("a <> b")
    m = p.agg(F.sum("weight").cast("double").alias("m"))
    ca, cb = membership.select(F.col("id").alias("a"), F.col("community").alias("ca")), membership.select(F.col("id").alias("b"), F.col("community").alias("cb"))
    inside = p.join(ca, "a").join(cb, "b").where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("weight").cast("double").alias("inside"))
    tot = weighted_degree(p).join(membership, "id").groupBy("community").agg(F.sum("degree").cast("double").alias("tot"))
    j = tot.join(inside, "community", "left").crossJoin(m)  # m is one row
    return j.agg(F.sum(F.coalesce("inside", F.lit(0.0)) / F.col("m") - F.pow(F.col("tot") / (2 * F.col("m")), 2)).alias("modularity"))


def dense_communities(membership: DataFrame, scratch: Scratch) -> DataFrame:
    """id, community_id: communities numbered from 0 by falling size, then smallest member."""
    size = membership.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("low"))
    ids = numbered(size, "at", scratch, F.desc("size"), F.col("low")).select("community", (F.col("at") - 1).alias("community_id"))
    return membership.join(ids, "community").select("id", "community_id")


def hierarchy(nodes: DataFrame, pairs: DataFrame, scratch: Scratch, depth: int = 4, least: int = 20) -> DataFrame:
    """id, depth, community, parent: anchors at depth 0, communities within them below, split again while large.

    All parts of a depth are optimised in one run. A part of fewer than ``least`` nodes, or one that stays
    whole, is not split.
    """
    level = scratch.save(nodes.select("id", F.col("anchor_name").alias("community")), "level")
    out = [level.select("id", F.lit(0).alias("depth"), "community", F.lit(None).cast("string").alias("parent"))]
    for at in range(1, depth):
        sizes = level.groupBy("community").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("community")
        large = level.join(sizes, "community", "left_semi")
        found = communities(large.select("id", F.col("community").alias("part")), pairs, scratch)
        found = found.join(large.select("id", F.col("community").alias("parent")), "id")
        whole = found.groupBy("parent").agg(F.countDistinct("community").alias("n")).where("n > 1").select("parent")
        found = found.join(whole, "parent", "left_semi")
        level = scratch.save(found.select("id", F.concat_ws("/", "parent", F.col("community").cast("string")).alias("community"), "parent"), "level")
        if not level.limit(1).count():
            break
        out.append(level.select("id", F.lit(at).alias("depth"), "community", "parent"))
        level = level.select("id", "community")
    result = out[0]
    for o in out[1:]:
        result = result.unionByName(o)
    return result


def community_records(nodes: DataFrame, degrees: DataFrame, membership: DataFrame) -> DataFrame:
    """community_id, size, total_weight, cross_anchor, primary_anchor_name: the most frequent anchor, the larger name on ties."""
    m = membership.join(nodes.select("id", "anchor_name"), "id").join(degrees, "id", "left")
    per = m.groupBy("community_id", "anchor_name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("degree", F.lit(0))).alias("w"))
    return per.groupBy("community_id").agg(
        F.sum("n").alias("size"), F.sum("w").alias("total_weight"), (F.count(F.lit(1)) > 1).alias("cross_anchor"), F.max(F.struct("n", "anchor_name")).alias("p")
    ).select("community_id", "size", "total_weight", "cross_anchor", F.col("p.anchor_name").alias("primary_anchor_name"))


def membership_records(nodes: DataFrame, flat: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """short_id, flat_community_id, anchored_leaf_community_id; a sentinel where there is none."""
    none = F.lit(model.UNASSIGNED)
    n = nodes.select("id").join(flat.select("id", F.col("community_id").alias("f")), "id", "left")
    n = n.join(leaves.select("id", F.col("community_id").alias("l")), "id", "left") if leaves is not None else n.withColumn("l", F.lit(None).cast("long"))
    return n.select(F.col("id").alias("short_id"), F.coalesce("f", none).alias("flat_community_id"), F.coalesce("l", none).alias("anchored_leaf_community_id"))


def graph_stats(nodes: DataFrame, gods: DataFrame, membership: DataFrame) -> DataFrame:
    """language, nodes, god_nodes, communities, anchors: communities and anchors count for their most frequent language, the smaller name on ties."""
    def plural(df: DataFrame, key: str, name: str) -> DataFrame:
        per = df.groupBy(key, "language").agg(F.count(F.lit(1)).alias("n"))
        top = per.groupBy(key).agg(F.min(F.struct(-F.col("n"), "language")).alias("m")).select(F.col("m.language").alias("language"))
        return top.groupBy("language").agg(F.count(F.lit(1)).alias(name))

    by = nodes.groupBy("language").agg(F.count(F.lit(1)).alias("nodes"))
    g = gods.select(F.col("short_id").alias("id")).distinct().join(nodes.select("id", "language"), "id").groupBy("language").agg(F.count(F.lit(1)).alias("god_nodes"))
    c = plural(membership.join(nodes.select("id", "language"), "id"), "community_id", "communities")
    a = plural(nodes, "anchor_name", "anchors")
    out = by.join(g, "language", "left").join(c, "language", "left").join(a, "language", "left")
    return out.select("language", "nodes", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("god_nodes", "communities", "anchors")))
