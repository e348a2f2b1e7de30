"""Parent-child links to full hierarchies, as nested-set ranges.

Subtree sizes travel upward and preorder positions downward, both by pointer doubling, so a forest
of depth d takes about log2(d) rounds instead of d: in round k a node knows its ancestor 2^k steps
up. Nodes that still have an ancestor when the rounds stop shrinking lie on or under a loop. Each
round is written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symloom.runtime import Scratch, id_or_null

SIBLING_BUCKETS = 64
POSITIONS = 4_096  # preorder positions of one tree that make a block of the range join


def latest_links(rows: DataFrame, id_col: str, parent_col: str, order_col: str) -> DataFrame:
    """id, parent: of each id the row that is last by ``order_col`` (then the greater parent).

    Parents of 0, null or an id that no row has become null. Rows without id are left out.
    """
    last = (
        rows.select(F.col(id_col).cast("long").alias("id"), F.col(parent_col).cast("long").alias("p"), F.col(order_col).alias("o"))
        .where("id is not null")
        .groupBy("id")
        .agg(F.max(F.struct("o", F.coalesce("p", F.lit(0)).alias("p"))).alias("m"))
        .select("id", id_or_null(F.col("m.p")).alias("p"))
    )
    ids = last.select(F.col("id").alias("known"))
    # many children share a parent, so the parents are reduced to distinct ids before they are looked up
    absent = last.select("p").where("p is not null").distinct().join(ids, F.col("p") == F.col("known"), "left_anti")
    absent = absent.select(F.col("p").alias("absent"))
    return last.join(absent, last.p == absent.absent, "left").select("id", F.when(F.col("absent").isNull(), F.col("p")).alias("parent"))


def hierarchy(links: DataFrame, scratch: Scratch, label: DataFrame | None = None) -> DataFrame:
    """id, parent, root_id, depth, lft, size, path of every node of ``links`` (id unique, parent).

    ``lft`` is the preorder position within the node's tree (0 for the root) and ``size`` the number
    of nodes in its subtree, so u is a descendant of v iff both have one root and
    v.lft < u.lft < v.lft + v.size. ``path`` joins the labels (``label``: id, name; default the id)
    from the root down. On or under a loop depth is -1, root_id the loop's smallest id and lft, size
    and path are null.
    """
    links = scratch.save(links, "links")
    up = links.where("parent is not null").select("id", F.col("parent").alias("anc"), F.lit(1).cast("long").alias("size"))
    up, gains, alive = scratch.save(up, "up"), [], None
    while (now := up.count()) and now != alive:
        alive = now
        gains.append(scratch.path(up.groupBy(F.col("anc").alias("id")).agg(F.sum("size").alias("gain")), "gain"))
        gain = scratch.spark.read.parquet(gains[-1])
        above = up.select(F.col("id").alias("a"), F.col("anc").alias("next"))
        grown = up.join(above, up.anc == above.a).join(gain, "id", "left")
        up = scratch.save(
            grown.select("id", F.col("next").alias("anc"), (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size")), "up"
        )
    looped = _loops(up, links, scratch) if now else None

    nodes = links
    if looped is not None:
        looped = scratch.save(looped, "looped")
        nodes = links.join(looped.select("id"), "id", "left_anti")
    one = nodes.select("id", F.lit(1).cast("long").alias("gain"))
    parts = one.unionByName(scratch.spark.read.parquet(*gains).select("id", "gain")) if gains else one
    # a gain may belong to a node on a loop; those are not among the nodes
    sizes = parts.groupBy("id").agg(F.sum("gain").alias("size"))
    nodes = scratch.save(nodes.join(sizes, "id"), "sized")

    placed = nodes.join(label.select(F.col("id"), F.col("name").alias("seg")), "id", "left") if label is not None else nodes.withColumn("seg", F.lit(None).cast("string"))
    placed = placed.withColumn("path", F.coalesce("seg", F.col("id").cast("string"))).drop("seg")
    roots = placed.where("parent is null").select(
        "id", "parent", "size", F.col("id").alias("root_id"), F.lit(None).cast("long").alias("anc"), F.lit(0).cast("long").alias("lft"), F.lit(0).cast("int").alias("depth"), "path"
    )
    rest = _offsets(placed.where("parent is not null")).select(
        "id", "parent", "size", F.lit(None).cast("long").alias("root_id"), F.col("parent").alias("anc"), F.col("lft"), F.lit(1).cast("int").alias("depth"), "path"
    )
    done = [scratch.path(roots, "done")]
    open_path = scratch.path(rest, "open")
    like = roots
    while scratch.read(open_path, like).limit(1).count():
        cur = scratch.read(open_path, like)
        known = scratch.read([*done, open_path], like).select(
            F.col("id").alias("a"), F.col("root_id").alias("a_root"), F.col("anc").alias("a_anc"), F.col("lft").alias("a_lft"), F.col("depth").alias("a_depth"), F.col("path").alias("a_path")
        )
        step = cur.join(known, cur.anc == known.a).select(
            "id", "parent", "size", F.col("a_root").alias("root_id"), F.col("a_anc").alias("anc"),
            (F.col("lft") + F.col("a_lft")).alias("lft"), (F.col("depth") + F.col("a_depth")).cast("int").alias("depth"),
            F.concat("a_path", F.lit("/"), "path").alias("path"),
        )
        moved = scratch.save(step, "step")
        done.append(scratch.path(moved.where("root_id is not null"), "done"))
        open_path = scratch.path(moved.where("root_id is null"), "open")
    out = scratch.read(done, like).select("id", "parent", "root_id", "depth", "lft", "size", "path")
    if looped is None:
        return out
    none = F.lit(None)
    bad = looped.join(links, "id").select(
        "id", "parent", "root_id", F.lit(-1).alias("depth"), none.cast("long").alias("lft"), none.cast("long").alias("size"), none.cast("string").alias("path")
    )
    return out.unionByName(bad)


def descendants(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """id, descendant: all descendants of the nodes ``of`` (id), from the ranges of :func:`hierarchy`.

    Nodes without children, on or under a loop or unknown have no row; repeated ids count once.
    """
    tops = nodes.join(of.select("id").where("id is not null").distinct(), "id", "left_semi")
    return _within(tops, nodes).select(F.col("top").alias("id"), F.col("inner").alias("descendant"))


def ancestors(nodes: DataFrame, of: DataFrame) -> DataFrame:
    """id, ancestor: all ancestors of the nodes ``of`` (id), from the ranges of :func:`hierarchy`. Cases as for descendants."""
    low = nodes.join(of.select("id").where("id is not null").distinct(), "id", "left_semi")
    return _within(nodes, low).select(F.col("inner").alias("id"), F.col("top").alias("ancestor"))


def _within(tops: DataFrame, inner: DataFrame) -> DataFrame:
    """top, inner: the pairs where the range of one holds the position of the other.

    They meet on the tree and a block of its positions, so a tree of very many nodes is many keys; a node's
    range is repeated once a block that it covers.
    """
    first, last = F.floor((F.col("lft") + 1) / POSITIONS), F.floor((F.col("lft") + F.col("size") - 1) / POSITIONS)
    a = tops.where("size > 1").select(
        F.col("id").alias("top"), F.col("root_id").alias("r"), F.col("lft").alias("low"), (F.col("lft") + F.col("size")).alias("high"), F.explode(F.sequence(first, last)).alias("block")
    )
    b = inner.where("lft is not null").select(F.col("id").alias("inner"), F.col("root_id").alias("r"), "lft", F.floor(F.col("lft") / POSITIONS).alias("block"))
    return a.join(b, ["r", "block"]).where("lft > low and lft < high")


def _offsets(kids: DataFrame) -> DataFrame:
    """Position after the parent: one more than the sizes of the earlier siblings.

    Two-level prefix sums: siblings are spread over hashed buckets, so one parent with a large share
    of all rows is no single task; the totals of a parent's buckets are few.
    """
    kids = kids.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(SIBLING_BUCKETS)).cast("int"))
    totals = kids.groupBy("parent", "b").agg(F.sum("size").alias("total"))
    before = F.sum("total").over(Window.partitionBy("parent").orderBy("b").rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("parent", "b", F.coalesce(before, F.lit(0)).alias("base"))
    inner = F.sum("size").over(Window.partitionBy("parent", "b").orderBy("id").rowsBetween(Window.unboundedPreceding, -1))
    return kids.withColumn("inner", F.coalesce(inner, F.lit(0))).join(bases, ["parent", "b"]).withColumn("lft", F.col("base") + F.col("inner") + 1)


def _loops(up: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """id, root_id of the nodes left over: they lie on a loop or lead into one.

    Ancestors at growing distances shrink to the nodes of the loops themselves; the smallest id of a
    loop then spreads along it, again by doubling.
    """
    up = up.select("id", "anc")

    def double(t: DataFrame) -> DataFrame:
        above = t.select(F.col("id").alias("a"), F.col("anc").alias("next"))
        return scratch.save(t.join(above, t.anc == above.a).select("id", F.col("next").alias("anc")), "far")

    ends, before = up.select("anc").distinct().count(), -1
    while ends != before:
        up, before = double(up), ends
        ends = up.select("anc").distinct().count()
    on_loop = up.select("anc").distinct().select(F.col("anc").alias("id"))
    ring = links.join(on_loop, "id").select("id", F.col("parent").alias("anc"), F.least("id", "parent").alias("low"))
    ring = scratch.save(ring, "ring")
    while True:
        above = ring.select(F.col("id").alias("a"), F.col("anc").alias("next"), F.col("low").alias("a_low"))
        spread = ring.join(above, ring.anc == above.a).select(
            "id", F.col("next").alias("anc"), F.least("low", "a_low").alias("low"), (F.col("a_low") < F.col("low")).alias("fell")
        )
        spread = scratch.save(spread, "ring")
        if not spread.where("fell").limit(1).count():
            break
        ring = spread.drop("fell")
    low = ring.select(F.col("id").alias("a"), F.col("low").alias("root_id"))
    return up.join(low, up.anc == low.a).select("id", "root_id")
