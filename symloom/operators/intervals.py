"""Overlapping and gapped time intervals: continuous periods and the gaps between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.runtime import Scratch

SPAN_US = 86_400_000_000  # one bucket of an entity's time line: a day


def latest_rows(df: DataFrame, id_col: str, cols: list[str], order: str = "loaded_at") -> DataFrame:
    """Of each id the row with the greatest ``order``; ties fall to the greatest column values."""
    pick = F.max(F.struct(F.col(order), *(F.col(c) for c in cols)))
    return df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(pick.alias("m")).select(*(F.col(f"m.{c}").alias(c) for c in cols))


def busy_and_gaps(df: DataFrame, entity: str, start: str, end: str, scratch: Scratch, span_us: int = SPAN_US) -> DataFrame:
    """entity, seg_kind, seg_start, seg_end (epoch microseconds): maximal busy stretches and gaps.

    Intervals that overlap or touch belong to one stretch; zero-length ones count. Rows without
    entity, start or end, or with the end before the start, are left out.

    ``session_window`` with a duration per row merges the overlapping intervals of one entity and one
    time bucket, a window over the bucket those that touch. Buckets are then stitched by one row each,
    so an entity with a large share of all rows is spread over its buckets and is no single task.
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = df.select(F.col(entity).alias("entity"), us(start).alias("s"), us(end).alias("e")).where(
        "entity is not null and s is not null and e is not null and e >= s"
    )
    # in half microseconds a zero-length interval has room to be a window that touches nothing; its true end is kept
    length = F.concat(F.greatest(2 * (F.col("e") - F.col("s")), F.lit(1)).cast("string"), F.lit(" microseconds"))
    merged = (
        rows.withColumn("b", _bucket("s", span_us))
        .groupBy("entity", "b", F.session_window(F.timestamp_micros(2 * F.col("s")), length).alias("w"))
        .agg(F.min("s").alias("s"), F.max("e").alias("e"))
        .select("entity", "b", "s", "e")
    )
    pieces = scratch.save(_touching(merged), "pieces")
    stretches = scratch.save(_stitch(pieces, scratch), "stretches")
    return stretches.select("entity", F.lit("busy").alias("seg_kind"), "seg_start", "seg_end").unionByName(_gaps(stretches, span_us))


def _bucket(at: str, span_us: int) -> Column:
    return F.floor(F.col(at) / F.lit(span_us)).cast("long")


def _touching(merged: DataFrame) -> DataFrame:
    """Join the rows (entity, b, s, e) of one bucket that touch; the rows are in their buckets' partitions already."""
    inside = Window.partitionBy("entity", "b").orderBy("s", "e")
    upto = F.max("e").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    marked = merged.withColumn("upto", upto).withColumn("head", F.when(F.col("upto").isNull() | (F.col("s") > F.col("upto")), F.col("s")))
    own = F.max("head").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("own", own).groupBy("entity", "b", F.col("own").alias("s")).agg(F.max("e").alias("e"))


def _stitch(pieces: DataFrame, scratch: Scratch) -> DataFrame:
    """entity, seg_start, seg_end: pieces (entity, b, s, e) joined over their buckets.

    What earlier buckets reach covers the first pieces of a bucket; those belong to the stretch that the
    last uncovered piece before the bucket began.
    """
    before = Window.partitionBy("entity").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    reach = pieces.groupBy("entity", "b").agg(F.max("e").alias("top"))
    reach = reach.select("entity", "b", F.max("top").over(before).alias("carried"))
    marked = pieces.join(reach, ["entity", "b"])
    marked = marked.withColumn("head", F.when(F.col("carried").isNull() | (F.col("s") > F.col("carried")), F.col("s")))
    marked = scratch.save(marked.select("entity", "b", "e", "head"), "marked")
    ends = marked.groupBy("entity", "b").agg(F.max("head").alias("last"), F.max(F.when(F.col("head").isNull(), F.col("e"))).alias("e"))
    covered = ends.select("entity", F.max("last").over(before).alias("head"), "e").where("e is not null")
    heads = marked.where("head is not null").select("entity", "head", "e")
    return heads.unionByName(covered).groupBy("entity", F.col("head").alias("seg_start")).agg(F.max("e").alias("seg_end"))


def _gaps(stretches: DataFrame, span_us: int) -> DataFrame:
    """The time from each stretch's end to the next one's start, by ``lead`` within the buckets and over the buckets."""
    rows = stretches.withColumn("b", _bucket("seg_start", span_us))
    inner = rows.withColumn("nxt", F.lead("seg_start").over(Window.partitionBy("entity", "b").orderBy("seg_start")))
    edges = rows.groupBy("entity", "b").agg(F.min("seg_start").alias("first"), F.max("seg_end").alias("seg_end"))
    edges = edges.withColumn("nxt", F.lead("first").over(Window.partitionBy("entity").orderBy("b")))
    both = inner.select("entity", "seg_end", "nxt").unionByName(edges.select("entity", "seg_end", "nxt")).where("nxt is not null")
    return both.select("entity", F.lit("gap").alias("seg_kind"), F.col("seg_end").alias("seg_start"), F.col("nxt").alias("seg_end"))
