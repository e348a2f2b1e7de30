"""Structured Streaming forms: debounced change events, tailed frames, folded anchor logs.

Event time and watermarks are this library's own; the batch forms in ``operators.sessions`` and
``operators.findings`` give the same rows once a stream has ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Directories whose changes never count; the last is this library's own store.
SKIPPED_DIRS = ("node_modules", "target", "bin", "obj", ".git", ".symloom")


def relevant(events: DataFrame, extensions: tuple[str, ...], excludes: tuple[str, ...] = ()) -> DataFrame:
    """Change events (path, ...) outside skipped directories, with a wanted extension and no excluded pattern."""
    parts = F.split("path", "/")
    keep = ~F.arrays_overlap(parts, F.array(*map(F.lit, SKIPPED_DIRS))) & F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions)
    for pattern in excludes:
        keep = keep & ~F.col("path").rlike(pattern)
    return events.where(keep)


def debounced(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    """Streaming sessions: one row a burst once the watermark has passed it."""
    return (
        events.withWatermark(ts, late)
        .groupBy(F.col(key).alias("key"), F.session_window(F.col(ts), gap).alias("w"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("start"), F.max(ts).alias("end"))
        .select("key", "start", "end", "n")
    )


def tail_json(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON lines of files that appear whole in a folder; broken lines are dropped."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(folder)


def paired_commands(starts: DataFrame, finishes: DataFrame, late: str, longest: str) -> DataFrame:
    """Stream-stream join of command starts and finishes by tool_use_id within ``longest``; unfinished starts come with null."""
    s = starts.withWatermark("started_at", late)
    f = finishes.select(F.col("tool_use_id").alias("f_id"), "finished_at").withWatermark("finished_at", late)
    on = F.expr(f"tool_use_id = f_id and finished_at >= started_at and finished_at <= started_at + interval {longest}")
    return s.join(f, on, "leftOuter").drop("f_id")


def run_once(df: DataFrame, where: str, checkpoint: str, mode: str = "append") -> None:
    """Process all that is there into parquet, then stop; a rerun takes only what is new."""
    q = df.writeStream.format("parquet").option("path", where).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def fold_counts(events: DataFrame, late: str) -> DataFrame:
    """Running attach counts and recency of each anchor, as an update-mode aggregation."""
    e = events.where("op = 'attach'").withWatermark("ts", late)
    return e.groupBy("finding_id", "anchor").agg(F.count(F.lit(1)).alias("attach_count"), F.max("ts").alias("recency"))
