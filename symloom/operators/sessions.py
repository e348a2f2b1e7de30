"""Collected sessions: folds, pairing, retention, activity windows."""

from __future__ import annotations

import re
import shlex

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

RETENTION_S = 30 * 86_400
GC_EVERY_S = 86_400


def fold_sessions(events: DataFrame) -> DataFrame:
    """session, first_seen, last_seen and the first non-null branch and cwd by time: first value wins."""
    key = F.struct("ts", "seq")
    return events.groupBy("session").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.min_by("branch", F.when(F.col("branch").isNotNull(), key)).alias("branch"), F.min_by("cwd", F.when(F.col("cwd").isNotNull(), key)).alias("cwd"),
    )


def status_history(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all transitions, the live status of each session): the last transition by time, then seq."""
    w = Window.partitionBy("session").orderBy("ts", "seq")
    history = events.select("session", "ts", "seq", "status").withColumn("n", F.row_number().over(w))
    now = events.groupBy("session").agg(F.max(F.struct("ts", "seq", "status")).alias("m")).select("session", F.col("m.status").alias("status"), F.col("m.ts").alias("status_at"))
    return history, now


def clamped_count(deltas: DataFrame) -> DataFrame:
    """session, n: a counter of +1 and -1 that never falls below 0, in order of seq.

    The end value is the total minus the lowest running total if that is below zero: windows and maxima, so a
    session of any length is sorted and streamed, never gathered.
    """
    w = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = deltas.withColumn("run", F.sum("delta").over(w))
    g = run.groupBy("session").agg(F.sum("delta").alias("total"), F.min("run").alias("low"))
    return g.select("session", (F.col("total") - F.least("low", F.lit(0))).alias("n"))


def pair_commands(starts: DataFrame, finishes: DataFrame) -> DataFrame:
    """tool_use_id, session, started_at, finished_at, running: each start with its first finish at or after it."""
    f = finishes.select(F.col("tool_use_id").alias("f_id"), "finished_at")
    j = starts.join(f, (starts.tool_use_id == f.f_id) & (f.finished_at >= starts.started_at), "left")
    g = j.groupBy("tool_use_id", "session", "started_at").agg(F.min("finished_at").alias("finished_at"))
    return g.withColumn("running", F.col("finished_at").isNull())


def retain(commands: DataFrame, touches: DataFrame, sessions: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What survives: commands that run or are young, touches of surviving commands or young loose ones, sessions with children or young."""
    cutoff = now - F.expr(f"interval {RETENTION_S} seconds")
    old = (F.col("started_at") < cutoff) & F.col("finished_at").isNotNull()
    gone = commands.where(old).select(F.col("id").alias("command_id")).distinct()
    keep_c = commands.where(~F.coalesce(old, F.lit(False)))
    keep_t = touches.join(gone, "command_id", "left_anti").where(F.col("command_id").isNotNull() | ~F.coalesce(F.col("t") < cutoff, F.lit(False)))
    child = keep_c.select("session_id").union(keep_t.select("session_id")).distinct()
    stale = sessions.where(F.col("last_seen") < cutoff).join(child, "session_id", "left_anti").select("session_id")
    return keep_c, keep_t, sessions.join(stale, "session_id", "left_anti")


def gc_due(last_s: int | None, now_s: int) -> bool:
    return last_s is None or now_s - last_s > GC_EVERY_S


_SHELL = re.compile(
    r"""(?P<to>\d*(?:<<<|>>|<<|>&|<&|>\||[<>])|&>>?)|(?P<end>\|\||&&|[|&;()\n])|(?P<word>(?:[^\s"'\\<>|&;()]|\\.|"(?:\\.|[^"\\])*"|'[^']*')+)""", re.S
)


def first_command(cmd: str) -> list[str]:
    """Words of the first command of a line, without redirects and their targets."""
    shlex.split(cmd)  # raises where a quote is open
    out, target = [], False
    for m in _SHELL.finditer(cmd):
        if m["end"] and out:
            break
        if m["word"] and not target:
            out.append("".join(shlex.split(m["word"])))
        target = bool(m["to"])
    return out


def signature_of(cmd: str | None) -> str | None:
    """The program and its first argument that is no flag; assignments before it are skipped. Unparsable commands fall back to blanks."""
    if not cmd or not cmd.strip():
        return None
    try:
        parts = first_command(cmd)
    except ValueError:
        parts = cmd.split()
    while parts and "=" in parts[0] and parts[0].split("=", 1)[0].isidentifier():
        parts = parts[1:]
    if not parts:
        return None
    rest = [p for p in parts[1:] if not p.startswith("-")]
    return f"{parts[0].rsplit('/', 1)[-1]} {rest[0]}" if rest else parts[0].rsplit("/", 1)[-1]


@F.pandas_udf(StringType())
def signature(s: pd.Series) -> pd.Series:
    return s.map(signature_of, na_action="ignore")


def bursts(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """key, start, end, n: events that follow each other within ``gap`` collapse into one trigger."""
    w = F.session_window(F.col(ts), gap)
    g = events.groupBy(F.col(key).alias("key"), w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("start"), F.max(ts).alias("end"))
    return g.select("key", "start", "end", "n")
