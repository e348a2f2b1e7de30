"""A few keys holding most records: fragment-replicate by estimated load.

Loads per key are counted with map-side combining. Keys above a task's fair share are split into
shards in proportion to their load; shards, the larger of the other keys and hashed buckets of the
many light keys are packed onto tasks, largest first, each onto the task with the least load.
The matching side of a join is replicated to the shards of its key and to nothing else. Rows are sent
by the planned task itself (a partition id, not a hash of it), and what follows runs inside the task.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.runtime import Scratch

PLACED_SHARE = 16  # keys above 1/16 of a task's share are placed one by one: at most 16 x tasks of them, beside as many buckets


@dataclass(frozen=True)
class Routing:
    """placed: (key, load, task of each shard) of the heavy keys; buckets: task of each hashed bucket of light keys."""

    tasks: int
    placed: list[tuple[int, int, list[int]]]
    buckets: list[int]
    total: int

    @property
    def split(self) -> dict[int, int]:
        return {k: len(t) for k, _, t in self.placed if len(t) > 1}


def plan_routing(loads: DataFrame, tasks: int) -> Routing:
    """Plan from (key, load). The driver receives keys above total / (16 x tasks) and the buckets' loads: at most 32 x tasks rows."""
    total = loads.agg(F.sum("load")).collect()[0][0] or 0
    n_buckets = PLACED_SHARE * tasks
    heavy = (F.col("load") > max(1, total // n_buckets)) & F.col("key").isNotNull()
    bucket = F.pmod(F.xxhash64("key"), F.lit(n_buckets))
    name = F.when(heavy, F.struct(F.lit(0).alias("light"), F.col("key").alias("id"))).otherwise(F.struct(F.lit(1).alias("light"), bucket.alias("id")))
    known = loads.where("key is not null").groupBy(name.alias("name")).agg(F.sum("load").alias("load")).select("name.*", "load").collect()
    share = max(1, math.ceil(total / tasks))
    pieces = []
    for light, key, load in map(tuple, known):
        n = 1 if light else math.ceil(load / share)
        pieces += [(load / n, light, key, i) for i in range(n)]
    queue = [(0.0, t) for t in range(tasks)]
    homes: dict[tuple[int, int], list[int]] = {}
    for load, light, key, _ in sorted(pieces, key=lambda x: (-x[0], *x[1:])):
        have, task = heapq.heappop(queue)
        homes.setdefault((light, key), []).append(task)
        heapq.heappush(queue, (have + load, task))
    placed = [(r.id, r.load, homes[0, r.id]) for r in known if not r.light]
    return Routing(tasks, sorted(placed), [homes.get((1, b), [b % tasks])[0] for b in range(n_buckets)], total)


def _homes(df: DataFrame, key: str, plan: Routing) -> DataFrame:
    """``df`` with ``__homes``: the tasks of the key's shards, of a light key the one task of its bucket. Null for a null key."""
    spark = df.sparkSession
    heavy = spark.createDataFrame(plan.placed or [(0, 0, [0])], "__key long, __load long, __placed array<int>").drop("__load")
    heavy = heavy if plan.placed else heavy.where("false")
    light = spark.createDataFrame(list(enumerate(plan.buckets)), "__at long, __home int")
    n = F.lit(len(plan.buckets))
    out = df.join(F.broadcast(heavy), F.col(key) == F.col("__key"), "left")  # at most 16 x tasks rows, as the buckets are
    out = out.join(F.broadcast(light), F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(F.col(key)), n)) == F.col("__at"), "left")
    homes = F.coalesce("__placed", F.when(F.col("__home").isNotNull(), F.array("__home")))
    return out.withColumn("__homes", homes).drop("__key", "__placed", "__at", "__home")


def sent(df: DataFrame, plan: Routing) -> DataFrame:
    """Each row in the partition that ``__task`` names."""
    return df.repartitionById(plan.tasks, F.col("__task"))


def routed(df: DataFrame, key: str, spread: str, plan: Routing) -> DataFrame:
    """``df`` with ``__shard`` and ``__task``, in its task: the row's shard is chosen by the hash of ``spread``.

    Rows with a null key go to all tasks alike, by the same hash.
    """
    out, at = _homes(df, key, plan), F.xxhash64(F.col(spread))
    out = out.withColumn("__shard", F.coalesce(F.pmod(at, F.size("__homes")), F.lit(0)).cast("int"))
    task = F.coalesce(F.element_at("__homes", F.col("__shard") + 1), F.pmod(at, F.lit(plan.tasks)).cast("int"))
    return sent(out.withColumn("__task", task).drop("__homes"), plan)


def replicated(df: DataFrame, key: str, plan: Routing) -> DataFrame:
    """The matching side with one copy for each shard of its key, as (..., __shard, __task), in the shard's task."""
    out = _homes(df, key, plan)
    return sent(out.select(*df.columns, F.posexplode("__homes").alias("__shard", "__task")), plan)


def key_loads(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(F.col(key).cast("long").alias("key")).agg(F.count(F.lit(1)).alias("load"))


def per_key(df: DataFrame, key: str, member: str, tasks: int, scratch: Scratch) -> DataFrame:
    """key_id, n_rows, n_ids of every key but 0 and null; repeated rows count in n_rows.

    Repeated rows are reduced to one row per (key, member) first, combined within each partition before
    the shuffle, and written; the loads are those of the reduced rows. They are sent to their tasks, which
    add up their shards. A member belongs to one shard of its key, so the shards' distinct counts add up.
    A null member counts as a row and as no id.
    """
    base = df.select(F.col(key).cast("long").alias("key"), F.col(member).cast("long").alias("member")).where("key is not null and key <> 0")
    base = scratch.save(base.groupBy("key", "member").agg(F.count(F.lit(1)).alias("n")), "members")
    shards = routed(base, "key", "member", plan_routing(key_loads(base, "key"), tasks))
    parts = shards.groupBy("__task", "key", "__shard").agg(F.sum("n").alias("n_rows"), F.count("member").alias("n_ids"))
    return parts.groupBy(F.col("key").alias("key_id")).agg(F.sum("n_rows").alias("n_rows"), F.sum("n_ids").alias("n_ids"))


def skew_join(left: DataFrame, right: DataFrame, key: str, spread: str, tasks: int, how: str = "inner") -> DataFrame:
    """``left`` (many rows of few keys) joined with ``right`` on ``key``, inner or left.

    The columns of ``right`` other than the key must not clash with those of ``left``. Rows with a null
    key match nothing; a left join keeps them. ``spread`` tells the rows of a key apart: those that share
    it stay in one shard, so exact copies should be reduced to one row with their number beforehand.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    plan = plan_routing(key_loads(left, key), tasks)
    a = routed(left, key, spread, plan)
    b = replicated(right.where(F.col(key).isNotNull()).withColumnRenamed(key, "__rkey"), "__rkey", plan)
    b = b.withColumnsRenamed({"__shard": "__rshard", "__task": "__rtask"})
    same = (a["__task"] == b["__rtask"]) & (a[key] == b["__rkey"]) & (a["__shard"] == b["__rshard"])
    return a.join(b, same, how).drop("__rkey", "__rshard", "__rtask", "__shard", "__task")
