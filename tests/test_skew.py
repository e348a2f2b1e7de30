from __future__ import annotations

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from symloom.operators import skew
from symloom.runtime import Scratch


def data(spark, seed=3):
    rng = random.Random(seed)
    rows = [(rng.choice([7, 7, 7, 8, 8, *range(1, 40), 0, None]), rng.choice([None, *range(200)]), "x") for _ in range(4_000)]
    return rows, spark.createDataFrame(rows, "k long, m long, member string").repartition(4)


def test_per_key_matches_counts(spark):
    rows, df = data(spark)
    n, ids = Counter(), defaultdict(set)
    for k, m, _ in rows:
        if k:
            n[k] += 1
            if m is not None:
                ids[k].add(m)
    got = {r.key_id: (r.n_rows, r.n_ids) for r in skew.per_key(df, "k", "m", 8, Scratch(spark, "t")).collect()}
    assert got == {k: (n[k], len(ids[k])) for k in n}
    assert skew.per_key(df.where("false"), "k", "m", 8, Scratch(spark, "t")).count() == 0


def test_hot_keys_are_split_and_tasks_are_even(spark):
    rows = [(1, i, "x") for i in range(30_000)] + [(2 + i % 500, i, "x") for i in range(30_000)]
    df = spark.createDataFrame(rows, "k long, m long, c string")
    loads = df.groupBy("k").count().selectExpr("k key", "count load")
    plan = skew.plan_routing(loads, 8)
    assert plan.split == {1: 4} and len(plan.placed) <= 8 * skew.PLACED_SHARE
    sent = skew.routed(df, "k", "m", plan)
    sizes = {r[0]: r[1] for r in sent.groupBy(F.spark_partition_id()).count().collect()}
    assert len(sizes) == 8 and max(sizes.values()) < 1.3 * 60_000 / 8
    assert sent.where(F.col("__task") != F.spark_partition_id()).count() == 0
    right = spark.createDataFrame([(k, f"v{k}") for k in range(600)], "k long, v string")
    copies = skew.replicated(right, "k", plan)
    assert copies.where("k = 1").count() == 4 and copies.count() == 603
    assert copies.where(F.col("__task") != F.spark_partition_id()).count() == 0


def test_nothing_is_sent_again_inside_the_tasks(spark):
    _, df = data(spark)
    right = spark.createDataFrame([(k, f"v{k}") for k in range(30)], "k long, v string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = skew.skew_join(df, right, "k", "m", 8)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("shufflepartitionidpassthrough") == 2 and "hashpartitioning" not in plan


def test_rows_without_a_key_are_spread(spark):
    df = spark.range(8_000).selectExpr("cast(null as long) k", "id m").union(spark.range(100).selectExpr("id k", "id m"))
    loads = skew.key_loads(df, "k")
    sizes = [r["count"] for r in skew.routed(df, "k", "m", skew.plan_routing(loads, 8)).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1.3 * 8_100 / 8


def test_join_equals_a_plain_join(spark):
    rows, df = data(spark, 9)
    right = spark.createDataFrame([(k, f"v{k}") for k in range(0, 30)], "k long, v string")
    for how in ("inner", "left"):
        want = Counter(map(tuple, df.join(right, "k", how).select("k", "m", "v").collect()))
        got = Counter(map(tuple, skew.skew_join(df, right, "k", "m", 8, how).select("k", "m", "v").collect()))
        assert got == want
    assert skew.skew_join(df.where("false"), right, "k", "m", 8).count() == 0
