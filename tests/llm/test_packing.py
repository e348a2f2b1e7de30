from __future__ import annotations

from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from symloom.llm import packing
from symloom.runtime import Scratch


@given(st.lists(st.integers(1, 50), max_size=200))
@settings(max_examples=60, deadline=None)
def test_best_fit_is_a_packing(sizes):
    bins = packing.best_fit(sizes, 50)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= 50 for b in bins)
    # two bins that fit into one would contradict best fit
    fills = sorted(sum(sizes[i] for i in b) for b in bins)
    assert len(fills) < 2 or fills[0] + fills[1] > 50


def test_whole_texts_in_few_bins(spark):
    docs = [(i, "word " * (1 + (i * 37) % 700), "x") for i in range(400)] + [(1000, "long text " * 5000, "y"), (1001, None, None), (1002, "", ""), (1003, "   ", "")]
    df = spark.createDataFrame(docs, "doc_id long, text string, bin_id string")
    items = packing.pieces(df)
    out = packing.pack(items, Scratch(spark, "t"), tasks=4).collect()
    sized = {(r.doc_id, r.piece): r.n for r in items.collect()}
    assert {(r.doc_id, r.piece): r.n for r in out} == sized and len(out) == len(sized)
    fill = defaultdict(int)
    for r in out:
        fill[r.bin_id] += r.n
    assert max(fill.values()) <= packing.CAPACITY
    assert all(fill[r.bin_id] == r.fill for r in out)
    least = -(-sum(sized.values()) // packing.CAPACITY)
    assert len(fill) <= least * 1.02 + 1
    long = sorted((r.piece, r.start, r.n) for r in out if r.doc_id == 1000)
    assert [p for p, _, _ in long] == list(range(len(long))) and all(n == packing.CAPACITY for _, _, n in long[:-1])
    assert {r.doc_id for r in out} == {d for d, t, _ in docs if t}


def test_bins_that_nothing_joins(spark, monkeypatch):
    monkeypatch.setattr(packing, "TASK_ITEMS", 20)
    items = spark.createDataFrame([(i, 0, 0, 1_100) for i in range(200)], "doc_id long, piece int, start long, n int")
    out = packing.pack(items, Scratch(spark, "t"), tasks=2)
    assert out.count() == 200 and out.select("bin_id").distinct().count() == 200
    assert packing.pack(items.where("false"), Scratch(spark, "t"), tasks=2).count() == 0


@given(st.lists(st.lists(st.integers(1, 60), max_size=60), min_size=1, max_size=4))
@settings(max_examples=60, deadline=None)
def test_withheld_bins_are_never_needed(pools):
    """A merge of all bins of the pools ends with as many bins as one of the bins that travel."""
    capacity = 60
    fills = [[sum(p[i] for i in b) for b in packing.best_fit(p, capacity)] for p in pools]
    assert all(sum(2 * f <= capacity for f in fs) <= 1 for fs in fills)
    travelling = [f for fs in fills for k, f in enumerate(fs) if fs[:k].count(f) < packing.MERGE]
    held = sum(map(len, fills)) - len(travelling)
    everything = [f for fs in fills for f in fs]
    assert len(packing.best_fit(travelling, capacity)) + held == len(packing.best_fit(everything, capacity))


def test_tasks_are_even_and_the_tree_ends_in_one(spark, monkeypatch):
    monkeypatch.setattr(packing, "TASK_ITEMS", 500)
    items = spark.range(20_000).selectExpr("id doc_id", "0 piece", "0L start", "cast(1 + pmod(hash(id), 900) as int) n")
    node = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(40)).cast("int")
    loads = items.repartitionById(40, node).groupBy(F.spark_partition_id()).count().collect()
    assert len(loads) == 40 and max(r["count"] for r in loads) < 1.3 * 500
    out = packing.pack(items, Scratch(spark, "t"), tasks=2)
    total = items.agg(F.sum("n")).collect()[0][0]
    assert out.count() == 20_000 and out.select("bin_id").distinct().count() <= 1.01 * total / packing.CAPACITY
