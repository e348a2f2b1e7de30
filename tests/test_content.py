"""Joins of the content producers on repeated names."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from symloom.operators import content as co
from symloom.runtime import Scratch


def code_of(refs, files, symbols):
    """The rule, ref by ref."""
    out = set()
    for key, ref in refs:
        if ref is None:
            continue
        if "/" in ref or re.search(r"\.[a-z]{1,4}$", ref):
            hits = [("file", i, 0 if p == ref else 1 if p.endswith("/" + ref) else 2) for i, p in files if p.split("/")[-1] == ref.split("/")[-1]]
        else:
            parts = re.split(r"::|\.|#", ref)
            hits = [("symbol", i, 0 if len(parts) > 1 and parts[-2].lower() in pub.lower() else 1) for i, name, pub in symbols if name == parts[-1].lower()]
        best = [h for h in set(hits) if h[2] == min(x[2] for x in hits)]
        out |= {(key, ref, what, i, "ambiguous" if len(best) > 1 else "drifted" if tier else "exact") for what, i, tier in best}
    return out


def test_code_spans_of_repeated_names(spark):
    rng = random.Random(7)
    files = [(i, "/".join(rng.choice("ab") for _ in range(rng.randrange(4))) + rng.choice(("/", "")) + rng.choice(("m.rs", "n.rs", ""))) for i in range(40)]
    symbols = [(100 + i, rng.choice(("run", "stop", "only")), f"rust:{rng.choice(('Top', 'Low'))}/x#{i}") for i in range(30)] + [(200, "lone", "rust:lone#200")]
    words = ["run", "Run", "top::run", "low.stop", "none#stop", "gone", "lone", "rust.lone", "x::lone", "::only", "m.rs", "a/m.rs", "b/a/m.rs", "/m.rs", "a/", "z/n.rs", "gone.rs", None]
    refs = [(k, w) for k in (1, 2, 2, None) for w in words] + [(3, p) for _, p in files if p]
    df = co.resolve_code(
        spark.createDataFrame(refs, "key long, ref string"), spark.createDataFrame(files, "id long, path string"), spark.createDataFrame(symbols, "id long, name_lower string, pub_id string")
    )
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got)) and set(got) == code_of(refs, files, symbols)


def test_pairs_of_one_name_are_many_tasks(spark):
    left, right = spark.range(400).selectExpr("id key", "'n' name"), spark.range(100).selectExpr("id dst", "'n' name").union(spark.sql("select 1L, 'other'"))
    out = co.blocked_join(left, right, ["name"], Scratch(spark, "b"), "k", 1_000)
    per = [r[1] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(per) == 40_000 and max(per) <= 8_000
    assert out.distinct().count() == 40_000 and {r.k for r in out.select("k").distinct().collect()} == {100}


def test_pages_are_parsed_once_for_their_classes(spark):
    read = spark.sparkContext.accumulator(0)

    def elements(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = [(k, i, i - 1, "x" if k and i == 1 else None, "a b" if i % 3 == 0 else None) for k in range(4) for i in range(20)]
    e = spark.createDataFrame(rows, "key long, ordinal int, parent int, id string, class string").mapInArrow(elements, "key long, ordinal int, parent int, id string, class string")
    classes = spark.createDataFrame([(1, "a"), (2, "a")], "id long, name string")
    got = co.html_class_usage(e, classes)
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    want = {(k, 1 if k and deep else -1, *x) for k in range(4) for deep in (0, 1) for x in (("a", 1, "ambiguous"), ("a", 2, "ambiguous"), ("b", None, "dangling"))}
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert read.value == len(rows)
