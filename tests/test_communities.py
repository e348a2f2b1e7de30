"""Passes over the arcs of a graph: what they shuffle, and that both ways to reach neighbours agree."""

from __future__ import annotations

import random
import re

from symloom.operators import analytics as an
from symloom.runtime import Scratch


class Watched(Scratch):
    """Keeps the plans of what is written."""

    def save(self, df, name="t"):
        self.plans = [*getattr(self, "plans", []), (name, df._jdf.queryExecution().executedPlan().toString())]
        return super().save(df, name)


def test_passes_shuffle_no_arcs(spark, monkeypatch):
    rng = random.Random(5)
    pairs = {tuple(sorted(rng.sample(range(60), 2))) for _ in range(300)}
    df = spark.createDataFrame([(a, b, rng.randrange(1, 5)) for a, b in sorted(pairs)], "a long, b long, weight long")
    nodes = spark.range(62).selectExpr("id", "if(id < 40, 'p', 'q') part")
    scratch = Watched(spark, "c")
    sent = sorted(map(tuple, an.communities(nodes, df, scratch, 3).collect()))
    passes = [p for n, p in scratch.plans if n == "state"][1:]
    assert passes and not any(re.search(r"hashpartitioning\((id#\d+L, to#|nbr#)", p) for p in passes)
    assert {i for i, _ in sent} == set(range(62)) and {(i, c) for i, c in sent if i > 59} == {(60, 60), (61, 61)}
    assert all((i < 40) == (c < 40) for i, c in sent)
    monkeypatch.setattr(an, "SENT_NODES", 0)
    assert sent == sorted(map(tuple, an.communities(nodes, df, Scratch(spark, "c"), 3).collect()))
