from __future__ import annotations

import datetime as dt
import random

from symloom.operators import intervals as iv
from symloom.runtime import Scratch

T0 = dt.datetime(2025, 3, 1)


def brute(rows):
    out = set()
    by = {}
    for e, a, b in rows:
        if e is not None and a is not None and b is not None and b >= a:
            by.setdefault(e, []).append((a, b))
    for e, xs in by.items():
        merged = []
        for a, b in sorted(xs):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out |= {(e, "busy", a, b) for a, b in merged}
        out |= {(e, "gap", p[1], q[0]) for p, q in zip(merged, merged[1:])}
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(400):
        a = T0 + dt.timedelta(seconds=rng.randrange(40_000))
        rows.append((rng.choice(["x", "y", "z", None]), a, rng.choice([a, a + dt.timedelta(seconds=rng.randrange(400)), a - dt.timedelta(seconds=1), None, a + dt.timedelta(days=rng.randrange(3) == 0)])))
    rows += [("t", T0, T0 + dt.timedelta(seconds=5)), ("t", T0 + dt.timedelta(seconds=5), T0 + dt.timedelta(seconds=9)), ("p", T0, T0), ("p", T0 + dt.timedelta(seconds=1), T0 + dt.timedelta(seconds=1)), ("n", T0, None)]
    df = spark.createDataFrame([(e, a, b, 1) for e, a, b in rows], "e string, a timestamp, b timestamp, seg_kind int")
    us = lambda t: int((t - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    want = {(e, k, us(a), us(b)) for e, k, a, b in brute(rows)}
    for span in (iv.SPAN_US, 60_000_000):  # the result does not depend on the bucket size
        got = iv.busy_and_gaps(df, "e", "a", "b", Scratch(spark, "t"), span).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert iv.busy_and_gaps(df.where("false"), "e", "a", "b", Scratch(spark, "t")).count() == 0


def test_a_microsecond_is_a_gap(spark):
    us = dt.timedelta(microseconds=1)
    df = spark.createDataFrame([("x", T0, T0), ("x", T0 + us, T0 + 5 * us), ("x", T0 + 5 * us, T0 + 6 * us)], "e string, a timestamp, b timestamp")
    got = sorted((r.seg_kind, r.seg_end - r.seg_start) for r in iv.busy_and_gaps(df, "e", "a", "b", Scratch(spark, "t")).collect())
    assert got == [("busy", 0), ("busy", 5), ("gap", 1)]


def test_latest_rows(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", None), (None, "d", 5), (2, None, 1), (2, "z", 1)], "id int, v string, loaded_at int")
    assert sorted((r.v for r in iv.latest_rows(df, "id", ["v"]).collect())) == ["b", "z"]
