from __future__ import annotations

import datetime as dt
import random

from symloom.operators import orphans as orp
from symloom.runtime import Scratch

T0 = dt.datetime(2025, 1, 1)


def brute(refs, parents):
    out = set()
    for tab, key, at in refs:
        if not key or at is None:
            continue
        own = [(a, g) for k, a, g in parents if k == key]
        state = None
        if not own:
            state = "missing"
        elif all(a is not None and a > at for a, _ in own):
            state = "late"
        elif any(g is not None and g <= at for _, g in own):
            state = "deleted"
        if state:
            out.add((tab, "k", key, at.strftime("%Y-%m"), state))
    return out


def test_replay_matches_brute_force(spark):
    rng = random.Random(2)
    when = lambda: T0 + dt.timedelta(days=rng.randrange(400), seconds=rng.randrange(9))
    refs = [("t", rng.choice([0, None, *range(1, 25)]), when()) for _ in range(300)] + [("t", 3, when()) for _ in range(150)] + [("t", 4, None)]
    parents = [(rng.randrange(1, 20), when(), rng.choice([None, None, when()])) for _ in range(40)]
    parents += [(21, None, None)]
    r = spark.createDataFrame([(k, a, "x") for _, k, a in refs], "k long, loaded_at timestamp, period string")
    p = spark.createDataFrame([(k, a, g, "x") for k, a, g in parents], "id long, loaded_at timestamp, removed_at timestamp, tab string")
    args = orp.references(r, "t", "k", "p"), orp.parents(p, "p")
    state = orp.replay(*args, Scratch(spark, "o"))
    got = {tuple(x) for x in state.found().collect()}
    # a group may show two states at once; the brute force names one a row, over all rows of the group
    assert got == brute(refs, parents)
    assert sum(x.n_keys for x in state.snapshot().collect()) == len(got)


def test_order_of_batches_does_not_matter(spark):
    refs = orp.references(spark.createDataFrame([(1, T0), (2, T0)], "k long, loaded_at timestamp"), "t", "k", "p")
    p = spark.createDataFrame([(1, T0 + dt.timedelta(days=40), None), (2, T0 - dt.timedelta(days=1), T0 - dt.timedelta(hours=1))], "id long, loaded_at timestamp, removed_at timestamp")
    none_r, none_p = refs.where("false"), orp.parents(p, "p").where("false")
    state = orp.OrphanState(Scratch(spark, "o"))
    state.advance(refs, none_p)
    assert {(r.ref_key, r.state) for r in state.found().collect()} == {(1, "missing"), (2, "missing")}
    state.advance(none_r, orp.parents(p, "p"))  # arrivals resolve, deletions reopen
    assert {(r.ref_key, r.state) for r in state.found().collect()} == {(1, "late"), (2, "deleted")}


def test_periods_are_utc_in_every_session(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        df = spark.sql("select 1L k, timestamp '2025-01-31 23:30:00Z' loaded_at")
        state = orp.OrphanState(Scratch(spark, "o"))
        state.advance(orp.references(df, "t", "k", "p"), orp.parents(df.selectExpr("k id", "loaded_at", "cast(null as timestamp) removed_at"), "p").where("false"))
        assert [r.period for r in state.found().collect()] == ["2025-01"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_many_batches_of_one_hot_key(spark):
    """Versions are compacted and old ones dropped; a key that all rows refer to stays one row."""
    state = orp.OrphanState(Scratch(spark, "o"), parts=4)
    p = orp.parents(spark.createDataFrame([(1, T0 + dt.timedelta(days=9), None)], "id long, loaded_at timestamp, removed_at timestamp"), "p")
    for n in range(2 * orp.COMPACT_EVERY + 2):
        refs = spark.range(50).selectExpr("1L k", f"timestamp_seconds({int(T0.timestamp())} + {n} * 86400 * 31) loaded_at")
        state.advance(orp.references(refs, "t", "k", "p"), p if n == 3 else p.where("false"))
    assert [(r.ref_key, r.period, r.state) for r in state.found().collect()] == [(1, "2025-01", "late")]
    (row,) = state._current().collect()
    assert sum(e.n for e in row.entries) == 50 * (2 * orp.COMPACT_EVERY + 2) and len(state.versions) == 2


def test_empty(spark):
    refs = orp.references(spark.createDataFrame([], "k long, loaded_at timestamp"), "t", "k", "p")
    p = orp.parents(spark.createDataFrame([], "id long, loaded_at timestamp, removed_at timestamp"), "p")
    state = orp.OrphanState(Scratch(spark, "o"))
    state.advance(refs, p)
    assert state.found().count() == 0
