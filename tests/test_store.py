"""Snapshots, frames, findings on disk, cursors and streams."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from symloom.operators import sessions as ss
from symloom.plans import paging as pg
from symloom.runtime import Scratch
from symloom.sources import frames as fr
from symloom.sources.snapshot import SnapshotStore
from symloom.streaming import watch


def test_snapshot_lifecycle(spark):
    st = SnapshotStore(spark, Scratch(spark, "snap").root)
    with pytest.raises(LookupError):
        st.read("t")
    for r in ("2025-01", "2025-02", "2025-03"):
        st.write(r, {"t": spark.range(int(r[-1])).withColumn("kind", F.lit(1))}, {"t": "kind"})
        if r != "2025-03":
            st.publish(r)
    assert st.live() == "2025-02" and st.read("t").count() == 2
    with pytest.raises(LookupError):
        st.read("t", "2025-03")
    assert st.rollback() == "2025-01" and st.read("t").count() == 1
    assert st.recover() == ["2025-03"]
    st.write("2025-04", {"t": spark.range(4)})
    st.publish("2025-04")
    assert st.collect_garbage(1, {"2025-01"}) == ["2025-02"]
    assert st.published() == ["2025-01", "2025-04"]


def test_frames(spark, tmp_path):
    lines = '{"type":"file","id":1,"path":"a","doc":["x","y"]}\n\n{"type":"symbol","id":2,"key":"k","doc":"d","range":[0,0,1,2]}\nnot json\n{"type":"error","source":"tool","message":"m"}\n{"type":"edge","source":2,"target":1,"kind":"calls"}\n'
    (tmp_path / "f.jsonl").write_text(lines)
    got = fr.read_frames(spark, str(tmp_path), strict=False)
    assert got["file"].collect()[0].doc == ["x", "y"] and got["symbol"].collect()[0].doc == "d"
    assert got["error"].collect()[0].source == "tool" and got["edge"].collect()[0].source == 2
    with pytest.raises(fr.BadFrame, match=r"f\.jsonl:4: not json"):
        fr.read_frames(spark, str(tmp_path))


def test_findings_round_trip(spark, tmp_path):
    f = spark.createDataFrame([("fnd_1", "body: x\n---\nmore", ["bug", "a b"], ["fnd_0"], dt.datetime(2025, 1, 2, 3))], "id string, text string, tags array<string>, parent_ids array<string>, created_at timestamp")
    fr.write_findings(f, f"{tmp_path}/f")
    (tmp_path / "f" / "id=x").mkdir()
    (tmp_path / "f" / "id=x" / "junk.txt").write_text("no front matter")
    got = fr.read_findings(spark, f"{tmp_path}/f/*").collect()
    assert [(r.id, r.text.strip(), r.tags, r.parent_ids) for r in got] == [("fnd_1", "body: x\n---\nmore", ["bug", "a b"], ["fnd_0"])]


def test_anchor_log_and_discovery(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "a.jsonl").write_text('{"finding_id":"f","seq":1,"op":"attach","anchor":"p"}\nbroken\n')
    log = fr.read_anchor_log(spark, f"{tmp_path}/l")
    assert [r.anchor for r in log.collect()] == ["p"]
    fr.append_anchor_events(spark.createDataFrame([("f", 2, "detach", "p")], "finding_id string, seq long, op string, anchor string"), f"{tmp_path}/l")
    assert log.sparkSession.read.schema(log.schema).json(f"{tmp_path}/l").where("op = 'detach'").count() == 1
    (tmp_path / "w" / "node_modules").mkdir(parents=True)
    for p in ("a.md", "b.txt", "node_modules/c.md"):
        (tmp_path / "w" / p).write_text("x")
    assert [r.path[-4:] for r in fr.discover(spark, f"{tmp_path}/w", "*.md", ("node_modules",)).collect()] == ["a.md"]


def test_cursors(spark):
    a, b = pg.snapshot_id("r1"), pg.snapshot_id("r2")
    assert pg.read_list_cursor(pg.list_cursor(a, 7), a) == 7
    assert pg.read_usage_cursor(pg.usage_cursor(a, 3, 9), a) == (3, 9)
    with pytest.raises(pg.StaleCursor):
        pg.read_list_cursor(pg.list_cursor(a, 7), b)
    with pytest.raises(ValueError):
        pg.read_list_cursor("??", a)
    rows = spark.range(1, 100)
    seen, last = [], 0
    while page := [r.id for r in pg.after(rows, last, 40).collect()]:
        seen += page
        last = page[-1]
    assert seen == list(range(1, 100))
    assert [r.id for r in pg.page_at(rows, ["id"], 95, 50).collect()] == [96, 97, 98, 99]
    cache = pg.TopCache(2)
    cid = cache.put(a, "q", list(range(25)))
    first = cache.page(a, cid, 0, 10)
    got = list(pg.drain(lambda c: first if c is None else cache.follow(a, c, 10)))
    assert got == list(range(25))
    cache.put(a, "x", [])
    cache.put(a, "y", [])
    with pytest.raises(pg.StaleCursor):
        cache.page(a, cid, 0, 10)


def test_streamed_bursts_equal_batch(spark, tmp_path):
    t0 = dt.datetime(2025, 1, 1)
    rows = [(u, t0 + dt.timedelta(minutes=m)) for u in (1, 2) for m in (0, 5, 40, 41, 300)]
    src = f"{tmp_path}/src"
    df = spark.createDataFrame(rows, "u long, ts timestamp")
    df.coalesce(1).write.parquet(src)
    # a last event far ahead lets the watermark pass everything before it
    spark.createDataFrame([(9, t0 + dt.timedelta(days=9))], df.schema).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    out, ck = f"{tmp_path}/out", f"{tmp_path}/ck"
    q = watch.debounced(stream, "u", "ts", "30 minutes", "1 minute")
    watch.run_once(q, out, ck)
    want = {tuple(r) for r in ss.bursts(df, "u", "ts", "30 minutes").collect()}
    assert {tuple(r) for r in spark.read.parquet(out).collect() if r.key != 9} == want
    n = spark.read.parquet(out).count()
    watch.run_once(q, out, ck)  # nothing new: nothing repeats
    assert spark.read.parquet(out).count() == n


def test_streamed_pairs_and_tail(spark, tmp_path):
    t0 = dt.datetime(2025, 1, 1)
    s = spark.createDataFrame([("a", t0), ("b", t0)], "tool_use_id string, started_at timestamp")
    f = spark.createDataFrame([("a", t0 + dt.timedelta(seconds=5))], "tool_use_id string, finished_at timestamp")
    s.write.parquet(f"{tmp_path}/s")
    f.write.parquet(f"{tmp_path}/f")
    j = watch.paired_commands(spark.readStream.schema(s.schema).parquet(f"{tmp_path}/s"), spark.readStream.schema(f.schema).parquet(f"{tmp_path}/f"), "1 hour", "1 hour")
    watch.run_once(j, f"{tmp_path}/o", f"{tmp_path}/c")
    assert [(r.tool_use_id, r.finished_at) for r in spark.read.parquet(f"{tmp_path}/o").where("finished_at is not null").collect()] == [("a", t0 + dt.timedelta(seconds=5))]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "1.json").write_text('{"a":1}\nxx\n')
    watch.run_once(watch.tail_json(spark, f"{tmp_path}/t", "a long"), f"{tmp_path}/to", f"{tmp_path}/tc")
    assert [r.a for r in spark.read.parquet(f"{tmp_path}/to").collect()] == [1]
