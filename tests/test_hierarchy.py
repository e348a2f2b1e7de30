from __future__ import annotations

import random

import duckdb

from symloom.operators import hierarchy as h
from symloom.plans import ORACLES
from symloom.plans import data_queries as dq
from symloom.runtime import Scratch


def brute(parent):
    out = {}
    for n in parent:
        path, x = [n], n
        while parent[x] is not None and parent[x] not in path:
            x = parent[x]
            path.append(x)
        if parent[x] is None:
            out[n] = (x, len(path) - 1)
        else:
            out[n] = (min(path[path.index(parent[x]) :]), -1)
    return out


def run(spark, parent, label=None):
    links = spark.createDataFrame([(k, v) for k, v in parent.items()], "id long, parent long")
    return h.hierarchy(links, Scratch(spark, "h"), label).collect()


def check(spark, parent):
    rows = run(spark, parent)
    assert {r.id: (r.root_id, r.depth) for r in rows} == brute(parent)
    good = [r for r in rows if r.depth >= 0]
    by = {r.id: r for r in good}
    for u in good:
        up, x = set(), u.id
        while parent[x] is not None:
            x = parent[x]
            up.add(x)
        inside = {v.id for v in good if v.root_id == u.root_id and v.lft < u.lft < v.lft + v.size}
        assert inside == up
        assert by[u.id].size == 1 + sum(1 for v in good if v.root_id == u.root_id and u.lft < v.lft < u.lft + u.size)


def test_random_forests_with_loops(spark):
    rng = random.Random(1)
    for n in (1, 60):
        check(spark, {i: (None if rng.random() < 0.15 else rng.randrange(n)) for i in range(n)})


def test_long_chain_star_and_loops(spark):
    chain = {i: (i - 1 if i else None) for i in range(70)}
    star = {i: (100 if i > 100 else None) for i in range(100, 140)}
    loops = {200: 200, 201: 202, 202: 203, 203: 201, 204: 201, 205: 204, 210: 211, 211: 210}
    check(spark, chain | star | loops)


def test_paths_and_empty(spark):
    label = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, name string")
    got = {r.id: r.path for r in run(spark, {1: None, 2: 1, 3: 2}, label)}
    assert got == {1: "a", 2: "a/b", 3: "a/b/3"}
    assert run(spark, {}) == []


def test_latest_links(spark):
    rows = spark.createDataFrame(
        [(1, 0, 1, "x"), (2, 1, 1, "x"), (2, None, 2, "x"), (2, 1, 3, "x"), (3, 99, 1, "x"), (4, 1, 1, "x"), (4, 2, 1, "x"), (None, 1, 1, "x"), (5, None, None, "x")],
        "id long, up long, at int, parent string",
    )
    got = {r.id: r.parent for r in h.latest_links(rows, "id", "up", "at").collect()}
    assert got == {1: None, 2: 1, 3: None, 4: 2, 5: None}


def test_ranges_give_all_ancestors_and_descendants(spark, monkeypatch):
    monkeypatch.setattr(h, "POSITIONS", 7)
    rng = random.Random(11)
    parent = {i: rng.choice([None, *range(max(1, i - 6), i)]) if i > 1 else None for i in range(1, 150)} | {200: 201, 201: 200, 202: 200}
    nodes = h.hierarchy(spark.createDataFrame(list(parent.items()), "id long, parent long"), Scratch(spark, "t"))
    want = set()
    for i in range(1, 150):
        p = parent[i]
        while p:
            want.add((p, i))
            p = parent[p]
    of = spark.createDataFrame([(i,) for i in [*parent, 3, 3, None, 999]], "id long")
    got = [tuple(r) for r in h.descendants(nodes, of).collect()]
    assert set(got) == want and len(got) == len(want)
    got = [(r.ancestor, r.id) for r in h.ancestors(nodes, of).collect()]
    assert set(got) == want and len(got) == len(want)
    assert h.descendants(nodes.where("false"), of).count() == 0


def test_listings_of_all_symbols(spark, tmp_path):
    parent = {1: 0, 2: 1, 3: 2, 20: 3, 21: 20, 22: 99, 23: 22, 30: 31, 31: 30, 32: 30, -7: 23}  # 99 is absent, 30 and 31 a loop
    rows = [(k, v, 2, "x") for k, v in parent.items()] + [(2, 23, 1, "x"), (3, 2, 2, "x"), (None, 1, 2, "x")]
    spark.createDataFrame(rows, "id long, enclosing_sym_id long, loaded_at int, name string").write.parquet(f"{tmp_path}/symbols.parquet")
    want = {(1, 2), (1, 3), (1, 20), (1, 21), (2, 3), (2, 20), (2, 21), (3, 20), (3, 21), (20, 21), (22, 23), (22, -7), (23, -7)}
    con = duckdb.connect()
    con.execute(f"create view symbols as select * from '{tmp_path}/symbols.parquet/*.parquet'")
    for listing, top, low in ((dq.p2_all_descendants, "sym_id", "descendant"), (dq.p2_all_ancestors, "ancestor", "sym_id")):
        got = [(r[top], r[low]) for r in listing(spark, str(tmp_path)).collect()]
        assert set(got) == want and len(got) == len(want)
        assert sorted(con.execute(f"select {top}, {low} from ({ORACLES[listing.__name__]})").fetchall()) == sorted(want)
