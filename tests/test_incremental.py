from __future__ import annotations

import random

import pytest

from symloom.operators import incremental as inc
from symloom.runtime import Scratch

KEYED = "key string, digest string, leaf long"


def view(spark, d):
    return spark.createDataFrame([(k, v, 1) for k, v in d.items()], KEYED)


def feed(spark, **kw):
    return inc.MerkleFeed(spark, Scratch(spark, "feed").root, **kw)


def taken(f, version):
    return sorted((r.key, r.op) for r in f.output().where(f"version = {version}").collect())


def test_new_changed_and_removed_are_taken_once(spark):
    f = feed(spark)
    state = {f"k{i}": "a" for i in range(300)}
    f.run(1, view(spark, state))
    assert len(taken(f, 1)) == 300
    state |= {"k7": "b", "new": "a"}
    del state["k9"]
    entered = f.run(2, view(spark, state))
    assert entered <= 3  # only the leaves of the three keys are entered
    assert taken(f, 2) == [("k7", "changed"), ("k9", "removed"), ("new", "new")]
    assert f.run(3, view(spark, state)) == 0 and taken(f, 3) == []
    state["k9"] = "a"
    f.run(4, view(spark, state))
    assert taken(f, 4) == [("k9", "new")]


def test_a_run_that_dies_before_its_commit_leaves_no_trace(spark):
    f = feed(spark)
    f.run(1, view(spark, {"a": "1"}))
    f.stage(2, view(spark, {"a": "2", "b": "1"}))  # dies here
    again = inc.MerkleFeed(spark, f.root)
    assert again.committed() == [1]
    again.run(3, view(spark, {"a": "2", "b": "1"}))
    assert taken(again, 3) == [("a", "changed"), ("b", "new")]
    again.stage(2, view(spark, {"a": "3", "b": "1"}))
    again.commit(2)
    assert again.committed() == [1, 3, 2] and taken(again, 2) == [("a", "changed")]
    with pytest.raises(ValueError):
        again.run(3, view(spark, {}))
    with pytest.raises(ValueError):
        again.commit(9)


def test_of_two_writers_one_commits(spark):
    f, g = feed(spark), None
    f.run(1, view(spark, {"a": "1"}))
    g = inc.MerkleFeed(spark, f.root)
    f.stage(2, view(spark, {"a": "2"}))
    g.stage(3, view(spark, {"a": "3"}))
    f.commit(2)
    with pytest.raises(ValueError):
        g.commit(3)
    with pytest.raises(Exception):
        f.files.create_text(f"{f.root}/commits/00000001", "3")
    g.run(3, view(spark, {"a": "3"}))
    assert g.committed() == [1, 2, 3] and taken(g, 3) == [("a", "changed")]


def test_partial_deliveries_and_compaction(spark, monkeypatch):
    monkeypatch.setattr(inc, "COMPACT_EVERY", 3)
    rng = random.Random(8)
    f, state = feed(spark, fanout=4, depth=3), {}
    for run in range(1, 9):
        seen = {f"k{rng.randrange(40)}": str(rng.randrange(3)) for _ in range(10)}
        entered = f.run(run, view(spark, seen), whole=False)
        want = [(k, "new") for k in seen if k not in state] + [(k, "changed") for k in seen if k in state and state[k] != seen[k]]
        state |= seen
        assert taken(f, run) == sorted(want) and entered <= len(want)
        assert {r.key: r.digest for r in f.live().collect()} == state
    assert f.files.children(f"{f.root}/compact") == ["00000003", "00000006"]
    again = inc.MerkleFeed(spark, f.root, fanout=4, depth=3)
    assert again.run(9, view(spark, state)) == 0 and again.run(10, view(spark, {"k1": state.get("k1", "0")}), whole=False) <= 1


def test_the_query_resumes(spark):
    from symloom.plans.data_queries import knowledge_feed

    root = Scratch(spark, "kept").root
    first = knowledge_feed(spark, "/root/testdata/sf0.001", root)
    runs, n = first.committed(), first.output().count()
    again = knowledge_feed(spark, "/root/testdata/sf0.001", root)
    assert again.committed() == runs and again.output().count() == n


def test_nulls_and_empty(spark):
    f = feed(spark, fanout=4, depth=2)
    f.run(1, view(spark, {}))
    f.run(2, spark.createDataFrame([(None, "x", 1), ("a", None, 1)], KEYED))
    assert taken(f, 2) == [("a", "new")]
    f.run(3, view(spark, {"a": ""}))
    assert taken(f, 3) == [("a", "changed")]
    with pytest.raises(ValueError):
        feed(spark, fanout=3)


def test_random_histories_against_a_dictionary(spark):
    rng = random.Random(5)
    f = feed(spark, fanout=4, depth=3)
    state: dict[str, str] = {}
    for run in range(1, 6):
        before = dict(state)
        for _ in range(12):
            k = f"k{rng.randrange(30)}"
            if rng.random() < 0.2:
                state.pop(k, None)
            else:
                state[k] = str(rng.randrange(3))
        f.run(run, view(spark, state))
        want = [(k, "new") for k in state if k not in before] + [(k, "changed") for k in state if k in before and before[k] != state[k]] + [(k, "removed") for k in before if k not in state]
        assert taken(f, run) == sorted(want)


def test_latest_versions(spark):
    rows = spark.createDataFrame(
        [(1, "a", "x", 1, 1), (1, "a", "y", 1, 2), (1, "a", None, 0, 9), (1, "b", None, 1, 3), (1, "b", "", 1, 3), (None, "a", "x", 1, 1), (1, None, "x", 1, 1)],
        "run long, k string, doc string, at int, id int",
    )
    got = {r.key: r.digest for r in inc.latest_versions(rows, "run", "k", "doc", ["at", "id"]).collect()}
    import hashlib

    assert got == {"a": hashlib.sha256(b"y").hexdigest(), "b": hashlib.sha256(b"").hexdigest()}
