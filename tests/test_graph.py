"""Small graphs: communities, roll-up, anchor logs, sessions, links."""

from __future__ import annotations

import datetime as dt

from symloom.operators import analytics as an
from symloom.operators import axes as ax
from symloom.operators import findings as fd
from symloom.operators import rollup as ru
from symloom.operators import sessions as ss
from symloom.operators import traversal as tr
from symloom.runtime import Scratch


def two_triangles(spark, ids):
    a, b, c, d, e, f = ids
    edges = [(a, b, 5), (b, c, 5), (a, c, 5), (d, e, 5), (e, f, 5), (d, f, 5), (c, d, 2)]
    return spark.createDataFrame([(min(x, y), max(x, y), w) for x, y, w in edges], "a long, b long, weight long"), spark.createDataFrame([(i, "p") for i in ids], "id long, part string")


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r[1], set()).add(r[0])
    return {frozenset(v) for v in out.values()}


def test_two_triangles_split_whatever_their_ids(spark):
    for ids in ((1, 2, 3, 4, 5, 6), (6, 5, 4, 3, 2, 1), (10, 3, 77, 5, 21, 8)):
        pairs, nodes = two_triangles(spark, ids)
        m = an.communities(nodes, pairs, Scratch(spark, "c"))
        assert groups(m.collect()) == {frozenset(ids[:3]), frozenset(ids[3:])}
        assert an.modularity(pairs, m).collect()[0][0] > 0.3
        dense = sorted(r.community_id for r in an.dense_communities(m, Scratch(spark, "t")).collect())
        assert dense == [0, 0, 0, 1, 1, 1]


def test_nodes_without_edges_stay_alone_and_parts_do_not_mix(spark):
    pairs, _ = two_triangles(spark, (1, 2, 3, 4, 5, 6))
    nodes = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q"), (4, "q"), (9, None)], "id long, part string")
    got = groups(an.communities(nodes, pairs, Scratch(spark, "c")).collect())
    assert got == {frozenset({1, 2}), frozenset({3, 4}), frozenset({9})}


def test_aggregate_ids_with_loops_and_externals(spark):
    s = spark.createDataFrame(
        [(1, "module", 0, False), (2, "class", 1, False), (3, "method", 2, False), (4, "function", 1, False), (5, "module", 0, True), (6, "function", 5, False), (7, "function", 8, False), (8, "function", 7, False), (9, "function", 99, False), (10, "function", 10, False)],
        "id long, kind string, enclosing_sym_id long, external boolean",
    )
    got = {r.id: r.agg_id for r in ru.aggregate_ids(s, Scratch(spark, "a")).collect()}
    assert got == {1: 1, 2: 2, 3: 2, 4: 1, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9, 10: 10}


def test_roles(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(100, 1, 0, 9), (0, 50, 0, 9), (50, 50, 0, 9), (0, 0, 0, 9), (5, 5, 5, 9)], "i long, o long, t long, n long")
    got = [r[0] for r in df.select(ax.role(F.col("i"), F.col("o"), F.col("t"), F.col("n"))).collect()]
    assert got == ["provider", "consumer", "layer", "isolated", "tests"]


def test_one_reference_split_over_kinds_is_no_span(spark):
    nodes = spark.createDataFrame([(i, "class", f"n{i}", "rust", False, False, False, "a" if i < 4 else "b") for i in range(1, 7)], "id long, kind string, name string, language string, external boolean, test boolean, example boolean, anchor_name string")
    m = spark.createDataFrame([(i, 1) for i in range(1, 7)], "id long, community_id long")
    one = spark.createDataFrame([(1, 4, "calls", 3), (1, 4, "type_use", 2)], "src_id long, dst_id long, kind string, weight long")
    assert ax.domains(nodes, one, m, Scratch(spark, "t")).count() == 0
    two = one.union(spark.createDataFrame([(2, 5, "calls", 3)], one.schema))
    assert [(r.size, r.n_links, r.n_packages, r.hub) for r in ax.domains(nodes, two, m, Scratch(spark, "t")).collect()] == [(6, 2, 2, "n1")]


def test_renames_carry_the_past_along(spark):
    t = dt.datetime(2025, 1, 1)
    ev = spark.createDataFrame(
        [("f", 1, "attach", "a", None, None, t, "s1", None), ("f", 2, "rename", None, "a", "b", t, None, None), ("f", 3, "attach", "b", None, None, t, "s2", None), ("f", 4, "rename", None, "b", "c", t, None, None), ("f", 5, "attach", "a", None, None, t, "s3", None)],
        "finding_id string, seq long, op string, anchor string, `from` string, `to` string, ts timestamp, sha string, outcome string",
    )
    got = {(r.anchor, r.attach_count) for r in fd.fold_anchors(fd.resolve_renames(ev, 4)).collect()}
    assert got == {("c", 2), ("a", 1)}


def test_clamped_counter_is_the_running_fold(spark):
    import random

    rng = random.Random(3)
    rows = [(f"s{rng.randrange(4)}", i, rng.choice([1, -1, -1, 1])) for i in range(200)]
    want: dict[str, int] = {}
    for s, _, d in rows:
        want[s] = max(0, want.get(s, 0) + d)
    df = spark.createDataFrame(rows, "session string, seq long, delta int")
    assert {r.session: r.n for r in ss.clamped_count(df).collect()} == want


def test_signatures():
    cases = {"cargo test -q x": "cargo test", "A=1 /usr/bin/git -C . status": "git .", "ls": "ls", "": None, None: None, "echo 'unclosed": "echo 'unclosed"}
    assert {k: ss.signature_of(k) for k in cases} == cases


def test_closure_with_a_cycle(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), (None, "x")], "src string, dst string")
    got = {tuple(r) for r in tr.closure(df, Scratch(spark, "cl")).collect()}
    assert got == {(x, y) for x in "abc" for y in "abcd"}


def test_unknown_package_name_matches_nothing(spark):
    nodes = spark.createDataFrame([(1, "x", 1, False, False, "class", "rust")], "id long, name string, pkg_id long, external boolean, test boolean, kind string, language string")
    packages = spark.createDataFrame([(1, "p")], "id long, name string")
    assert tr.Narrow(packages=("nope",)).apply(nodes, packages).count() == 0
    assert tr.Narrow(packages=("nope", "p")).apply(nodes, packages).count() == 1


def test_signatures_of_redirected_piped_and_quoted_commands(spark, tmp_path):
    import __spark_entry__ as entry

    cases = {
        "lintall test --pkg x > out/y.log": "lintall test", "ls > out.log": "ls", "ls 2>err.log src": "ls src", "ls | grep x": "ls", "make -j;git status": "make", "B='a b' run \"my file\" >>log": "run my file",
        "cargo build --all": "cargo build", "(cd src && ls)": "cd src", "echo \">\" x": "echo >", "git": "git", "./tools/run.sh -v a/b": "run.sh a/b",
    }
    assert {k: ss.signature_of(k) for k in cases} == cases
    rows = [(k,) for k in cases] + [(None,), ("git",)]
    spark.createDataFrame(rows, "cmd_text string").write.parquet(f"{tmp_path}/commands.parquet")
    got = entry.queries()["e7_all_signatures"](spark, str(tmp_path)).collect()
    assert len(got) == len(cases) and {r.cmd_text: r.signature for r in got} == cases


def test_provenance_over_findings_with_a_cycle(spark):
    parents = {"fnd_1": ["code:a"], "fnd_2": ["fnd_1", "code:b"], "fnd_3": ["fnd_2", None], "fnd_4": ["fnd_5"], "fnd_5": ["fnd_4", "fnd_gone"], "fnd_6": None, "code:b": ["code:c"]}
    f = spark.createDataFrame(list(parents.items()), "id string, parent_ids array<string>")

    def before(start):
        seen, todo = set(), list(parents[start] or [])
        while todo:
            x = todo.pop()
            if x and x not in seen:
                seen.add(x)
                todo += (parents.get(x) or []) if x.startswith("fnd_") else []
        return seen

    def after(start):
        reached, size = {start}, 0
        while len(reached) > size:
            size = len(reached)
            reached |= {i for i, ps in parents.items() if reached & set(ps or [])}
        return reached - {start}

    got = sorted(map(tuple, tr.predecessors(f, Scratch(spark, "p")).collect()))
    assert got == sorted((i, x) for i in parents for x in before(i))
    assert ("fnd_3", "code:a") in got and ("fnd_3", "code:c") not in got
    starts = {*parents, "code:a", "code:c", "fnd_gone"}
    assert sorted(map(tuple, tr.successors(f, Scratch(spark, "s")).collect())) == sorted((i, x) for i in starts for x in after(i))


def fold_in_order(events):
    state = {}
    for f, _, op, a, old, new, ts, sha, outcome in sorted(events, key=lambda e: e[:2]):
        s = state.setdefault(f, {})
        if op == "attach":
            e = s.setdefault(a, [0, ts, None, None, None, None])
            e[2] = sha if ts >= e[1] else e[2]
            e[0], e[1], e[3] = e[0] + 1, max(ts, e[1]), e[3] or sha
        elif op == "verify":
            s.setdefault(a, [0, ts, None, None, None, None])[4:] = [outcome, sha]
        elif op == "detach":
            s.pop(a, None)
        elif old in s:
            e = s.pop(old)
            if new in s:
                n = e[0] + s[new][0]
                e = [n, *(e if e[1] >= s[new][1] else s[new])[1:]]
            s[new] = e
    return sorted((f, a, *e) for f, s in state.items() for a, e in s.items())


LOG = "finding_id string, seq long, op string, anchor string, `from` string, `to` string, ts timestamp, sha string, outcome string"


def test_whole_logs_fold_as_in_order(spark):
    import random

    rng = random.Random(4)
    day = lambda: dt.datetime(2025, 1, 1) + dt.timedelta(days=rng.randrange(60))
    rows = []
    for i in range(600):
        op = rng.choice(("attach", "attach", "verify", "detach", "rename"))
        f, paths = f"f{rng.randrange(5)}", "abcd" if op == "rename" else "abcdefgh"
        a, b = rng.sample(paths, 2)
        rows.append((f, i, op, *((None, a, b) if op == "rename" else (a, None, None)), day(), rng.choice(("s1", "s2", "s3")), rng.choice(("x", "y"))))
    # a chain of 20 renames, longer than one round of resolve_renames
    rows += [("g", 0, "attach", "p0", None, None, day(), "s1", None)] + [("g", i + 1, "rename", None, f"p{i}", f"p{i + 1}", day(), None, None) for i in range(20)]
    ev = spark.createDataFrame(rows, LOG)
    got = fd.fold_log(ev).select("finding_id", "anchor", "attach_count", "recency", "sha", "origin_sha", "outcome", "verified_sha")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(fold_in_order(rows), key=str)
    assert [r.anchor for r in fd.resolve_renames(ev.where("finding_id = 'g'")).collect()] == ["p20"]


def test_owner_far_above_an_element(spark):
    from symloom.operators import content as co

    rows = [("d", i, i - 1 if i else None, "top" if i == 0 else None) for i in range(150)] + [("e", i, i - 1 if i else None, None) for i in range(100)]
    got = co.element_ids(spark.createDataFrame(rows, "key string, ordinal int, parent int, id string")).collect()
    assert len(got) == 250 and {(r.key, r.owner) for r in got} == {("d", 0), ("e", -1)}


def one_by_one(pairs: list[tuple[int, int, int]]) -> dict[int, int]:
    """Single-level modularity optimisation, node by node in the order of ids, until no node moves."""
    near: dict[int, dict[int, int]] = {}
    for a, b, w in pairs:
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = w
    k = {n: sum(x.values()) for n, x in near.items()}
    m2, home, total = sum(k.values()), {n: n for n in near}, dict(k)
    for _ in range(50):
        moved = False
        for n in sorted(near):
            into: dict[int, float] = {}
            for v, w in near[n].items():
                into[home[v]] = into.get(home[v], 0) + w
            total[home[n]] -= k[n]
            gain = {c: w - total[c] * k[n] / m2 for c, w in into.items()}
            stay = gain.get(home[n], -total[home[n]] * k[n] / m2)
            best = max(gain, key=lambda c: (gain[c], -c))
            if gain[best] > stay + 1e-9:
                home[n], moved = best, True
            total[home[n]] += k[n]
        if not moved:
            break
    return home


def test_communities_are_as_modular_as_a_sequential_pass(spark):
    import random

    rng = random.Random(12)
    edges: dict[tuple[int, int], int] = {}
    for _ in range(2_400):
        a = rng.randrange(240)
        b = (a // 20 * 20 + rng.randrange(20)) if rng.random() < 0.8 else rng.randrange(240)
        if a != b:
            edges[min(a, b), max(a, b)] = edges.get((min(a, b), max(a, b)), 0) + 1
    rows = [(a, b, w) for (a, b), w in edges.items()]
    pairs = spark.createDataFrame(rows, "a long, b long, weight long")
    nodes = spark.range(240).selectExpr("id", "'p' part")
    ours = an.modularity(pairs, an.communities(nodes, pairs, Scratch(spark, "c"))).collect()[0][0]
    theirs = an.modularity(pairs, spark.createDataFrame(list(one_by_one(rows).items()), "id long, community long")).collect()[0][0]
    assert ours >= 0.97 * theirs, (ours, theirs)
