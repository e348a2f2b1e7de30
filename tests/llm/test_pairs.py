from __future__ import annotations

import pytest

from symloom.llm import pairs

SIG = "pub fn fold_slot(shard: &str) -> u32"


@pytest.mark.parametrize(
    "doc",
    [None, "", " \n", "TODO", "n/a", "...", "Fold slot.", "Folds the slot.", "Function that folds slot", "foldSlot()", SIG, "@param shard\n@return", "@param shard the shard", ":param shard: the shard\n:return: value",
     "See base class.", "{@inheritDoc}", "<inheritdoc/>", "<summary></summary>", "// let x = fold(shard);\n// return x;", "////// slot //////", "---- helpers ----", "noqa: E501", "#pragma warning disable", "@generated",
     "Bla bla.", "Placeholder text, replace later.", "See the reader for details.", "Overrides run.", "Copyright 2025 the authors. All rights reserved.", "Licensed under the X terms, see the LICENSE file.", "Code generated from a.proto. DO NOT EDIT.\nsource: api/a.proto", "Args:\n    shard: shard\nReturns:\n    slot",
     "Copyright 2024 the Y contributors.\n\nThis file is part of Y. It may be used, copied and changed under the\nterms of the Z licence, version 2. It comes without any warranty.\nSee the file COPYING for the details."],
)
def test_says_nothing(doc):
    assert pairs.pair("fold_slot", SIG, doc)[2] == ""


@pytest.mark.parametrize(
    "doc",
    ["Implements the Kahan summation so the error stays constant.", "See RFC 791 for why the checksum skips the TTL.", "Overrides retries when the network is slow.", "Replaces text later than the cursor.", "Idempotent.", "Not thread-safe.", "Returns -1 when the anchor is absent.", "O(n) in the number of facets.", "Folds the slot in place; copies are kept.", "@param shard must not be empty",
     "Licensed under the X terms.\n\nPanics on odd input.", "Nur für den Leser gedacht.", "<summary>Waits until all is written.</summary>"],
)
def test_says_something(doc):
    assert pairs.pair("fold_slot", SIG, doc)[2]


def test_description_in_the_signature():
    d, n, text = pairs.pair("x", "/// Waits for the lock.\n#[inline]\npub fn x(a: u32) -> u32", None)
    assert (d, n, text) == ("#[inline]\npub fn x(a: u32) -> u32", "x(u32)", "Waits for the lock.")
    assert pairs.pair("x", 'def x(a: int) -> int:\n    """Waits for the lock."""', "")[2] == "Waits for the lock."
    assert pairs.pair("x", "/**\n * Waits for the lock.\n */\nint x()", None)[2] == "Waits for the lock."


def test_normal_signatures():
    same = ["pub fn f(a: u32, b: Vec<Row>) -> u32", "#[inline]\npub fn f(x: u32,\n    y: Vec<Row>) -> u32"]
    assert len({pairs.normal_signature(s) for s in same}) == 1
    assert pairs.normal_signature("public int F(List<A> x, string y)") == "F(List<A>,string)"
    assert pairs.normal_signature("func (s *Store) F(a int) string") == "F(int)" or "F" in pairs.normal_signature("func (s *Store) F(a int) string")
    assert pairs.normal_signature("") == ""


def test_rows(spark):
    symbols = spark.createDataFrame(
        [(1, "rs:a::f~1", "function", "f", "2025-01-01", 1), (1, "rs:a::f~1", "function", "f", "2025-01-02", 1), (2, "rs:a::g~2", "class", "g", "2025-01-01", 1), (3, "rs:a::f~3", "function", "f", "2025-01-01", 1), (None, None, None, None, None, 1)],
        "id long, pub_id string, kind string, name string, loaded_at string, doc int",
    )
    docs = spark.createDataFrame(
        [(1, "fn f()", "Keeps the order.", 1), (1, "fn f()", "Keeps the order.", 2), (2, "class g", "Keeps the order.", 1), (9, "fn h()", "Keeps the order.", 1), (1, None, "TODO", 1), (None, None, "x", 1)],
        "sym_id long, sig string, doc string, name int",
    )
    defs = spark.createDataFrame([(1, 5, 10, 12, 20, "2025-01-01"), (3, 6, 1, 2, 9, "2025-01-01"), (1, 0, 0, 0, 0, "2025-02-01")], "sym_id long, file_id long, start_line int, body_start_line int, body_end_line int, loaded_at string")
    files = spark.createDataFrame([(5, "a.rs", "2025-01-01"), (6, "b.rs", "2025-01-01")], "id long, path string, loaded_at string")
    assert [r.sym_id for r in pairs.documented(symbols, docs).select("sym_id").distinct().collect()] == [1]
    got = pairs.function_pairs(symbols, docs, defs, files).collect()
    assert sorted((r.sym_id, r.path, r.body_start_line) for r in got) == [(1, "a.rs", 12), (1, "b.rs", 2)]
    assert pairs.documented(symbols, docs.where("false")).count() == 0


def test_overloads_are_told_by_their_signatures(spark):
    # f(int) and f(str) are each declared in one file and defined under another id; g's second overload is undocumented
    symbols = spark.createDataFrame(
        [(i, f"cpp:a::{n}~{i}", "function", n, "2025-01-01") for i, n in ((1, "f"), (2, "f"), (3, "f"), (4, "f"), (5, "g"), (6, "g"), (7, "f"))],
        "id long, pub_id string, kind string, name string, loaded_at string",
    )
    docs = spark.createDataFrame(
        [(1, "int f(int a)", "Keeps the order."), (2, "int f(string a)", "Drops blank rows."), (3, "int f(int x)", None), (4, "int f(string x)", ""), (5, "int g(int a)", "Waits for the lock."), (6, "int g(string a)", "TODO")],
        "sym_id long, sig string, doc string",
    )
    defs = spark.createDataFrame([(i, i, 10, i, 20, "2025-01-01") for i in (3, 4, 6, 7)], "sym_id long, file_id long, start_line int, body_start_line int, body_end_line int, loaded_at string")
    files = spark.createDataFrame([(i, f"{i}.cc", "2025-01-01") for i in range(1, 8)], "id long, path string, loaded_at string")
    got = sorted((r.sym_id, r.norm_sig, r.path or "") for r in pairs.function_pairs(symbols, docs, defs, files).collect())
    # 7 has no declaration and f has two signatures: it belongs to neither
    assert got == [(1, "f(int)", "3.cc"), (2, "f(string)", "4.cc"), (5, "g(int)", "")]


def test_a_name_of_many_definitions_is_no_product(spark):
    n = 300
    symbols = spark.createDataFrame([(i, f"cpp:a::f~{i}", "function", "f", "2025-01-01") for i in range(1, 2 * n + 1)], "id long, pub_id string, kind string, name string, loaded_at string")
    docs = spark.createDataFrame([(i, "int f(int a)", "Keeps the order.") for i in range(1, n + 1)], "sym_id long, sig string, doc string")
    defs = spark.createDataFrame([(i, 1, 10, i, i, f"2025-01-01 {i:05d}") for i in range(n + 1, 2 * n + 1)], "sym_id long, file_id long, start_line int, body_start_line int, body_end_line int, loaded_at string")
    files = spark.createDataFrame([(1, "a.cc", "2025-01-01")], "id long, path string, loaded_at string")
    got = pairs.function_pairs(symbols, docs, defs, files).collect()
    assert {(r.def_id, r.n_definitions) for r in got} == {(2 * n, n)} and sorted(r.sym_id for r in got) == list(range(1, n + 1))
