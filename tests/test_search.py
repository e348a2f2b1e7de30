"""Rankings against SQLite's FTS5, an independent implementation."""

from __future__ import annotations

import random
import sqlite3

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from symloom.functions.hashing import xxh3_64
from symloom.functions.identifiers import split_identifier
from symloom.functions.porter import porter, stem
from symloom.operators import search as se

WORDS = "open close reader writer buffer opened closing buffers streams stream resolved resolution resolver index".split()


def corpus():
    rng = random.Random(6)
    return [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(3, 25)))) for i in range(1, 120)]


def fts(rows, tokenizer, match):
    try:
        con = sqlite3.connect(":memory:")
        con.execute(f"create virtual table t using fts5(x, tokenize='{tokenizer}')")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5 here")
    con.executemany("insert into t(rowid, x) values (?, ?)", rows)
    return {r: -s for r, s in con.execute("select rowid, bm25(t) from t where t match ?", (match,))}


def test_words_rank_as_fts5(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "id long, text string")
    q = spark.createDataFrame([(1, "reader stream")], "qid long, q string")
    got = {r.id: r.score for r in se.word_scores(df, q).collect()}
    want = fts(rows, "unicode61", '"reader" OR "stream"')
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_stems_rank_as_fts5(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "id long, text string")
    post = df.select("id", F.explode(se.words(F.col("text"))).alias("w")).select("id", porter("w").alias("word")).groupBy("id", "word").agg(F.count(F.lit(1)).alias("n"))
    q = spark.createDataFrame([(1, stem("resolving"))], "qid long, q string")
    got = {r.id: r.score for r in se.word_scores(df, q, post).collect()}
    want = fts(rows, "porter unicode61", '"resolving"')
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_substrings_rank_as_fts5(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "id long, text string")
    q = spark.createDataFrame([(1, "esol"), (2, "re"), (3, "Reader B")], "qid long, q string")
    got = {(r.qid, r.id): r.score for r in se.substring_scores(df, q).collect()}
    for qid, match in ((1, '"esol"'), (3, '"Reader B"')):
        want = fts(rows, "trigram", match)
        mine = {k[1]: v for k, v in got.items() if k[0] == qid}
        assert mine.keys() == want.keys() and all(abs(mine[k] - want[k]) < 1e-9 for k in want)
    assert not [k for k in got if k[0] == 2]


def test_porter_examples():
    for w, s in {"caresses": "caress", "ponies": "poni", "hopping": "hop", "falling": "fall", "happy": "happi", "relational": "relat", "generalization": "gener", "adjustment": "adjust", "controll": "control", "rate": "rate"}.items():
        assert stem(w) == s


def test_identifiers(spark):
    cases = {"parseUserID": "parse user id", "HTTPServer2Go": "http server 2 go", "snake_case-x": "snake case x", "": "", "ABC": "abc", "v2": "v 2"}
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    assert {r.n: r.w for r in df.select("n", split_identifier(F.col("n")).alias("w")).collect()} == cases


def test_knn_is_exact_in_blocks(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, vec array<float>").repartition(5)
    q = df.where("id % 20 = 0").withColumnRenamed("id", "qid")
    got = {}
    for r in se.knn(df, q, 4, block=3).collect():
        got.setdefault(r.qid, []).append((r.rn, r.id))
    f = v.astype(np.float32).astype(float)
    u = f / np.linalg.norm(f, axis=1, keepdims=True)
    for i in range(0, 300, 20):
        assert [x for _, x in sorted(got[i])] == list(np.argsort(1 - u @ u[i], kind="stable")[:4])
    assert se.knn(df, q.where("false"), 4).count() == 0 and se.knn(df.where("false"), q, 4).count() == 0


def test_xxh3(spark):
    texts = ["", "a", "größe", None, "x" * 5_000]
    got = {r.t: r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", xxh3_64("t").alias("h")).collect()}
    for t in texts:
        want = None if t is None else np.uint64(xxhash.xxh3_64_intdigest(t.encode())).astype(np.int64)
        assert got[t] == want
