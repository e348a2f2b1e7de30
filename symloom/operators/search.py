"""Lexical, vector and hybrid search for a batch of queries: one plan answers all (qid, q)."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.functions.identifiers import split_identifier

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
EXACT_BOOST, RRF_K = 10.0, 60
DOC_ARM_WEIGHT = 0.7


def bm25(idf: Column, tf: Column, length: Column, average: Column) -> Column:
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def idf(n_rows: Column, n_with: Column) -> Column:
    raw = F.log((n_rows - n_with + 0.5) / (n_with + 0.5))
    return F.when(raw <= 0, F.lit(IDF_FLOOR)).otherwise(raw)


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def word_scores(docs: DataFrame, queries: DataFrame, tokens: DataFrame | None = None) -> DataFrame:
    """qid, id, score: BM25 of rows (id, text) that hold any query word; the words of a query are alternatives.

    ``tokens`` (id, word, n) may give ready postings. The query words, few and small, are joined to the
    postings; document counts come from the same postings.
    """
    post = tokens if tokens is not None else docs.select("id", F.explode(words(F.col("text"))).alias("word")).groupBy("id", "word").agg(F.count(F.lit(1)).alias("n"))
    lengths = post.groupBy("id").agg(F.sum("n").alias("len"))
    size = docs.agg(F.count(F.lit(1)).alias("rows"))
    total = lengths.agg(F.sum("len").alias("total"))
    terms = queries.select("qid", F.explode(F.array_distinct(words(F.col("q")))).alias("word"))
    hits = post.join(terms, "word")
    df = hits.select("word", "id").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    j = hits.join(df, "word").join(lengths, "id").crossJoin(size).crossJoin(total)  # one row each
    part = bm25(idf(F.col("rows"), F.col("df")), F.col("n"), F.col("len"), F.col("total") / F.col("rows"))
    return j.groupBy("qid", "id").agg(F.sum(part).alias("score"))


def substring_scores(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, id, score: BM25 of rows (id, text) that hold the whole query, case ignored, as a trigram index ranks it.

    Queries of fewer than three letters or digits match nothing. Rows and queries meet on the query's first
    trigram, so rows that lack it are never compared.
    """
    q = queries.select("qid", F.lower("q").alias("q")).where(F.length(F.regexp_replace("q", r"[^\p{L}\p{N}]", "")) >= 3)
    r = rows.select("id", F.lower("text").alias("text")).where("text is not null")
    sizes = r.agg(F.count(F.lit(1)).alias("rows"), F.avg(F.greatest(F.length("text") - 2, F.lit(0))).alias("average"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text") - 2), lambda i: F.substring(F.col("text"), i, F.lit(3))))
    # postings are ids only: the text is fetched again for the rows that hold a query's first trigram
    post = r.where(F.length("text") >= 3).select("id", F.explode(grams).alias("gram"))
    met = post.join(q.select("qid", "q", F.substring("q", 1, 3).alias("gram")), "gram").select("qid", "q", "id").distinct()
    hit = met.join(r, "id").where(F.col("text").contains(F.col("q")))
    # overlapping occurrences
    at = F.sequence(F.lit(1), F.greatest(F.length("text") - F.length("q") + 1, F.lit(1)))
    tf = F.size(F.filter(at, lambda i: F.substring(F.col("text"), i, F.length("q")) == F.col("q")))
    hit = hit.select("qid", "id", tf.alias("tf"), F.length("text").alias("n"))
    df = hit.groupBy("qid").agg(F.count(F.lit(1)).alias("df"))
    j = hit.join(df, "qid").crossJoin(sizes)  # one row
    return j.select("qid", "id", bm25(idf(F.col("rows"), F.col("df")), F.col("tf"), F.greatest(F.col("n") - 2, F.lit(0)), F.col("average")).alias("score"))


def top(scored: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each query with their rank ``rn``."""
    return scored.withColumn("rn", F.row_number().over(Window.partitionBy("qid").orderBy(*order))).where(F.col("rn") <= k)


def _live(symbols: DataFrame, external: bool, tests: bool) -> DataFrame:
    s = symbols if external else symbols.where("not external")
    return s if tests else s.where("not test")


def by_name(symbols: DataFrame, queries: DataFrame, limit: int, external: bool = False, tests: bool = False) -> DataFrame:
    """qid, id, score, rank: substring search in names; a pool of candidates is cut before the filter, an exact name is boosted."""
    pool = top(substring_scores(symbols.select("id", F.col("name").alias("text")), queries), max(4 * limit, 50), F.desc("score"), F.col("id"))
    rows = pool.drop("rn").join(_live(symbols, external, tests), "id").join(queries, "qid")
    rows = rows.withColumn("score", F.col("score") + F.when(F.lower("name") == F.lower("q"), EXACT_BOOST).otherwise(0.0))
    out = top(rows, limit, F.desc(F.round("score", 9)), F.length("name"), F.col("id"))
    return out.select("qid", "id", "score", F.col("rn").alias("rank"))


def by_words(symbols: DataFrame, queries: DataFrame, limit: int, external: bool = False, tests: bool = False) -> DataFrame:
    """qid, id, score: any word of the split name, cut to ``limit`` before the filter."""
    split = symbols.select("id", split_identifier(F.col("name")).alias("text"))
    q = queries.select("qid", split_identifier(F.col("q")).alias("q"))
    pool = top(word_scores(split, q), limit, F.desc(F.round("score", 9)), F.col("id"))
    return pool.join(_live(symbols, external, tests).select("id"), "id").select("qid", "id", "score")


def tiered(symbols: DataFrame, queries: DataFrame, limit: int, external: bool = False, tests: bool = False) -> DataFrame:
    """qid, id, match, rank: exact names, then word matches (fuzzy), then substrings; the first tier of an id counts."""
    live = _live(symbols, external, tests)
    exact = queries.join(live, F.lower("q") == F.col("name_lower")).select("qid", "id", F.lit(0).alias("tier"), F.lit(0.0).alias("score"))
    fuzzy = by_words(symbols, queries, limit, external, tests).select("qid", "id", F.lit(1).alias("tier"), "score")
    inner = by_name(symbols, queries, limit, external, tests).select("qid", "id", F.lit(2).alias("tier"), "score")
    best = exact.unionByName(fuzzy).unionByName(inner).groupBy("qid", "id").agg(F.min(F.struct("tier", (-F.round("score", 9)).alias("s"))).alias("m"))
    out = top(best.select("qid", "id", "m.tier", "m.s"), limit, F.col("tier"), F.col("s"), F.col("id"))
    match = F.when(F.col("tier") == 0, "exact").when(F.col("tier") == 1, "fuzzy").otherwise("contains")
    return out.select("qid", "id", match.alias("match"), F.col("rn").alias("rank"))


def name_arm(symbols: DataFrame, queries: DataFrame, pool: int) -> DataFrame:
    """qid, id, rn: exact, then prefix, then contained names, each by length and id up to the pool."""
    q = queries.select("qid", F.lower(F.trim("q")).alias("q")).where("q <> ''")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("name_lower"), F.lit(1))), lambda i: F.substring(F.col("name_lower"), i, F.lit(2))))
    s = symbols.select("id", "name_lower")
    # names and queries meet on two letters; a query of one letter meets every name's single letters
    meet = s.select("id", "name_lower", F.explode(F.array_union(grams, F.transform(grams, lambda g: F.substring(g, F.lit(1), F.lit(1))))).alias("g"))
    j = meet.join(q.withColumn("g", F.substring("q", 1, 2)), "g").where(F.col("name_lower").contains(F.col("q"))).select("qid", "id", "name_lower", "q").distinct()
    tier = F.when(F.col("name_lower") == F.col("q"), 0).when(F.col("name_lower").startswith(F.col("q")), 1).otherwise(2)
    j = j.withColumn("tier", tier)
    w = Window.partitionBy("qid", "tier").orderBy(F.length("name_lower"), "id")
    j = j.withColumn("t", F.row_number().over(w)).where(F.col("t") <= pool)
    return j.withColumn("rn", F.row_number().over(Window.partitionBy("qid").orderBy("tier", "t"))).select("qid", "id", "rn")


def rrf(arms: list[tuple[DataFrame, float]]) -> DataFrame:
    """qid, id, score: each occurrence at rank rn (from 1) of an arm adds weight / (60 + rn)."""
    parts = [a.select("qid", "id", (F.lit(w) / (RRF_K + F.col("rn"))).alias("part")) for a, w in arms]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("qid", "id").agg(F.sum("part").alias("score"))


def blended(symbols: DataFrame, sigs: DataFrame, docs: DataFrame, queries: DataFrame, limit: int, vectors: DataFrame | None = None) -> DataFrame:
    """qid, id, score, rank: names, signatures, docs and, if given, a vector arm (qid, id, rn), folded by rank.

    ``sigs`` and ``docs``: id, text. The pool is cut before external and test symbols are left out; an exact
    name gains one.
    """
    pool = max(8 * limit, 64)
    arms = [
        (name_arm(symbols, queries, pool), 1.0),
        (top(substring_scores(sigs, queries), pool, F.desc(F.round("score", 9)), F.col("id")), 1.0),
        (top(word_scores(docs, queries), pool, F.desc(F.round("score", 9)), F.col("id")), DOC_ARM_WEIGHT),
    ]
    if vectors is not None:
        arms.append((vectors, 1.0))
    rows = rrf(arms).join(_live(symbols, False, False), "id").join(queries, "qid")
    rows = rows.withColumn("score", F.col("score") + F.when(F.lower("name") == F.lower("q"), 1.0).otherwise(0.0))
    out = top(rows, limit, F.desc(F.round("score", 9)), F.length("name"), F.col("id"))
    return out.select("qid", "id", "score", F.col("rn").alias("rank"))


def phrase_scores(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """qid, id, score: rows (id, text) that hold the query's words as one phrase."""
    d = docs.select("id", words(F.col("text")).alias("w"))
    q = queries.select("qid", words(F.col("q")).alias("qw")).where(F.size("qw") > 0).select("qid", F.concat(F.lit(" "), F.array_join("qw", " "), F.lit(" ")).alias("p"), F.col("qw")[0].alias("first"))
    # postings are ids only: the text is fetched again for the rows that hold a query's first word
    met = d.select("id", F.explode(F.array_distinct("w")).alias("first")).join(q, "first").select("qid", "p", "id").distinct()
    whole = d.select("id", F.size("w").alias("n"), F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("t"))
    hit = met.join(whole, "id").where(F.col("t").contains(F.col("p")))
    tf = (F.length("t") - F.length(F.replace("t", F.col("p"), F.lit("")))) / F.length("p")
    hit = hit.select("qid", "id", "n", F.ceil(tf).alias("tf"))
    size = docs.select(F.size(words(F.col("text"))).alias("n")).agg(F.count(F.lit(1)).alias("rows"), F.avg("n").alias("average"))
    df = hit.groupBy("qid").agg(F.count(F.lit(1)).alias("df"))
    return hit.join(df, "qid").crossJoin(size).select("qid", "id", bm25(idf(F.col("rows"), F.col("df")), F.col("tf"), F.col("n"), F.col("average")).alias("score"))  # one row


# vectors ------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """A vector of length one; a zero vector stays."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))


def knn(vectors: DataFrame, queries: DataFrame, k: int, block: int = 1_024) -> DataFrame:
    """qid, id, distance, rn: the k nearest of (id, vec) by cosine for each (qid, vec), exact.

    Queries go to the vectors in blocks of at most ``block``, sent as one matrix, so driver and tasks hold a
    bounded number of them; each task keeps the k best a query before anything is shuffled. Both sides share
    one length; a zero vector is at distance one from all. Ties fall to the smaller id.
    """
    import numpy as np
    import pyarrow as pa

    sc = vectors.sparkSession.sparkContext
    rows = vectors.where("id is not null and vec is not null").select(F.col("id").cast("long"), F.col("vec").cast("array<double>").alias("vec"))

    def matrix(column: pa.Array) -> np.ndarray:
        flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
        return flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-300)

    def scan(shared):
        def best(at: np.ndarray, ids: np.ndarray, d: np.ndarray) -> tuple:
            order = np.lexsort((ids, d, at))
            at, ids, d = at[order], ids[order], d[order]
            first = np.searchsorted(at, at)
            keep = np.arange(len(at)) - first < k
            return at[keep], ids[keep], d[keep]

        def run(batches):
            qids, m = shared.value
            found = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
            for whole in batches:
                for start in range(0, whole.num_rows, 2_048):
                    b = whole.slice(start, 2_048)
                    ids = b.column(0).to_numpy(zero_copy_only=False)
                    d = np.round(1.0 - m @ matrix(b.column(1)).T, 12)
                    n = min(k, d.shape[1])
                    last = np.partition(d, n - 1, axis=1)[:, n - 1 : n]
                    at, col = np.nonzero(d <= last)  # no row beyond the batch's k nearest, ties kept
                    found = best(*(np.concatenate(x) for x in zip(found, (at, ids[col], d[at, col]))))
            if len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(qids[found[0]]), pa.array(found[1]), pa.array(found[2])], ["qid", "id", "distance"])

        return run

    out, pending = None, []
    asked = queries.where("vec is not null").select(F.col("qid").cast("long"), F.col("vec").cast("array<double>"))
    for r in itertools.chain(asked.toLocalIterator(), [None]):
        if pending and (r is None or len(pending) == block):
            m = np.array([v for _, v in pending])
            m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
            part = rows.mapInArrow(scan(sc.broadcast((np.array([q for q, _ in pending], dtype=np.int64), m))), "qid long, id long, distance double")  # ``block`` vectors
            out, pending = part if out is None else out.unionByName(part), []
        if r is not None:
            pending.append((r[0], r[1]))
    if out is None:
        return queries.sparkSession.createDataFrame([], "qid long, id long, distance double, rn int")
    return top(out, k, F.col("distance"), F.col("id"))


def hybrid(lexical: DataFrame, vectors: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """qid, id, score, rank: the ``limit`` best of a lexical score plus the cosine, a plain sum, exact.

    ``lexical``: qid, id, score of not less than zero; ``vectors``: id, vec, one an id; ``queries``: qid, vec.
    A row that no word finds is in the result only if fewer than ``limit`` rows have a greater cosine, so the
    nearest ``limit`` a query are enough beside the lexical hits, whose cosines are computed each. A row without
    vector or a query without vector scores by its words alone.
    """
    v = vectors.select("id", F.col("vec").alias("__v"))
    asked = queries.select("qid", F.col("vec").alias("__q"))
    hits = lexical.join(v, "id", "left").join(asked, "qid", "left")
    words_and = hits.select("qid", "id", (F.col("score") + F.coalesce(dot(unit(F.col("__v")), unit(F.col("__q"))), F.lit(0.0))).alias("score"))
    keyed = vectors.select(F.xxhash64("id").alias("id"), "vec", F.col("id").alias("__id"))
    near = knn(keyed, queries, limit).join(keyed.select("id", "__id"), "id")
    alone = near.select("qid", F.col("__id").alias("id"), (1 - F.col("distance")).alias("score")).join(lexical.select("qid", "id"), ["qid", "id"], "left_anti")
    out = top(words_and.unionByName(alone), limit, F.desc(F.round("score", 9)), F.col("id"))
    return out.select("qid", "id", "score", F.col("rn").alias("rank"))


def near_pairs(vectors: DataFrame, queries: DataFrame, least: float, k: int) -> DataFrame:
    """qid, id, cosine of the at most k vectors with a cosine of ``least``; the query itself is left out."""
    n = knn(vectors, queries, k + 1).where("id <> qid").withColumn("cosine", 1 - F.col("distance")).where(F.col("cosine") >= least)
    return top(n.drop("rn"), k, F.desc(F.round("cosine", 12)), F.col("id")).select("qid", "id", "cosine")


def similar(vectors: DataFrame, symbols: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """qid, id, score, rank: nearest symbols (id, name, external, test) of each query's own vector, itself left out."""
    pool = knn(vectors, queries, max(4 * limit, 16)).where("id <> qid").groupBy("qid", "id").agg(F.min("distance").alias("distance"))
    rows = pool.join(_live(symbols, False, False), "id").withColumn("score", 1 - F.col("distance"))
    return top(rows, limit, F.desc(F.round("score", 9)), F.length("name"), F.col("id")).select("qid", "id", "score", F.col("rn").alias("rank"))


def estimate_log(n: int, df: int) -> float:
    """The idf of a term as a number, for tests."""
    raw = math.log((n - df + 0.5) / (df + 0.5))
    return raw if raw > 0 else IDF_FLOOR
