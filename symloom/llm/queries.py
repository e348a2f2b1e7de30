"""The pN_ queries of the text problems, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.llm import leakage, markup, packing, pairs, reading
from symloom.runtime import Scratch, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    symbols, docs, defs, files = (table(spark, d, t) for t in ("symbols", "symbol_docs", "defs", "files"))
    return pairs.function_pairs(symbols, spread(docs.select("sym_id", "sig", "doc")), defs, files)


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Functions and methods whose documentation says something."""
    return _pairs(spark, d).select("sym_id").distinct()


@query
def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Declaration, description and place of every documented function."""
    return _pairs(spark, d)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "symbol_docs").select(F.lit("symbol_docs").alias("tab"), F.col("sym_id").alias("key_id"), "doc")
    b = table(spark, d, "file_docs").select(F.lit("file_docs").alias("tab"), F.col("file_id").alias("key_id"), "doc")
    return a.unionByName(b).where("key_id is not null")


@query
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Symbols and files of which some doc holds markup."""
    return markup.marked(_docs(spark, d).where("doc is not null").distinct(), markup.trained()).where("markup").select("tab", "key_id").distinct()


@query
def p7_clean(spark: SparkSession, d: str) -> DataFrame:
    """Clean text of every doc of symbols and files."""
    return markup.cleaned(spread(_docs(spark, d)), markup.trained())


@query
def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    """Every text, or piece of a text beyond 2,048 tokens, with its container."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    tasks = spark.sparkContext.defaultParallelism
    return packing.pack(packing.pieces(docs), Scratch(spark, "packing"), tasks=tasks).select("doc_id", "piece", "start", "n", "bin_id")


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold passages of test items, with the items."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return leakage.leaked_items(docs, table(spark, d, "bench_items"), Scratch(spark, "leakage"))


GRADED_KINDS = ("readme", "design_note", "changelog", "finding", "faq")


def graded(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, doc_kind, level of the English prose documents."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "doc_kind")
    model = reading.train(docs, table(spark, d, "level_labels"))
    prose = docs.where((F.col("lang") == "en") & F.col("doc_kind").isin(*GRADED_KINDS))
    return reading.levels(spread(prose.select("doc_id", "text")), model)


@query
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents at level 4 or 5."""
    return graded(spark, d).where("level >= 3.5").select("doc_id")


@query
def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    """Number of documents at each level."""
    return graded(spark, d).groupBy(F.round("level").cast("int").alias("level")).agg(F.count(F.lit(1)).alias("n_docs"))
