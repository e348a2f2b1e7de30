"""Finishing a store: placeholder purge, statistics, knowledge rows, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.functions.identifiers import split_identifier, verbatim

VERBATIM_LANGUAGES = ("xml", "sql")


def purge_placeholders(defs: DataFrame) -> DataFrame:
    """Without the line-0 definitions of symbols that have a real one."""
    placed = defs.where("start_line >= 1").select("sym_id").distinct().withColumn("placed", F.lit(True))
    out = defs.join(placed, "sym_id", "left").where("start_line <> 0 or placed is null or start_line is null")
    return out.select(*defs.columns)


def subset(external: Column, test: Column) -> Column:
    """external before test before internal."""
    return F.when(external, "external").when(test, "test").otherwise("internal")


def entity_stats(symbols: DataFrame, files: DataFrame, defs: DataFrame, packages: DataFrame) -> DataFrame:
    """scope, key, subset, metric, value: numbers of symbols, files and definitions by language and subset, of packages by manager.

    A definition counts as its symbol does; those of unknown symbols do not count.
    """
    def per_language(df: DataFrame, metric: str) -> DataFrame:
        n = df.groupBy(F.col("language").alias("key"), subset(F.col("external"), F.col("test")).alias("subset")).agg(F.count(F.lit(1)).alias("value"))
        return n.select(F.lit("language").alias("scope"), "key", "subset", F.lit(metric).alias("metric"), "value")

    of = defs.groupBy(F.col("sym_id").alias("id")).agg(F.count(F.lit(1)).alias("n")).join(symbols.select("id", "language", "external", "test"), "id")
    of = of.groupBy(F.col("language").alias("key"), subset(F.col("external"), F.col("test")).alias("subset")).agg(F.sum("n").alias("value"))
    of = of.select(F.lit("language").alias("scope"), "key", "subset", F.lit("defs").alias("metric"), "value")
    pk = packages.groupBy(F.col("manager").alias("key"), F.when(F.col("external"), "external").otherwise("internal").alias("subset")).agg(F.count(F.lit(1)).alias("value"))
    pk = pk.select(F.lit("manager").alias("scope"), "key", "subset", F.lit("packages").alias("metric"), "value")
    return per_language(symbols, "symbols").unionByName(per_language(files, "files")).unionByName(of).unionByName(pk)


def workspace_overview(stats: DataFrame) -> DataFrame:
    """language, metric and one column a subset, with the total."""
    s = stats.where("scope = 'language'")
    part = lambda x: F.sum(F.when(F.col("subset") == x, F.col("value")).otherwise(0)).alias(x)
    return s.groupBy(F.col("key").alias("language"), "metric").agg(part("internal"), part("test"), part("external"), F.sum("value").alias("total"))


def name_rows(symbols: DataFrame, docs: DataFrame) -> DataFrame:
    """embed_key, id, sig, name_text, doc of every symbol: its first signature or "kind name"; its first non-empty doc."""
    first = docs.groupBy("sym_id").agg(F.min("sig").alias("sig"), F.min(F.when(F.col("doc") != "", F.col("doc"))).alias("doc"))
    s = symbols.join(first, symbols.id == first.sym_id, "left")
    sig = F.coalesce("sig", F.concat_ws(" ", "kind", "name"))
    text = F.when(F.col("language").isin(*VERBATIM_LANGUAGES), verbatim(sig, F.coalesce("doc", F.lit("")))).otherwise(split_identifier(F.col("name")))
    return s.select(F.concat_ws(":", F.lit("name"), "language", "pub_id").alias("embed_key"), "id", sig.alias("sig"), text.alias("name_text"), "doc")


def doc_rows(symbols: DataFrame, docs: DataFrame) -> DataFrame:
    """One row for every non-empty documentation row of a symbol."""
    d = docs.where("doc <> ''").select(F.col("sym_id").alias("id"), "doc")
    return symbols.join(d, "id").select(F.concat_ws(":", F.lit("doc"), "language", "pub_id").alias("embed_key"), "id", F.col("doc").alias("doc_text"))


def file_doc_rows(files: DataFrame, docs: DataFrame) -> DataFrame:
    """One row for every non-empty file documentation; its public id is empty."""
    d = docs.where("doc <> ''").select(F.col("file_id").alias("id"), "doc")
    return files.join(d, "id").select(F.concat_ws(":", F.lit("doc"), "language", "path").alias("embed_key"), F.lit("").alias("pub_id"), "id", "path", F.col("doc").alias("doc_text"))


def name_words(symbols: DataFrame) -> DataFrame:
    """id, word, n: the inverted index of split names."""
    w = symbols.select("id", F.explode(F.split(split_identifier(F.col("name")), " ")).alias("word")).where("word <> ''")
    return w.groupBy("id", "word").agg(F.count(F.lit(1)).alias("n"))


def reuse_vectors(names: DataFrame, vectors: DataFrame) -> DataFrame:
    """Name rows with the vector of equal fingerprint (smallest id on ties)."""
    v = vectors.groupBy("fingerprint").agg(F.min_by("embedding", "id").alias("embedding"))
    return names.join(v, "fingerprint")


def pending(names: DataFrame, vectors: DataFrame, after: int = 0, chunk: int = 1_000) -> DataFrame:
    """The next name rows without vector that have a doc and are code, in id order above the cursor."""
    n = names.where((F.col("id") > after) & (F.col("doc") != "") & ~F.col("language").isin(*VERBATIM_LANGUAGES))
    return n.join(vectors.select("fingerprint").distinct(), "fingerprint", "left_anti").orderBy("id").limit(chunk)


def quantise(v: Column) -> Column:
    """scale and codes of a vector: int8 by the largest magnitude; scale 1 for a zero vector."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    scale = F.when(top > 0, top / 127.0).otherwise(F.lit(1.0))
    codes = F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x.cast("double") / scale).cast("int"))))
    return F.struct(scale.alias("scale"), codes.alias("codes"))


def dequantise(scale: Column, codes: Column) -> Column:
    return F.transform(codes, lambda c: c * scale)


def upsert_stats(old: DataFrame, new: DataFrame) -> DataFrame:
    """Last write wins on (scope, key, subset, metric)."""
    key = ["scope", "key", "subset", "metric"]
    both = old.select(*key, "value").withColumn("at", F.lit(0)).unionByName(new.select(*key, "value").withColumn("at", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.desc("at"), F.desc("value"))
    return both.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(*key, "value")
