"""Point fetches, catalogue, bulk scans and locations, as batch joins.

Every fetch takes a DataFrame of requests and answers all of them in one plan. Where the stored order
decides ("the first row"), an explicit order stands in: the smallest id, or the smallest text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COUNTED = ("symbols", "symbol_docs", "defs", "edges", "files", "packages", "file_docs")


LINES = 256  # lines of one file that make a block of the interval joins


def _blocks(start: str, end: str) -> Column:
    """One row a block of lines that an extent covers: a file of very many definitions is many keys."""
    return F.explode(F.sequence(F.floor(F.col(start) / LINES), F.floor(F.col(end) / LINES))).alias("blk")


def fetch_symbols(symbols: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of each wanted (language, pub_id) the symbol with the smallest id; unknown ones have no row."""
    cols = symbols.columns
    hit = symbols.join(wanted.select("language", "pub_id").distinct(), ["language", "pub_id"], "left_semi")
    first = hit.groupBy("language", "pub_id").agg(F.min_by(F.struct(*cols), "id").alias("m"))
    return first.select(*(F.col(f"m.{c}").alias(c) for c in cols))


def by_ids(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is among ``ids`` (one column); repeated and null ids do no harm."""
    one = ids.columns[0]
    return df.join(ids.select(F.col(one).alias("__id")).distinct(), df[key] == F.col("__id"), "left_semi")


def first_docs(docs: DataFrame) -> DataFrame:
    """sym_id, sig, doc: one documentation row a symbol, the smallest."""
    return docs.groupBy("sym_id").agg(F.min(F.struct("sig", "doc")).alias("m")).select("sym_id", "m.sig", "m.doc")


def location(path: Column, start: Column, end: Column) -> Column:
    """./path#start or ./path#start-end."""
    tail = F.when(end > start, F.concat(F.lit("-"), end)).otherwise(F.lit(""))
    return F.when(path.isNotNull(), F.concat(F.lit("./"), path, F.lit("#"), start, tail))


def anchored_defs(defs: DataFrame) -> DataFrame:
    """Definitions with a file and a line; all-zero placeholders are none."""
    return defs.where("file_id <> 0 and start_line >= 1")


def hydrate(symbols: DataFrame, defs: DataFrame, files: DataFrame, packages: DataFrame) -> DataFrame:
    """Symbol references: package name, first anchored location, argument counts of at most 255.

    A symbol without package, definition or file has nulls there.
    """
    spot = anchored_defs(defs).groupBy("sym_id").agg(F.min(F.struct("file_id", "start_line", "end_line")).alias("s"))
    spot = spot.select("sym_id", "s.*").join(files.select(F.col("id").alias("file_id"), "path"), "file_id", "left")
    spot = spot.select("sym_id", location(F.col("path"), F.col("start_line"), F.col("end_line")).alias("location"))
    names = packages.select(F.col("id").alias("pkg_id"), F.col("name").alias("package"))
    out = symbols.join(names, "pkg_id", "left").join(spot, symbols.id == spot.sym_id, "left").drop("sym_id")
    return out.withColumn("nargs", F.least("nargs", F.lit(255)))


def count_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, n_rows of the countable tables; a name that is not one of them counts 0."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("n_rows")) if name in COUNTED else df.limit(0).agg(F.count(F.lit(1)).alias("n_rows"))
        one = one.select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def symbol_bodies(defs: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Definitions with a valid body extent, their file and their symbol."""
    d = defs.where("body_start_line > 0 and body_end_line >= body_start_line")
    d = d.join(files.select(F.col("id").alias("file_id"), "path", F.col("language").alias("file_language")), "file_id")
    return d.join(symbols.select(F.col("id").alias("sym_id"), "name"), "sym_id").select("sym_id", "file_id", "path", "file_language", "name", "body_start_line", "body_end_line")


def symbol_surfaces(symbols: DataFrame, docs: DataFrame, defs: DataFrame, files: DataFrame, language: str | None = None) -> DataFrame:
    """Every symbol with all its documentation and definition rows; absent texts are empty."""
    s = symbols if language is None else symbols.where(F.col("language") == language)
    s = s.select("id", "pub_id", "kind", "name")
    s = s.join(docs.select(F.col("sym_id").alias("id"), "sig", "doc"), "id", "left")
    s = s.join(defs.select(F.col("sym_id").alias("id"), "file_id", "start_line"), "id", "left")
    s = s.join(files.select(F.col("id").alias("file_id"), "path"), "file_id", "left")
    return s.select("id", "pub_id", "kind", "name", *(F.coalesce(c, F.lit("")).alias(c) for c in ("sig", "doc", "path")), "start_line")


def files_by_basename(files: DataFrame, names: DataFrame) -> DataFrame:
    """Non-external files that are not Markdown, by the last segment of their path."""
    f = files.where("not external and language <> 'markdown'").withColumn("base", F.element_at(F.split("path", "/"), -1))
    return f.join(names.select(F.col(names.columns[0]).alias("base")).distinct(), "base")


def symbols_by_short_name(symbols: DataFrame, names: DataFrame, defs: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols of a lower-case name that are defined in a file, with the smallest such path."""
    s = symbols.join(names.select(F.col(names.columns[0]).alias("name_lower")).distinct(), "name_lower", "left_semi")
    j = s.select("id", "name").join(defs.select(F.col("sym_id").alias("id"), "file_id"), "id").join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    return j.groupBy("id", "name").agg(F.min("path").alias("path"))


def at_location(defs: DataFrame, places: DataFrame) -> DataFrame:
    """Symbols whose name span holds (file_id, line), the tightest first: rank 1 is the innermost."""
    d = anchored_defs(defs).where("end_line >= start_line").select("file_id", "sym_id", "start_line", "end_line", _blocks("start_line", "end_line"))
    p = places.select("file_id", "line").distinct().withColumn("blk", F.floor(F.col("line") / LINES))
    hit = p.join(d, ["file_id", "blk"]).where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    best = hit.groupBy("file_id", "line", "sym_id").agg(F.min(F.col("end_line") - F.col("start_line")).alias("span"))
    w = Window.partitionBy("file_id", "line").orderBy("span", "sym_id")
    return best.withColumn("rank", F.row_number().over(w))


def symbol_cards(symbols: DataFrame, docs: DataFrame, defs: DataFrame, files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per wanted id: the symbol, its first docs, its parent's name and its places; found tells whether it exists."""
    ids = wanted.select(F.col(wanted.columns[0]).alias("id")).distinct()
    names = symbols.select(F.col("id").alias("enclosing_sym_id"), F.col("name").alias("parent"))
    d = first_docs(docs).withColumnRenamed("sym_id", "id")
    spots = anchored_defs(defs).join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    spots = spots.groupBy(F.col("sym_id").alias("id")).agg(
        F.array_join(F.array_sort(F.collect_list(location(F.col("path"), F.col("start_line"), F.col("end_line")))), ",").alias("places")
    )
    s = symbols.select("id", "name", "kind", "enclosing_sym_id").withColumn("found", F.lit(True))
    out = ids.join(s, "id", "left").join(names, "enclosing_sym_id", "left").join(d, "id", "left").join(spots, "id", "left")
    return out.select("id", F.coalesce("found", F.lit(False)).alias("found"), "name", "kind", "parent", "sig", "places")


def source_lines(extents: DataFrame, texts: DataFrame) -> DataFrame:
    """sym_id, source: the lines of each extent (sym_id, file_id, start_line, end_line) from (file_id, text).

    Lines beyond the text are left out; an extent that starts beyond it gives an empty text.
    """
    lines = texts.where("text is not null").select("file_id", F.posexplode(F.split(F.regexp_replace("text", "\r\n", "\n"), "\n")).alias("at", "piece"))
    lines = lines.select("file_id", (F.col("at") + 1).alias("line"), "piece", F.floor((F.col("at") + 1) / LINES).alias("blk"))
    key = ["sym_id", "file_id", "start_line", "end_line"]
    wanted = extents.where("start_line >= 1 and end_line >= start_line").select(*key)
    wanted = wanted.join(texts.where("text is not null").select("file_id").distinct(), "file_id", "left_semi")
    # lines and extents meet on blocks of a file's lines, so no text is carried once for each of its extents
    hit = wanted.distinct().select(*key, _blocks("start_line", "end_line")).join(lines, ["file_id", "blk"]).where("line between start_line and end_line")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "piece"))), lambda x: x.piece), "\n")
    return wanted.join(hit.groupBy(*key).agg(text.alias("source")), key, "left").select("sym_id", F.coalesce("source", F.lit("")).alias("source"))
