"""Health reports over links, stylesheets and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symloom import model

LINK_KINDS = ("links_to", "embeds", "links_to_file")
DANGLING_PREFIX = "md:@unresolved/"


def check_links(edges: DataFrame, symbols: DataFrame, defs: DataFrame, files: DataFrame, grades: tuple[str, ...] | None = None, limit: int = 100) -> DataFrame:
    """src, line, target, grade, total: links of Markdown sources that are not exact, by source, at most ``limit`` rows.

    ``total`` counts links, not rows: a source with several definitions repeats its link.
    """
    codes = [model.EDGE_KINDS[k] for k in LINK_KINDS]
    e = edges.where(F.col("kind").isin(codes))
    e = e.where(F.col("link_grade").isin([model.LINK_GRADES[g] for g in grades])) if grades else e.where("link_grade is not null and link_grade <> 0")
    s = symbols.where("language = 'markdown'").select(F.col("id").alias("src_id"), F.col("pub_id").alias("src"))
    e = e.join(s, "src_id")
    total = e.agg(F.count(F.lit(1)).alias("total"))
    d = defs.select(F.col("sym_id").alias("src_id"), F.col("start_line").alias("line"))
    t = symbols.select(F.col("id").alias("target_id"), F.col("pub_id").alias("t_pub"))
    f = files.select(F.col("id").alias("target_id"), F.col("path").alias("t_path"))
    j = e.join(d, "src_id", "left").join(t, "target_id", "left").join(f, "target_id", "left")
    target = F.when(F.col("kind") == model.EDGE_KINDS["links_to_file"], F.col("t_path")).otherwise(F.regexp_replace("t_pub", f"^{DANGLING_PREFIX}", ""))
    names = F.create_map(*(F.lit(x) for k, v in model.LINK_GRADES.items() for x in (v, k)))
    rows = j.select("src", "line", target.alias("target"), names[F.col("link_grade")].alias("grade")).orderBy("src", "line", "target").limit(limit)
    return rows.crossJoin(total)  # total is one row


def orphan_classes(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """id, name: internal CSS classes that nothing uses or extends; none at all while no usage was mined."""
    used = edges.where(F.col("kind").isin(model.EDGE_KINDS["uses_css_class"], model.EDGE_KINDS["extends_rule"])).select(F.col("target_id").alias("id")).distinct()
    mined = edges.where(F.col("kind") == model.EDGE_KINDS["uses_css_class"]).limit(1).select(F.lit(1).alias("mined"))
    c = symbols.where("kind = 'css_class' and not external").join(used, "id", "left_anti")
    return c.crossJoin(mined).select("id", "name")  # one row at most


def orphan_stylesheets(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """id, name: stylesheet modules that are not imported and of which nothing defined in them is used."""
    imported = edges.where(F.col("kind") == model.EDGE_KINDS["imports"]).select(F.col("target_id").alias("id")).distinct()
    owner = edges.where(F.col("kind") == model.EDGE_KINDS["defined_in"]).select(F.col("src_id").alias("member"), F.col("target_id").alias("id"))
    used = edges.where(F.col("kind").isin(model.EDGE_KINDS["uses_css_class"], model.EDGE_KINDS["extends_rule"])).select(F.col("target_id").alias("member")).distinct()
    in_use = owner.join(used, "member", "left_semi").select("id").distinct()
    m = symbols.where("kind = 'module' and language in ('css', 'sass') and not external")
    return m.join(imported, "id", "left_anti").join(in_use, "id", "left_anti").select("id", "name")


def regressions(previous: DataFrame, current: DataFrame, threshold: int = 10) -> DataFrame:
    """metric, was, now, drop_pct: metrics (metric, value) that fell by ``threshold`` percent at least, rounded down."""
    j = previous.select("metric", F.col("value").alias("was")).join(current.select("metric", F.col("value").alias("now")), "metric", "left")
    j = j.where("was > 0").withColumn("now", F.coalesce("now", F.lit(0))).withColumn("drop_pct", F.floor((F.col("was") - F.col("now")) * 100 / F.col("was")))
    return j.where(F.col("drop_pct") >= threshold)


def staleness_keys(heads: DataFrame, dirty: DataFrame, trees: DataFrame, config: str) -> DataFrame:
    """workspace, kind, key: what an index of a workspace was made from; two states are equal iff kind and key are.

    ``heads``: workspace, head (null outside version control); ``dirty``: workspace, path, sha of changed files;
    ``trees``: workspace, path, mtime, size. A workspace with a head is told by head, changed files and the
    configuration's mark, another one by its files, one without files is ``unknown`` and equal to none. Files
    are folded by sums that no order changes, so a workspace of very many files is no single row.
    """
    def folded(rows: DataFrame, *cols: str) -> DataFrame:
        marks = rows.groupBy("workspace").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*cols)).alias("x"), F.sum(F.hash(*cols).cast("long")).alias("s"))
        return marks.select("workspace", F.concat_ws("-", "n", "x", "s").alias("mark"))

    d = folded(dirty.distinct(), "path", "sha").withColumnRenamed("mark", "changed")
    t = folded(trees.distinct(), "path", "mtime", "size").withColumnRenamed("mark", "tree")
    j = heads.select("workspace", "head").distinct().join(d, "workspace", "left").join(t, "workspace", "left")
    kind = F.when(F.col("head").isNotNull(), "git").when(F.col("tree").isNotNull(), "tree").otherwise("unknown")
    key = F.when(F.col("head").isNotNull(), F.concat_ws("|", "head", F.coalesce("changed", F.lit("")), F.lit(config))).otherwise(F.col("tree"))
    return j.select("workspace", kind.alias("kind"), key.alias("key"))


def stale_workspaces(before: DataFrame, now: DataFrame) -> DataFrame:
    """workspace, is_stale: whether the keys of two times differ; an unknown or absent one is always stale."""
    b = before.select("workspace", F.col("kind").alias("k"), F.col("key").alias("v"))
    same = (F.col("k") == F.col("kind")) & (F.col("v") == F.col("key")) & (F.col("kind") != "unknown")
    return now.join(b, "workspace", "left").select("workspace", (~F.coalesce(same, F.lit(False))).alias("is_stale"))


def manifest_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change: added, removed or modified files of two manifests (path, sha); none means nothing is stale."""
    newest = lambda m, n: m.groupBy("path").agg(F.max("sha").alias(n))
    j = newest(before, "a").join(newest(after, "b"), "path", "full_outer")
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "modified")
    return j.select("path", change.alias("change")).where("change is not null")


def event_lag(events: DataFrame, runs: DataFrame) -> DataFrame:
    """key, is_stale: whether the last event of a key lies after the event its last run saw."""
    e = events.groupBy("key").agg(F.max("seq").alias("seen"))
    r = runs.groupBy("key").agg(F.max("seq").alias("run"))
    return e.join(r, "key", "left").select("key", (F.col("seen") > F.coalesce("run", F.lit(-1))).alias("is_stale"))


def first_rows(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
