"""JSON-lines frames of indexers, the anchor logs of findings, and files of a workspace."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Frames share a type tag; some fields mean different things by type, so raw lines are split by type first.
FRAME_SCHEMAS = {
    "meta": "version string, workspace string", "toolchain": "name string, version string",
    "file": "id long, path string, language string, content_hash string, test boolean, external boolean, doc array<string>",
    "package": "id long, name string, version string, manager string, external boolean",
    "stub": "id long, key string, kind string, name string, pkg long", 
    "symbol": "id long, key string, kind string, name string, pkg long, parent long, file long, range array<long>, body array<long>, partial boolean, nargs int, targs int, sig string, doc string, test boolean, external boolean",
    "edge": "source long, target long, kind string, field_op string",
    "error": "severity string, source string, message string, language string", "end": "ts string",
}


class BadFrame(ValueError):
    """A line that is no JSON object with a known type."""


def read_lines(spark: SparkSession, path: str, *more: Column) -> DataFrame:
    """type, line of every non-blank line."""
    t = spark.read.text(path).where(F.trim("value") != "")
    return t.select(F.get_json_object("value", "$.type").alias("type"), F.col("value").alias("line"), *more)


def _broken() -> Column:
    return F.col("type").isNull() | ~F.col("type").isin(*FRAME_SCHEMAS)


def first_broken(spark: SparkSession, path: str) -> tuple[str, int, str] | None:
    """File, line number (from 1, blank lines counted) and text of the first broken line of the first file that has one."""
    lines = read_lines(spark, path, F.col("_metadata.file_path").alias("file"))
    where = lines.where(_broken()).agg(F.min("file").alias("file")).collect()[0].file
    if where is None:
        return None
    # the splits of one file, read in their order by one task: only where there is an error to tell
    one = spark.read.text(where).coalesce(1).select((F.monotonically_increasing_id() + 1).alias("at"), F.col("value").alias("line"))
    bad = one.withColumn("type", F.get_json_object("line", "$.type")).where(_broken() & (F.trim("line") != ""))
    r = bad.agg(F.min(F.struct("at", "line")).alias("m")).collect()[0].m
    return where, r["at"], r["line"]


def read_frames(spark: SparkSession, path: str, strict: bool = True) -> dict[str, DataFrame]:
    """One table a frame type. Blank lines are skipped; a broken line is an error that names it, or left out if not ``strict``."""
    lines = read_lines(spark, path)
    if strict and (bad := first_broken(spark, path)):
        raise BadFrame(f"{bad[0]}:{bad[1]}: {bad[2][:200]}")
    return {t: lines.where(F.col("type") == t).select(F.from_json("line", s).alias("f")).select("f.*") for t, s in FRAME_SCHEMAS.items()}


def write_frames(parts: list[DataFrame], path: str) -> None:
    """Tables with a ``type`` column as JSON lines, null fields left out."""
    lines = [p.select(F.to_json(F.struct(*p.columns)).alias("value")) for p in parts]
    reduce(DataFrame.unionByName, lines).write.mode("overwrite").text(path)


def read_anchor_log(spark: SparkSession, path: str) -> DataFrame:
    """Anchor events of JSON lines; lines that do not parse are dropped."""
    schema = "finding_id string, seq long, op string, anchor string, `from` string, `to` string, ts timestamp, sha string, outcome string"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append_anchor_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """id, text, tags, parent_ids, created_at of Markdown records with a front matter; others are skipped."""
    raw = spark.read.text(path, wholetext=True).withColumnRenamed("value", "raw")
    m = raw.select(F.regexp_extract("raw", r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?(.*)$", 1).alias("head"), F.regexp_extract("raw", r"(?s)^---\r?\n(.*?)\r?\n---\r?\n?(.*)$", 2).alias("text"))
    one = lambda k: F.regexp_extract("head", rf"(?m)^{k}:\s*['\"]?([^'\"\r\n]*)", 1)

    def many(k: str):
        inline = F.regexp_extract("head", rf"(?m)^{k}:\s*\[(.*)\]", 1)
        listed = F.regexp_extract("head", rf"(?m)^{k}:[ \t]*\r?\n((?:[ \t]*-[^\n]*\n?)*)", 1)
        items = F.when(inline != "", F.split(inline, r"\s*,\s*")).otherwise(F.split(listed, r"\n"))
        items = F.transform(items, lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s*(-\s*)?['\"]?", ""), r"['\"]?\s*$", ""))
        return F.filter(items, lambda x: x != "")

    out = m.select(one("id").alias("id"), "text", many("tags").alias("tags"), many("parent_ids").alias("parent_ids"), F.try_to_timestamp(one("created_at")).alias("created_at"))
    return out.where("id <> ''")


def write_findings(findings: DataFrame, path: str) -> None:
    """One Markdown record a finding."""
    q = lambda c: F.concat(F.lit("["), F.array_join(c, ", "), F.lit("]"))
    text = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("id: "), "id"), F.concat(F.lit("tags: "), q("tags")), F.concat(F.lit("parent_ids: "), q("parent_ids")), F.concat(F.lit("created_at: "), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ssXXX")), F.lit("---"), "text")
    findings.select("id", text.alias("value")).write.mode("overwrite").partitionBy("id").option("lineSep", "\n").text(path)


def discover(spark: SparkSession, root: str, include: str = "*", exclude: tuple[str, ...] = ()) -> DataFrame:
    """path, content of the files below ``root`` whose name matches a glob and whose path no excluded pattern."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", include).option("recursiveFileLookup", True).load(root)
    for pattern in exclude:
        f = f.where(~F.col("path").rlike(pattern))
    return f.select("path", "content")


def load_sidecar(segments: DataFrame, manifest: DataFrame, gate: dict[str, str]) -> DataFrame:
    """fingerprint, scale, codes: one vector a fingerprint, packs before segments; nothing where the manifest differs from the gate."""
    fits = manifest.where(F.array_min(F.array(*(F.coalesce(F.col(k) == v, F.lit(False)) for k, v in gate.items())))).limit(1).select(F.lit(1).alias("ok"))
    best = segments.groupBy("fingerprint").agg(F.max_by(F.struct("scale", "codes"), F.struct("is_pack", "segment")).alias("m"))
    return best.crossJoin(fits).select("fingerprint", "m.scale", "m.codes")  # one row at most
