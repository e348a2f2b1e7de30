"""Findings: lifecycle tags, staleness, anchor logs and directives."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symloom.runtime import Scratch, numbered

CLAIMS = ("bug", "deferred", "gotcha", "fixed", "usability")
DIRECTIVES = ("directive", "guide")
HALF_LIFE_S = 30 * 86_400
COSINE_FLOOR = 0.5
NEAR_DUPLICATE, NEAR_TOP = 0.82, 5


def lifecycle(findings: DataFrame) -> DataFrame:
    """id, state: ids that some finding's tags supersede or tombstone."""
    t = findings.select(F.explode("tags").alias("tag"))
    m = t.select(F.regexp_extract("tag", r"^(supersedes|tombstone):(.+)$", 1).alias("verb"), F.regexp_extract("tag", r"^(supersedes|tombstone):(.+)$", 2).alias("id")).where("verb <> ''")
    return m.select("id", F.when(F.col("verb") == "supersedes", "superseded").otherwise("tombstoned").alias("state")).distinct()


def live(findings: DataFrame) -> DataFrame:
    """Findings that nothing supersedes or tombstones."""
    return findings.join(lifecycle(findings).select("id").distinct(), "id", "left_anti")


def stale(findings: DataFrame, pub_ids: DataFrame) -> DataFrame:
    """id, stale: whether some parent that is no finding is unknown among the public ids."""
    p = findings.select("id", F.explode_outer("parent_ids").alias("parent"))
    known = pub_ids.select(F.col(pub_ids.columns[0]).alias("parent")).distinct().withColumn("known", F.lit(True))
    j = p.join(known, "parent", "left")
    lost = F.col("parent").isNotNull() & ~F.col("parent").startswith("fnd_") & F.col("known").isNull()
    return j.groupBy("id").agg(F.max(lost.cast("int")).cast("boolean").alias("stale"))


def classify(findings: DataFrame) -> DataFrame:
    """id, is_claim, is_directive by the tags."""
    has = lambda xs: F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, xs))), F.lit(False))
    return findings.select("id", has(CLAIMS).alias("is_claim"), has(DIRECTIVES).alias("is_directive"))


def fold_anchors(events: DataFrame) -> DataFrame:
    """finding_id, anchor, attach_count, recency, sha, origin_sha, outcome: anchor logs without renames, folded.

    A detach forgets what came before it; a verify sets the outcome and does not count. Events are ordered by
    seq; all of it is aggregation, nothing is gathered.
    """
    last_off = events.where("op = 'detach'").groupBy("finding_id", "anchor").agg(F.max("seq").alias("off"))
    e = events.where("op in ('attach', 'verify')").join(last_off, ["finding_id", "anchor"], "left").where("off is null or seq > off")
    att = F.col("op") == "attach"
    return e.groupBy("finding_id", "anchor").agg(
        F.sum(att.cast("long")).alias("attach_count"), F.max(F.when(att, F.col("ts"))).alias("recency"),
        F.max_by("sha", F.when(att & F.col("sha").isNotNull(), F.struct("ts", "seq"))).alias("sha"), F.min_by("sha", F.when(att & F.col("sha").isNotNull(), F.col("seq"))).alias("origin_sha"),
        F.max_by("outcome", F.when(~att, F.col("seq"))).alias("outcome"), F.max_by("sha", F.when(~att, F.col("seq"))).alias("verified_sha"),
    )


FOLDED = "finding_id string, anchor string, attach_count long, recency timestamp, sha string, origin_sha string, outcome string, verified_sha string"


def fold_log(events: DataFrame) -> DataFrame:
    """As :func:`fold_anchors` for whole logs, renames included, with the results of the store's fold in order of seq.

    An entry that a verify creates has its ts as recency. Anchors that no rename of their finding names are
    aggregated; the others are folded in order, one finding after another, holding the anchors of one finding only.
    """
    moves = events.where("op = 'rename'")
    named = moves.select("finding_id", F.col("from").alias("anchor")).union(moves.select("finding_id", "to")).distinct()
    still = events.where("op <> 'rename'")
    plain = _fold_unmoved(still.join(named, ["finding_id", "anchor"], "left_anti"))
    cols = ["finding_id", "seq", "op", "anchor", "from", "to", "ts", "sha", "outcome"]
    rest = still.join(named, ["finding_id", "anchor"], "left_semi").select(*cols).unionByName(moves.select(*cols))
    return plain.unionByName(rest.repartition("finding_id").sortWithinPartitions("finding_id", "seq").mapInArrow(_fold_sorted, FOLDED))


def _fold_unmoved(events: DataFrame) -> DataFrame:
    last_off = events.where("op = 'detach'").groupBy("finding_id", "anchor").agg(F.max("seq").alias("off"))
    e = events.where("op in ('attach', 'verify')").join(last_off, ["finding_id", "anchor"], "left").where("off is null or seq > off")
    att = F.col("op") == "attach"
    g = e.groupBy("finding_id", "anchor").agg(
        F.sum(att.cast("long")).alias("attach_count"), F.max(F.when(att, F.col("ts"))).alias("newest"), F.min_by(F.when(~att, F.col("ts")), "seq").alias("base"),
        F.max_by("sha", F.when(att, F.struct("ts", "seq"))).alias("newest_sha"), F.min_by("sha", F.when(att & F.col("sha").isNotNull(), F.col("seq"))).alias("origin_sha"),
        F.max_by("outcome", F.when(~att, F.col("seq"))).alias("outcome"), F.max_by("sha", F.when(~att, F.col("seq"))).alias("verified_sha"),
    )
    sha = F.when(F.col("base").isNull() | (F.col("newest") >= F.col("base")), F.col("newest_sha"))  # an attach older than the entry leaves no sha
    return g.select("finding_id", "anchor", "attach_count", F.greatest("newest", "base").alias("recency"), sha.alias("sha"), "origin_sha", "outcome", "verified_sha")


def _reaches(ts: datetime | None, recency: datetime | None) -> bool:
    """Null is the oldest."""
    return recency is None or (ts is not None and ts >= recency)


def _fold_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(n, pa.timestamp("us", "UTC") if t == "timestamp" else pa.int64() if t == "long" else pa.string()) for n, t in (c.split(" ") for c in FOLDED.split(", "))])
    finding, state, out = None, {}, []

    def flush() -> None:
        out.extend({"finding_id": finding, "anchor": a} | e for a, e in state.items())
        state.clear()

    for batch in batches:
        for r in batch.to_pylist():
            if r["finding_id"] != finding:
                flush()
                finding = r["finding_id"]
            op, ts = r["op"], r["ts"]
            if op == "detach":
                state.pop(r["anchor"], None)
            elif op == "rename":
                moved = state.pop(r["from"], None)
                if moved is None:
                    continue
                old = state.get(r["to"])
                if old is None:
                    state[r["to"]] = moved
                    continue
                count = old["attach_count"] + moved["attach_count"]
                state[r["to"]] = (moved if _reaches(moved["recency"], old["recency"]) else old) | {"attach_count": count}
            else:
                e = state.setdefault(r["anchor"], {"attach_count": 0, "recency": ts, "sha": None, "origin_sha": None, "outcome": None, "verified_sha": None})
                if op == "verify":
                    e["verified_sha"], e["outcome"] = r["sha"], r["outcome"]
                    continue
                if _reaches(ts, e["recency"]):
                    e["sha"], e["recency"] = r["sha"], ts
                e["attach_count"] += 1
                e["origin_sha"] = r["sha"] if e["origin_sha"] is None else e["origin_sha"]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
            out.clear()
    flush()
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def resolve_renames(events: DataFrame, rounds: int = 16) -> DataFrame:
    """The log with every event under the name its anchor has in the end: renames carry the past along.

    A rename moves the events before it; chains are followed one hop a round. After ``rounds`` hops the log is
    written, and hops go on until no event moves.
    """
    moves = events.where("op = 'rename'").select(F.col("finding_id").alias("m_finding"), F.col("from").alias("m_from"), F.col("to").alias("m_to"), F.col("seq").alias("m_seq"))
    out = events.where("op <> 'rename'").withColumn("moved", F.lit(0).cast("long"))
    due = (F.col("finding_id") == F.col("m_finding")) & (F.col("anchor") == F.col("m_from")) & (F.col("m_seq") > F.greatest("seq", "moved"))
    scratch = Scratch(events.sparkSession, "renames")
    while True:
        for _ in range(rounds):
            j = out.join(moves, due, "left")
            w = Window.partitionBy("finding_id", "seq").orderBy(F.col("m_seq").asc_nulls_last())
            j = j.withColumn("rn", F.row_number().over(w)).where("rn = 1")
            out = j.select(*[F.coalesce("m_to", "anchor").alias("anchor") if c == "anchor" else F.coalesce("m_seq", "moved").alias("moved") if c == "moved" else c for c in out.columns])
        out = scratch.save(out)
        if out.join(moves, due, "left_semi").isEmpty():
            break
    return out.drop("moved")


def check_anchors(anchors: DataFrame, findings: DataFrame, files: DataFrame) -> DataFrame:
    """finding_id, anchor, status: broken, drifted (directives) or unverified (claims) anchors of live findings.

    ``files``: path, sha. A claim compares with the verified sha, else the one of its origin.
    """
    f = classify(live(findings)).withColumnRenamed("id", "finding_id")
    j = anchors.join(f, "finding_id").join(files.select(F.col("path").alias("anchor"), F.col("sha").alias("now")), "anchor", "left")
    against = F.coalesce("verified_sha", "origin_sha")
    status = (
        F.when(F.col("now").isNull(), "broken")
        .when(F.col("is_claim") & ((F.col("outcome") == "no_longer_true") | (against != F.col("now"))), "unverified")
        .when(F.col("is_directive") & (F.col("sha") != F.col("now")), "drifted")
    )
    return j.withColumn("status", status).where("status is not null").select("finding_id", "anchor", "status")


def seed_successors(findings: DataFrame, anchors: DataFrame) -> DataFrame:
    """finding_id, anchor, ts, sha: attach events that a successor inherits from what it supersedes."""
    t = findings.select("id", F.explode("tags").alias("tag")).where("tag like 'supersedes:%'")
    t = t.select(F.col("id").alias("successor"), F.expr("substring(tag, 12)").alias("finding_id"))
    return t.join(anchors, "finding_id").select(F.col("successor").alias("finding_id"), "anchor", F.col("recency").alias("ts"), "sha")


def liveness(count: Column, age_s: Column) -> Column:
    return count * F.pow(F.lit(0.5), F.greatest(age_s, F.lit(0)) / HALF_LIFE_S)


def find_directives(findings: DataFrame, anchors: DataFrame, paths: DataFrame, now_s: int, limit: int, scratch: Scratch, semantic: DataFrame | None = None) -> DataFrame:
    """id, score, rank: directives whose anchors hold a changed path, by decayed attach counts, folded with a semantic arm (id, cosine).

    An anchor holds a path if it is the path or a directory above it: the path's ancestors are looked up by equality.
    """
    d = classify(live(findings)).where("is_directive").select("id")
    parts = F.split("path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    held = paths.select(F.explode(up).alias("key")).distinct()
    a = anchors.withColumn("key", F.regexp_replace("anchor", "/$", "")).join(held, "key", "left_semi")
    score = liveness(F.col("attach_count"), F.lit(now_s) - F.unix_seconds("recency"))
    s = a.groupBy(F.col("finding_id").alias("id")).agg(F.max(score).alias("s")).join(d, "id")
    order = (F.desc(F.round("s", 9)), F.col("id"))
    arms = numbered(s.select("id", "s"), "rn", scratch, *order)
    if semantic is not None:
        near = semantic.where(F.col("cosine") >= COSINE_FLOOR).join(d, "id").select("id", F.col("cosine").alias("s"))
        arms = arms.unionByName(numbered(near, "rn", scratch, *order))
    out = arms.groupBy("id").agg(F.sum(1.0 / (60 + F.col("rn"))).alias("score"))
    first = out.orderBy(F.desc(F.round("score", 9)), "id").limit(limit)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "id")))  # at most ``limit`` rows


def store_findings(existing: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, unknown parents as id, parent): a parent fnd_ id must exist or come along."""
    known = existing.select("id").union(new.select("id")).distinct().select(F.col("id").alias("parent"))
    p = new.select("id", F.explode("parent_ids").alias("parent")).where("parent like 'fnd\\_%'")
    unknown = p.join(known, "parent", "left_anti").select("id", "parent")
    return new.join(unknown.select("id").distinct(), "id", "left_anti"), unknown
