"""Queries of the write path as a whole, of stored tables and of streams that have ended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.operators import analytics as an
from symloom.operators import rollup as ru
from symloom.plans import query
from symloom.plans.analytics_queries import AGG, GODS, Rolled
from symloom.plans.build import build_snapshot
from symloom.plans.projection import CTES, graph
from symloom.plans.search_queries import FINDINGS, HITS, blended_hits, hybrid_findings, hybrid_sql, terms, words_sql
from symloom.runtime import Scratch, table
from symloom.sources.snapshot import SnapshotStore
from symloom.streaming import watch


@query("q14_scan_god_nodes", CTES + AGG + GODS + " select \"rank\", short_id, name from gods where \"filter\" = 'live' order by \"rank\"")
def q14(spark: SparkSession, d: str) -> DataFrame:
    r = Rolled(spark, d)
    return an.god_nodes(r.nodes, r.degrees).where("filter = 'live'").select("rank", "short_id", "name").orderBy("rank")


@query("q14_scan_aggregate_edges", CTES + AGG + " select kind, count(*) n, sum(weight)::bigint weight from ae group by kind")
def q14b(spark: SparkSession, d: str) -> DataFrame:
    return Rolled(spark, d).edges.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))


@query(
    "v7_semantic_search",
    CTES + HITS + ", " + FINDINGS[len("with ") :] + ", ysrc as (select id, \"text\" from lv where \"text\" is not null), " + words_sql("ysrc", "q", "y") + "," + hybrid_sql("ysc", "q", "h", 30) + """
select hit_type arm, qid, id::varchar id, score, pos from hits union all select 'finding', qid, id, score, "rank" from htop""",
)
def v7(spark: SparkSession, d: str) -> DataFrame:
    """Code, file docs and findings for the same queries, words and vectors in both arms; their scores are not comparable."""
    found = hybrid_findings(spark, d, terms(spark), 30).select(F.lit("finding").alias("arm"), "qid", "id", "score", F.col("rank").alias("pos"))
    return blended_hits(spark, d).select(F.col("hit_type").alias("arm"), "qid", F.col("id").cast("string").alias("id"), "score", "pos").unionByName(found)


@query("s5_write_tables", CTES + " select kind, count(*) n, min(name_lower) first_name from g_symbols group by kind")
def s5(spark: SparkSession, d: str) -> DataFrame:
    """Symbols written into a published snapshot and read from the live one."""
    store = SnapshotStore(spark, Scratch(spark, "store").root)
    store.write("r1", {"symbols": graph(spark, d, "g_symbols")})
    store.publish("r1")
    return store.read("symbols").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.min("name_lower").alias("first_name"))


@query(
    "a9_build_snapshot",
    CTES + AGG + GODS + """ select 'symbols' tbl, count(*) n from g_symbols union all select 'edges', count(*) from g_edges union all select 'aggregate_nodes', count(*) from an union all select 'aggregate_edges', count(*) from ae
union all select 'analysis_god_nodes', count(*) from gods union all select 'knowledge_docs', count(*) from g_symbols s join g_docs t on t.sym_id = s.id where doc <> ''""",
)
def a9(spark: SparkSession, d: str) -> DataFrame:
    """The whole write path without communities; row counts of the published tables."""
    store = SnapshotStore(spark, Scratch(spark, "store").root)
    names = {"symbols": "symbols", "symbol_docs": "docs", "defs": "defs", "edges": "edges", "files": "files", "packages": "packages"}
    build_snapshot(spark, store, "r1", {t: graph(spark, d, f"g_{g}") for t, g in names.items()}, cluster=False)
    shown = ("symbols", "edges", "aggregate_nodes", "aggregate_edges", "analysis_god_nodes", "knowledge_docs")
    return ru.union_all([store.read(t).agg(F.lit(t).alias("tbl"), F.count(F.lit(1)).alias("n")) for t in shown])


@query("s2_tail_stream", "select file_id, count(*) n, max(end_line)::bigint last_line from defs group by file_id")
def s2(spark: SparkSession, d: str) -> DataFrame:
    """Definitions as JSON lines, taken by a stream until nothing is left."""
    root = Scratch(spark, "tail").root
    table(spark, d, "defs").select("sym_id", "file_id", "end_line").write.json(f"{root}/in")
    watch.run_once(watch.tail_json(spark, f"{root}/in", "sym_id long, file_id long, end_line int"), f"{root}/out", f"{root}/progress")
    got = spark.read.parquet(f"{root}/out")
    return got.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"), F.max("end_line").cast("long").alias("last_line"))


@query(
    "t7_stream_bursts",
    """with x as (select user_id "key", ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 6 hour then 0 else 1 end brk from events where user_id is not null),
g as (select *, sum(brk) over (partition by "key" order by ts rows unbounded preceding) g from x), b as (select "key", min(ts) a, max(ts) e, count(*) n from g group by "key", g), m as (select max(ts) top from events)
select "key", n, a "start" from b, m where e + interval 6 hour <= top - interval 1 day""",
)
def t7(spark: SparkSession, d: str) -> DataFrame:
    """Bursts that a stream has closed: those the watermark, a day behind the last event, has passed."""
    root = Scratch(spark, "bursts").root
    src = f"{root}/in"
    e = table(spark, d, "events").where("user_id is not null").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    e.write.parquet(src)
    stream = spark.readStream.schema(e.schema).parquet(src)
    watch.run_once(watch.debounced(stream, "user_id", "ts", "6 hours", "1 day"), f"{root}/out", f"{root}/progress")
    return spark.read.parquet(f"{root}/out").select("key", "n", F.col("start").cast("timestamp_ntz").alias("start"))
