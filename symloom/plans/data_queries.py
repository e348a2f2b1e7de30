"""The pN_ queries of the general problems, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.operators import hierarchy as h
from symloom.operators import incremental as inc
from symloom.operators import intervals as iv
from symloom.operators import orphans as orp
from symloom.operators import skew
from symloom.plans import query
from symloom.runtime import Scratch, table

# 1: processing only new or changed records ---------------------------------------------------


def knowledge_feed(spark: SparkSession, d: str, root: str | None = None) -> inc.MerkleFeed:
    """Take all successful indexing runs, in their order, that the feed in folder ``root`` has not taken yet.

    A run brings the rows it delivered; keys it did not deliver stay as they were. Without ``root`` the feed is new.
    """
    scratch = Scratch(spark, "feed")
    feed = inc.MerkleFeed(spark, root or f"{scratch.root}/state")
    ok = sorted(r.run_id for r in table(spark, d, "index_runs").where("status = 'ok'").select("run_id").distinct().collect())  # one row a run
    due = [run for run in ok if run not in set(feed.committed())]
    if not due:
        return feed
    rows = table(spark, d, "knowledge").select("run_id", "embed_key", "doc_text", "loaded_at", "row_id").where(F.col("run_id").isin(due))
    seen = scratch.save_by(inc.latest_versions(rows, "run_id", "embed_key", "doc_text", ["loaded_at", "row_id"]), "version", "seen")
    for run in due:
        feed.run(run, seen.where(F.col("version") == run), whole=False)
    return feed


P1_SQL = """
with ok as (select distinct run_id from index_runs where status = 'ok'),
k as (
  select run_id, embed_key, coalesce(doc_text, '') doc,
         row_number() over (partition by run_id, embed_key order by loaded_at desc, row_id desc) rn
  from knowledge join ok using (run_id) where embed_key is not null),
v as (select run_id, embed_key, doc, lag(doc) over (partition by embed_key order by run_id) was,
             row_number() over (partition by embed_key order by run_id) nth from k where rn = 1)
select run_id, embed_key from v where nth = 1 or doc <> was
"""


@query("p1_found", P1_SQL)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The entries each successful run took: new or changed since the last successful run that saw them."""
    out = knowledge_feed(spark, d).output().where("op <> 'removed'")
    return out.select(F.col("version").alias("run_id"), F.col("key").alias("embed_key"))


# 2: parent-child links to full hierarchies ---------------------------------------------------


def symbol_hierarchy(spark: SparkSession, d: str, named: bool) -> DataFrame:
    rows = table(spark, d, "symbols").select("id", "enclosing_sym_id", "loaded_at", "name")
    links = h.latest_links(rows, "id", "enclosing_sym_id", "loaded_at")
    label = None
    if named:
        label = rows.where("id is not null").groupBy("id").agg(F.max(F.struct("loaded_at", "name")).alias("m")).select("id", F.col("m.name").alias("name"))
    return h.hierarchy(links, Scratch(spark, "hierarchy"), label)


P2_LINKS = """
last as (select id, enclosing_sym_id p, row_number() over (partition by id order by loaded_at desc, coalesce(enclosing_sym_id, 0) desc) rn
         from symbols where id is not null),
link as (select a.id, b.id parent from last a left join (select distinct id from symbols) b on a.p = b.id and a.p <> 0 where a.rn = 1),
"""

P2_SQL = f"""
with recursive {P2_LINKS}
down as (select id, id root_id, 0 depth from link where parent is null
         union all select l.id, w.root_id, w.depth + 1 from link l join down w on l.parent = w.id),
stuck as (select id, parent from link where id not in (select id from down)),
walk as (select id, parent seen from stuck
         union select w.id, s.parent from walk w join stuck s on w.seen = s.id),
ring as (select id from walk where seen = id),
low as (select w.id, min(w.seen) root_id from walk w where w.seen in (select id from ring) group by w.id)
select id sym_id, root_id, depth from down union all select id, root_id, -1 from low
"""


@query("p2_found", P2_SQL)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Root and depth of every symbol; loops and what hangs below them have depth -1."""
    return symbol_hierarchy(spark, d, named=False).select(F.col("id").alias("sym_id"), "root_id", F.col("depth").cast("int").alias("depth"))


P2_SETS_SQL = f"""
with recursive {P2_LINKS}
nm as (select id, name, row_number() over (partition by id order by loaded_at desc, name desc nulls last) rn from symbols),
down as (select l.id, coalesce(n.name, l.id::varchar) path, 0 depth from link l left join nm n on n.id = l.id and n.rn = 1 where parent is null
         union all select l.id, w.path || '/' || coalesce(n.name, l.id::varchar), w.depth + 1
         from link l join down w on l.parent = w.id left join nm n on n.id = l.id and n.rn = 1),
up as (select id, id anc from down union all select u.id, l.parent from up u join link l on u.anc = l.id where l.parent is not null)
select d.id sym_id, d.path, d.depth::bigint depth, count(*) - 1 n_descendants from down d join up u on u.anc = d.id group by all
"""


@query("p2_paths", P2_SETS_SQL)
def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    """Full path, depth and number of descendants of every symbol that is on no loop."""
    out = symbol_hierarchy(spark, d, named=True).where("depth >= 0")
    return out.select(F.col("id").alias("sym_id"), "path", F.col("depth").cast("long").alias("depth"), (F.col("size") - 1).alias("n_descendants"))


P2_PAIRS_SQL = f"""
with recursive {P2_LINKS}
down as (select id from link where parent is null union all select l.id from link l join down w on l.parent = w.id),
good as (select l.id, l.parent from link l join down using (id)),
up as (select id, parent anc from good where parent is not null union all select u.id, g.parent from up u join good g on u.anc = g.id where g.parent is not null)
select {{cols}} from up where {{side}} % 20 = 0
"""


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "symbols").where("id % 20 = 0").select("id")


@query("p2_descendants", P2_PAIRS_SQL.format(cols="anc sym_id, id descendant", side="anc"))
def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of every twentieth symbol, by nested-set ranges."""
    out = h.descendants(symbol_hierarchy(spark, d, named=False), _asked(spark, d))
    return out.select(F.col("id").alias("sym_id"), "descendant")


@query("p2_ancestors", P2_PAIRS_SQL.format(cols="id sym_id, anc ancestor", side="id"))
def p2_ancestors(spark: SparkSession, d: str) -> DataFrame:
    """All ancestors of every twentieth symbol, by nested-set ranges."""
    out = h.ancestors(symbol_hierarchy(spark, d, named=False), _asked(spark, d))
    return out.select(F.col("id").alias("sym_id"), "ancestor")


P2_ALL_PAIRS_SQL = f"""
with recursive {P2_LINKS}
down as (select id from link where parent is null union all select l.id from link l join down w on l.parent = w.id),
good as (select l.id, l.parent from link l join down using (id)),
up as (select id, parent anc from good where parent is not null union all select u.id, g.parent from up u join good g on u.anc = g.id where g.parent is not null)
select {{cols}} from up
"""


@query("p2_all_descendants", P2_ALL_PAIRS_SQL.format(cols="anc sym_id, id descendant"))
def p2_all_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All descendants of every symbol, by nested-set ranges."""
    nodes = symbol_hierarchy(spark, d, named=False)
    return h.descendants(nodes, nodes).select(F.col("id").alias("sym_id"), "descendant")


@query("p2_all_ancestors", P2_ALL_PAIRS_SQL.format(cols="id sym_id, anc ancestor"))
def p2_all_ancestors(spark: SparkSession, d: str) -> DataFrame:
    """All ancestors of every symbol, by nested-set ranges."""
    nodes = symbol_hierarchy(spark, d, named=False)
    return h.ancestors(nodes, nodes).select(F.col("id").alias("sym_id"), "ancestor")


# 3: references to records that do not exist --------------------------------------------------


def orphan_state(spark: SparkSession, d: str) -> orp.OrphanState:
    syms, files, cmds = (table(spark, d, t) for t in ("symbols", "files", "commands"))
    defs, docs, touches = (table(spark, d, t) for t in ("defs", "symbol_docs", "session_files"))
    refs = (
        orp.references(defs, "defs", "sym_id", "symbols")
        .unionByName(orp.references(defs, "defs", "file_id", "files"))
        .unionByName(orp.references(touches, "session_files", "command_id", "commands"))
        .unionByName(orp.references(docs, "symbol_docs", "sym_id", "symbols"))
    )
    arrived = orp.parents(syms, "symbols").unionByName(orp.parents(files, "files")).unionByName(orp.parents(cmds, "commands"))
    return orp.replay(refs, arrived, Scratch(spark, "orphans"))


P3_BODY = """
with refs as (
  select 'symbols' target, 'defs' tab, 'sym_id' field_name, sym_id ref_key, loaded_at from defs
  union all select 'files', 'defs', 'file_id', file_id, loaded_at from defs
  union all select 'commands', 'session_files', 'command_id', command_id, loaded_at from session_files
  union all select 'symbols', 'symbol_docs', 'sym_id', sym_id, loaded_at from symbol_docs),
par as (
  select 'symbols' target, id, min(loaded_at) first_in, min(removed_at) first_out from symbols group by id
  union all select 'files', id, min(loaded_at), min(removed_at) from files group by id
  union all select 'commands', id, min(loaded_at), min(removed_at) from commands group by id),
f as (
  select distinct tab, field_name, ref_key, strftime(r.loaded_at at time zone 'UTC', '%Y-%m') period,
    case when p.id is null then 'missing' when r.loaded_at < p.first_in then 'late'
         when p.first_out <= r.loaded_at then 'deleted' end state
  from refs r left join par p on p.target = r.target and p.id = r.ref_key
  where ref_key is not null and ref_key <> 0 and r.loaded_at is not null)
"""


@query("p3_found", P3_BODY + "select * from f where state is not null")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Orphan references by table, field, key and month of arrival."""
    return orphan_state(spark, d).found()


@query("p3_report", P3_BODY + "select tab, field_name, period, state, count(*) n_keys from f where state is not null group by all")
def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of orphaned keys per table, field, month and state."""
    return orphan_state(spark, d).snapshot()


# 4: overlapping and gapped time intervals ----------------------------------------------------

P4_SQL = """
with c as (select id, session_id, started_at, finished_at,
                  row_number() over (partition by id order by loaded_at desc, session_id desc nulls last, started_at desc nulls last, finished_at desc nulls last) rn from commands where id is not null),
r as (select session_id, epoch(started_at)::bigint s, epoch(finished_at)::bigint e from c
      where rn = 1 and session_id is not null and finished_at is not null and started_at is not null and finished_at >= started_at),
m as (select *, max(e) over (partition by session_id order by s, e rows between unbounded preceding and 1 preceding) upto from r),
g as (select *, sum(case when upto is null or s > upto then 1 else 0 end) over (partition by session_id order by s, e rows unbounded preceding) grp from m),
b as (select session_id, min(s) s, max(e) e from g group by session_id, grp),
n as (select session_id, e, lead(s) over (partition by session_id order by s) nxt from b)
select session_id, 'busy' seg_kind, s start_s, e end_s from b
union all select session_id, 'gap', e, nxt from n where nxt is not null
"""


@query("p4_found", P4_SQL)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Busy stretches of every session and the gaps between them."""
    rows = iv.latest_rows(table(spark, d, "commands"), "id", ["session_id", "started_at", "finished_at"])
    sec = lambda c: F.floor(F.col(c) / F.lit(1_000_000)).cast("long")
    out = iv.busy_and_gaps(rows, "session_id", "started_at", "finished_at", Scratch(spark, "intervals"))
    return out.select(F.col("entity").alias("session_id"), "seg_kind", sec("seg_start").alias("start_s"), sec("seg_end").alias("end_s"))


# 6: a few keys holding most records ----------------------------------------------------------

P6_SQL = """
select 'symbols.pkg_id' field_name, pkg_id key_id, count(*) n_rows, count(distinct id) n_ids from symbols where pkg_id is not null and pkg_id <> 0 group by pkg_id
union all select 'defs.file_id', file_id, count(*), count(distinct sym_id) from defs where file_id is not null and file_id <> 0 group by file_id
"""


def task_count(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


@query("p6_found", P6_SQL)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows and distinct symbols of every package and file."""
    tasks, scratch = task_count(spark), Scratch(spark, "skew")
    a = skew.per_key(table(spark, d, "symbols"), "pkg_id", "id", tasks, scratch).withColumn("field_name", F.lit("symbols.pkg_id"))
    b = skew.per_key(table(spark, d, "defs"), "file_id", "sym_id", tasks, scratch).withColumn("field_name", F.lit("defs.file_id"))
    return a.unionByName(b).select("field_name", "key_id", "n_rows", "n_ids")


@query(
    "p6_file_spans",
    """
with f as (select id, max(path) path from files group by id)
select f.path, count(*) n_defs, count(distinct sym_id) n_syms, max(end_line)::bigint last_line
from defs d join f on d.file_id = f.id group by f.path
""",
)
def p6_file_spans(spark: SparkSession, d: str) -> DataFrame:
    """Per file path: definitions, symbols and last line, by a fragment-replicate join."""
    defs = table(spark, d, "defs").groupBy("file_id", "sym_id").agg(F.count(F.lit(1)).alias("n"), F.max("end_line").alias("last"))
    defs = Scratch(spark, "skew").save(defs)
    files = table(spark, d, "files").groupBy("id").agg(F.max("path").alias("path")).withColumnRenamed("id", "file_id")
    joined = skew.skew_join(defs, files, "file_id", "sym_id", task_count(spark))
    parts = joined.groupBy("path", "sym_id").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    return parts.groupBy("path").agg(
        F.sum("n").alias("n_defs"), F.count("sym_id").alias("n_syms"), F.max("last").cast("long").alias("last_line")
    )
