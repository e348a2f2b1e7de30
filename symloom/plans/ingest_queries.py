"""Queries of ingest transforms, sessions and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.functions.identifiers import safe_id
from symloom.operators import ingest as ing
from symloom.operators import rollup as ru
from symloom.operators import sessions as ss
from symloom.plans import query
from symloom.plans.projection import CTES, graph
from symloom.runtime import Scratch, table
from symloom.sources import frames as fr


@query(
    "i1_intern_files",
    "select path, arg_min(\"language\", struct_pack(l := loaded_at, i := id)) \"language\", arg_min(content_hash, struct_pack(l := loaded_at, i := id)) content_hash from files where path is not null and loaded_at is not null and content_hash is not null group by path",
)
def i1(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files").where("path is not null and loaded_at is not null and content_hash is not null")
    f = f.select("path", "language", F.hex("content_hash").alias("content_hash"), F.struct("loaded_at", "id").alias("pos"))
    return ing.intern_files(f).select("path", "language", "content_hash")


@query("i2_intern_packages", "select *, row_number() over (order by pos) id from (select c_mktsegment name, (c_nationkey % 3)::varchar \"version\", min(c_custkey) pos from customer group by 1, 2)")
def i2(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "customer").select(F.col("c_mktsegment").alias("name"), (F.col("c_nationkey") % 3).cast("string").alias("version"), F.col("c_custkey").alias("pos"))
    return ing.intern_packages(f).select("name", "version", "pos", "id")


FRAMES = """with fr as (select "language", pub_id, coalesce(pkg_id, 0) pkg, id, external, coalesce(partial, false) partial, id % 4 = 0 or removed_at is not null stub, struct_pack(l := loaded_at, e := external, p := coalesce(partial, false), s := id % 4 = 0 or removed_at is not null, n := coalesce(nargs, -1), q := coalesce(enclosing_sym_id, 0)) pos from symbols where pub_id is not null and loaded_at is not null and external is not null)"""


def _frames(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbols").where("pub_id is not null and loaded_at is not null and external is not null")
    stub = (F.col("id") % 4 == 0) | F.col("removed_at").isNotNull()
    part = F.coalesce("partial", F.lit(False))
    pos = F.struct("loaded_at", "external", part.alias("p"), stub.alias("s"), F.coalesce("nargs", F.lit(-1)).alias("n"), F.coalesce("enclosing_sym_id", F.lit(0)).alias("q"))
    return s.select("language", "pub_id", F.coalesce("pkg_id", F.lit(0)).alias("pkg"), "id", "external", part.alias("partial"), stub.alias("stub"), pos.alias("pos"))


@query("i3_intern_symbols", FRAMES + " select \"language\", pub_id, pkg, min(id) id from (select *, min(pos) over (partition by \"language\", pub_id, pkg) first from fr) where pos = first group by all")
def i3(spark: SparkSession, d: str) -> DataFrame:
    """A symbol is told by language, public id and package version: two versions are two symbols."""
    f = _frames(spark, d).withColumn("pos", F.struct("pos", "id"))
    return ing.first_sightings(f, ["language", "pub_id", "pkg"]).select("language", "pub_id", "pkg", "id")


@query("i4_stub_upgrade", FRAMES + " select \"language\", pub_id, arg_min(id, struct_pack(s := stub, p := pos)) id, arg_min(external or stub, struct_pack(s := stub, p := pos)) external from fr group by all")
def i4(spark: SparkSession, d: str) -> DataFrame:
    return ing.resolve_symbols(_frames(spark, d)).select("language", "pub_id", "id", "external")


@query(
    "i5_cross_wire_duplicates",
    FRAMES + """, n as (select *, row_number() over w n, coalesce(sum((not stub)::int) over (partition by "language", pub_id order by pos rows between unbounded preceding and 1 preceding), 0) seen from fr window w as (partition by "language", pub_id order by pos)),
v as (select case when stub then case when n = 1 then 'first' else 'duplicate' end when seen = 0 then case when n = 1 then 'first' else 'upgrade' end when partial then 'part' else 'duplicate' end verdict, "language", pub_id from n)
select "language", pub_id, verdict, count(*) n from v group by all""",
)
def i5(spark: SparkSession, d: str) -> DataFrame:
    return ing.duplicates(_frames(spark, d)).groupBy("language", "pub_id", "verdict").agg(F.count(F.lit(1)).alias("n"))


@query(
    "i6_build_defs",
    "select sym_id, file_id, case when z then 0 else start_line + 1 end start_line, start_col, case when z then 0 else end_line + 1 end end_line, end_col, case when b then body_start_line + 1 else 0 end body_start_line, case when b then body_end_line + 1 else 0 end body_end_line from (select distinct sym_id, file_id, start_line, start_col, end_line, end_col, body_start_line, body_end_line, start_line = 0 and start_col = 0 and end_line = 0 and end_col = 0 z, body_end_line > 0 b from defs)",
)
def i6(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "defs").select("sym_id", "file_id", "start_line", "start_col", "end_line", "end_col", "body_start_line", "body_end_line").distinct()
    r = x.select("sym_id", "file_id", F.array("start_line", "start_col", "end_line", "end_col").alias("range"), F.when(F.col("body_end_line") > 0, F.array("body_start_line", "body_end_line")).alias("body"))
    return ing.build_defs(r.withColumn("body", F.coalesce("body", F.array().cast("array<int>"))))


@query(
    "i7_resolve_edges",
    """with e as (select row_number() over () r, * from (select distinct sym_id source, file_id target, case sym_id % 4 when 0 then 'calls' when 1 then 'field_access' when 2 then 'contains' else 'nonsense' end k, case sym_id % 3 when 0 then 'read' when 1 then 'write' end op from defs)),
s as (select distinct id from symbols), f as (select distinct id from files)
select source src_id, coalesce(s2.id, f.id) target_id, case k when 'calls' then 3 when 'field_access' then 5 else 2 end kind, case when k = 'field_access' then case op when 'read' then 0 else 1 end end field_op
from e join s on s.id = source left join s s2 on s2.id = target left join f on f.id = target where k <> 'nonsense' and (k <> 'field_access' or op is not null) and coalesce(s2.id, f.id) is not null""",
)
def i7(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "defs").selectExpr("sym_id source", "file_id target", "case sym_id % 4 when 0 then 'calls' when 1 then 'field_access' when 2 then 'contains' else 'nonsense' end edge_kind", "case sym_id % 3 when 0 then 'read' when 1 then 'write' end field_op").distinct()
    ids = lambda t: table(spark, d, t).select(F.col("id").alias("ref"), "id").distinct()
    return ing.resolve_edges(e, ids("symbols"), ids("files"))


@query("i8_decode_kinds", "select kind, count(*) n from (select case kind when 'type_alias' then 'type_alias' when 'constant' then 'variable' when 'trait' then 'variable' when 'operator' then 'variable' when 'variable' then 'variable' else kind end kind from symbols) group by kind")
def i8(spark: SparkSession, d: str) -> DataFrame:
    """Wire names here are the stored kinds, type aliases spelled as on the wire."""
    wire = F.when(F.col("kind") == "type_alias", "type").otherwise(F.col("kind"))
    return table(spark, d, "symbols").select(ing.decode_kind(wire).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


MARKS = "['" + "', '".join(ing.LICENCE_MARKERS) + "']"
STRIP = "array_to_string(list_transform(string_split(replace({b}, chr(13) || chr(10), chr(10)), chr(10)), lambda x: rtrim(regexp_replace(regexp_replace(regexp_replace(x, '^\\s*(//!|///|//|/\\*\\*|/\\*|\\*/|\\*)?', ''), '\\*/$', ''), '^ ', ''), ' ')), chr(10))"


@query(
    "i9_file_docs",
    f"""with b as (select distinct sym_id file_id, doc from symbol_docs where doc is not null),
p as (select file_id, doc, list_transform(list_filter(regexp_split_to_array(doc, '\\n\\n'), lambda e: len(list_filter({MARKS}, lambda m: contains(lower(e), m))) = 0), lambda e: {STRIP.format(b='e')}) prose from b)
select file_id, array_to_string(list_filter(prose, lambda x: trim(x) <> ''), chr(10) || chr(10)) doc from p where len(list_filter(prose, lambda x: trim(x) <> '')) > 0""",
)
def i9(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "symbol_docs").where("doc is not null").select(F.col("sym_id").alias("file_id"), "doc").distinct()
    return ing.file_docs(b.select("file_id", F.split("doc", "\n\n").alias("blocks")))


@query(
    "i10_fold_errors",
    """with e as (select "language", id pos, case id % 3 when 0 then 'warning' when 1 then 'error' else 'other' end severity, 'm' || id message from (select id, min("language") "language" from symbols where id is not null group by id)),
r as (select *, row_number() over (partition by "language", severity <> 'warning' order by pos) rn from e)
select "language", sum((severity <> 'warning')::int)::bigint n_failed, sum((severity = 'warning')::int)::bigint n_warnings, coalesce(string_agg(message, '|' order by pos) filter (severity <> 'warning' and rn <= 32), '') failed from r group by 1""",
)
def i10(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "symbols").where("id is not null").groupBy("id").agg(F.min("language").alias("language"))
    return ing.fold_errors(e.selectExpr("language", "id pos", "case id % 3 when 0 then 'warning' when 1 then 'error' else 'other' end severity", "concat('m', id) message"))


@query("i12_impl_edges", """with n as (select file_id doc, sym_id % 50 name, sym_id sym from defs where file_id > 0), u as (select doc, name, min(sym) sym from n group by all having count(distinct sym) = 1), i as (select distinct file_id doc, sym_id % 50 a, (sym_id + 7) % 50 b from defs where file_id > 0)
select distinct x.sym src, y.sym dst from i join u x on x.doc = i.doc and x.name = a join u y on y.doc = i.doc and y.name = b""")
def i12(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "defs").where("file_id > 0")
    names = x.selectExpr("file_id doc", "sym_id % 50 name", "sym_id sym")
    return ing.impl_edges(x.selectExpr("file_id doc", "sym_id % 50 type_name", "(sym_id + 7) % 50 trait_name").distinct(), names)


RANGES = """rg as (select file_id, sym_id sym, body_start_line sl, 0 sc, body_end_line el, 4 ec from g_defs),
pt as (select file_id, sym_id pt, start_line + 1 line, 2 col, 'm' || (sym_id % 500) || case sym_id % 3 when 0 then '().' when 1 then '.' else '#' end symbol, (sym_id % 16)::int roles from g_defs),
en as (select p.file_id, pt, line, col, min(struct_pack(z := case when el = sl then (ec - sc)::bigint else (el - sl)::bigint * 1000000 + ec - sc end, s := sym)).s "owner" from pt p join rg r on r.file_id = p.file_id and line between sl and el and not (line = sl and col < sc) and not (line = el and col > ec) group by all)"""


def _ranges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    g = graph(spark, d, "g_defs")
    return g.selectExpr("file_id", "sym_id pt", "start_line + 1 line", "2 col", "concat('m', sym_id % 500, case sym_id % 3 when 0 then '().' when 1 then '.' else '#' end) symbol", "cast(sym_id % 16 as int) roles"), g.selectExpr("file_id", "sym_id sym", "body_start_line sl", "0 sc", "body_end_line el", "4 ec")


@query("i14_smallest_enclosing", CTES + ", " + RANGES + ' select file_id, pt, line, col, "owner" from en')
def i14(spark: SparkSession, d: str) -> DataFrame:
    p, r = _ranges(spark, d)
    return ing.smallest_enclosing(p.select("file_id", "pt", "line", "col"), r)


KINDED = """case when roles & 4 <> 0 then 'field_access' when roles & 2 <> 0 then 'imports' when roles & 8 <> 0 and ends_with(symbol, '.') and not contains(symbol, '().') then 'field_access' when kind in ('method', 'function') then 'calls'
 when kind = 'constructor' then 'instantiates' when ends_with(symbol, '.') and contains(symbol, '().') then 'calls' else 'type_use' end"""


@query("i16_classify_edges", CTES + ", " + RANGES + f", k as (select pt.*, case pt % 5 when 0 then 'method' when 1 then 'constructor' else 'class' end kind from pt) select pt, symbol, roles, {KINDED} edge_kind from k")
def i16(spark: SparkSession, d: str) -> DataFrame:
    p, _ = _ranges(spark, d)
    kind = F.expr("case pt % 5 when 0 then 'method' when 1 then 'constructor' else 'class' end")
    return p.select("pt", "symbol", "roles", ing.classify_edge(F.col("roles"), F.col("symbol"), kind).alias("edge_kind"))


@query("i13_derive_edges", CTES + ", " + RANGES + f""", tg as (select symbol, 1 + length(symbol) % 2 def_count, case length(symbol) % 3 when 0 then 'method' else 'class' end kind from (select distinct symbol from pt))
select distinct 's' || lpad("owner"::varchar, 9, '0') src, symbol target, {KINDED} kind from pt join en using (file_id, pt) join tg using (symbol) where roles & 1 = 0 and def_count <= 1""")
def i13(spark: SparkSession, d: str) -> DataFrame:
    p, r = _ranges(spark, d)
    targets = p.select("symbol").distinct().selectExpr("symbol", "1 + length(symbol) % 2 def_count", "case length(symbol) % 3 when 0 then 'method' else 'class' end kind")
    return ing.derive_edges(p, r.withColumn("sym", F.concat(F.lit("s"), F.lpad(F.col("sym").cast("string"), 9, "0"))), targets)


@query("i15_enclosing_chain", CTES + ", " + RANGES + ' select pt, coalesce("owner", pt) "owner" from pt left join en using (file_id, pt)')
def i15(spark: SparkSession, d: str) -> DataFrame:
    """The smallest body around a point, else the bare definition itself."""
    p, r = _ranges(spark, d)
    e = ing.smallest_enclosing(p.select("file_id", "pt", "line", "col"), r).select("file_id", "pt", "owner")
    return p.join(e, ["file_id", "pt"], "left").select("pt", F.coalesce("owner", "pt").alias("owner"))


@query("i17_descriptor_kinds", "select distinct d, case when regexp_matches(d, '\\(\\+?\\d*\\)\\.$') then 'method' when ends_with(d, '/') then 'namespace' when ends_with(d, '#') then 'class' when ends_with(d, '.') then 'field' when ends_with(d, ']') then 'type_parameter' when ends_with(d, ')') then 'parameter' when ends_with(d, ':') then 'constant' when ends_with(d, '!') then 'macro' else 'variable' end kind from (select name || case id % 9 when 0 then '().' when 1 then '(+1).' when 2 then '/' when 3 then '#' when 4 then '.' when 5 then ']' when 6 then ')' when 7 then ':' else '' end d from symbols where name is not null)")
def i17(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbols").where("name is not null").selectExpr("concat(name, case id % 9 when 0 then '().' when 1 then '(+1).' when 2 then '/' when 3 then '#' when 4 then '.' when 5 then ']' when 6 then ')' when 7 then ':' else '' end) d").distinct()
    return s.select("d", ing.kind_of_descriptor(F.col("d")).alias("kind"))


@query(
    "i17_numbered_kinds",
    "select distinct k number, case k when 7 then 'class' when 26 then 'method' when 63 then 'variable' when 35 then 'package' when 12 then 'enum_member' when 17 then 'function' else 'namespace' end kind from (select [0, 7, 26, 63, 35, 81, 3, 12, 17, 99][(id % 10)::int + 1] k from symbols)",
)
def i17_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Kinds by number; an unknown number, here of a namespace, leaves it to the descriptor."""
    numbers = F.array(*map(F.lit, (0, 7, 26, 63, 35, 81, 3, 12, 17, 99)))
    n = table(spark, d, "symbols").select(F.element_at(numbers, (F.col("id") % 10 + 1).cast("int")).alias("number")).distinct()
    return n.select("number", ing.kind_of(F.col("number"), F.lit("a/")).alias("kind"))


@query(
    "i18_test_paths",
    "select distinct path, regexp_matches(path, '^(.*/)?tests/.*$') or regexp_matches(path, '^.*_test\\.[^/]*$') or regexp_matches(path, '^[^/]*/s[^/]an\\.rs$') is_test from files where path is not null",
)
def i18_paths(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files").where("path is not null").select("path").distinct()
    return f.select("path", ing.test_path(F.col("path"), ("**/tests/**", "**_test.*", "*/s?an.rs")).alias("is_test"))


@query(
    "i18_test_symbols",
    """with s as (select distinct "language", kind, replace(replace(pub_id, 'digest', 'tests'), 'anchor', 'x_test') p from symbols where pub_id is not null), n as (select *, regexp_extract(p, '^[^:]+:(.*)$', 1) nat from s),
r as (select *, list_transform(string_split(nat, '::'), lambda x: regexp_replace(x, '[/.#]+$', '')) rs, string_split(nat, '.') ps from n)
select p, case when "language" = 'rust' then list_has_any(list_slice(rs, 1, len(rs) - 1), ['tests', 'test', 'bench', 'benches']) or (list_has_any(rs[-1:], ['tests', 'test', 'bench', 'benches']) and kind in ('package', 'module', 'namespace'))
when "language" = 'go' then len(list_filter(regexp_split_to_array(nat, '[/.]'), lambda x: ends_with(x, '_test') or x in ('tests', 'test'))) > 0
when "language" = 'python' then len(list_filter(list_slice(ps, 1, len(ps) - 1), lambda x: x in ('tests', 'test', '__tests__') or ends_with(x, '_test'))) > 0 or len(list_filter(ps, lambda x: starts_with(x, 'test_'))) > 0 or ps[-1] = 'conftest'
 or ((ps[-1] in ('tests', 'test', '__tests__') or ends_with(ps[-1], '_test')) and kind in ('package', 'module', 'namespace'))
 or ((starts_with(ps[-1], 'Test') or ends_with(ps[-1], 'Test') or ends_with(ps[-1], 'TestCase')) and kind in ('class', 'struct', 'trait', 'interface', 'enum', 'type_alias')) else false end is_test from r""",
)
def i18(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbols").where("pub_id is not null").selectExpr("language", "kind", "replace(replace(pub_id, 'digest', 'tests'), 'anchor', 'x_test') p").distinct()
    return s.select("p", ing.is_test_symbol(F.col("language"), F.col("kind"), F.col("p")).alias("is_test"))


@query("i19_safe_ids", "select distinct raw, regexp_replace(regexp_replace(raw, '[^\\p{L}\\p{N}._/:@+,=~#-]+', '_', 'g'), '[.#]+$', '') safe from (select replace(pub_id, '_', ' <%>') || case id % 3 when 0 then '.#' else '' end raw from symbols where pub_id is not null)")
def i19(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbols").where("pub_id is not null").selectExpr("concat(replace(pub_id, '_', ' <%>'), case id % 3 when 0 then '.#' else '' end) raw").distinct()
    return s.select("raw", safe_id(F.col("raw")).alias("safe"))


@query("i21_merge_runs", "select \"language\", embed_key pub_id, arg_min(coalesce(path, pub_id), row_id) first_path, count(distinct coalesce(path, pub_id)) n_paths, count(distinct coalesce(path, pub_id)) > 1 collides from knowledge where embed_key is not null and \"language\" is not null group by all")
def i21(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "knowledge").where("embed_key is not null and language is not null")
    return ing.merge_runs(k.select("language", F.col("embed_key").alias("pub_id"), F.coalesce("path", "pub_id").alias("path"), F.col("row_id").alias("pos")))


@query("i22_package_layout", "select f.path, arg_max('a:' || m.rel_dir, length(m.rel_dir)) anchor from (select distinct path from files where path is not null) f join (select distinct regexp_replace(path, '/[^/]*$', '') rel_dir from files where id % 2 = 0 and path like '%/%') m on f.path like m.rel_dir || '/%' group by f.path")
def i22(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "files").where("path is not null")
    m = f.where("id % 2 = 0 and path like '%/%'").select(F.regexp_replace("path", "/[^/]*$", "").alias("rel_dir")).distinct()
    return ru.covering_manifest(f, m.select("rel_dir", F.concat(F.lit("a:"), "rel_dir").alias("anchor")))


@query("s1_frames_round_trip", "select 'symbol' type, count(*) n, sum(id)::bigint ids from (select distinct id, pub_id, kind, name from symbols) union all select 'file', count(*), sum(id)::bigint from (select distinct id, path from files) union all select 'edge', count(*), sum(sym_id)::bigint from (select distinct sym_id, file_id from defs)")
def s1(spark: SparkSession, d: str) -> DataFrame:
    """Frames written as JSON lines and read again by type."""
    where = f"{Scratch(spark, 'frames').root}/frames"
    s = table(spark, d, "symbols").select(F.lit("symbol").alias("type"), "id", F.col("pub_id").alias("key"), "kind", "name").distinct()
    f = table(spark, d, "files").select(F.lit("file").alias("type"), "id", "path").distinct()
    e = table(spark, d, "defs").select(F.lit("edge").alias("type"), F.col("sym_id").alias("source"), F.col("file_id").alias("target")).distinct()
    fr.write_frames([s, f, e], where)
    got = fr.read_frames(spark, where)
    one = lambda t, c: got[t].agg(F.lit(t).alias("type"), F.count(F.lit(1)).alias("n"), F.sum(c).alias("ids"))
    return one("symbol", "id").unionByName(one("file", "id")).unionByName(one("edge", "source"))


# sessions ------------------------------------------------------------------------------------

SE = """with ev as (select session_id "session", started_at ts, id seq, branch, cwd from commands where session_id is not null and started_at is not null and id is not null)"""


@query(
    "e1_fold_sessions",
    SE + """ select "session", min(ts) first_seen, max(ts) last_seen, arg_min(branch, struct_pack(t := ts, s := seq)) filter (branch is not null) branch, arg_min(cwd, struct_pack(t := ts, s := seq)) filter (cwd is not null) cwd from (select distinct * from ev) group by 1""",
)
def e1(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "commands").where("session_id is not null and started_at is not null and id is not null")
    return ss.fold_sessions(ev.selectExpr("session_id session", "started_at ts", "id seq", "branch", "cwd").distinct())


@query("e2_live_status", "select user_id \"session\", arg_max(event_type, struct_pack(t := ts, s := event_id)) status, max(ts) status_at from events where user_id is not null group by 1")
def e2(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").selectExpr("user_id session", "ts", "event_id seq", "event_type status")
    return ss.status_history(e)[1]


@query("e3_clamped_counter", "with r as (select user_id \"session\", case when event_type in ('signup', 'click') then 1 else -1 end delta, sum(case when event_type in ('signup', 'click') then 1 else -1 end) over (partition by user_id order by event_id rows unbounded preceding) run from events) select \"session\", (sum(delta) - least(min(run), 0))::bigint n from r group by 1")
def e3(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").selectExpr("user_id session", "event_id seq", "case when event_type in ('signup', 'click') then 1 else -1 end delta")
    return ss.clamped_count(e)


@query(
    "e4_pair_commands",
    """with s as (select distinct tool_use_id, session_id "session", started_at from commands where tool_use_id is not null and started_at is not null), f as (select distinct tool_use_id, finished_at from commands where finished_at is not null)
select s.tool_use_id, "session", started_at, min(finished_at) finished_at, min(finished_at) is null running from s left join f on f.tool_use_id = s.tool_use_id and finished_at >= started_at group by all""",
)
def e4(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "commands")
    starts = c.where("tool_use_id is not null and started_at is not null").selectExpr("tool_use_id", "session_id session", "started_at").distinct()
    return ss.pair_commands(starts, c.where("finished_at is not null").select("tool_use_id", "finished_at").distinct())


@query("e5_file_touches", "select project, channel, count(*) n, count(command_id) with_command, count(distinct path) n_paths from session_files group by all")
def e5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "session_files").groupBy("project", "channel").agg(F.count(F.lit(1)).alias("n"), F.count("command_id").alias("with_command"), F.countDistinct("path").alias("n_paths"))


GC_NOW = "2025-06-15 00:00:00"


@query(
    "e6_retention",
    f"""with cut as (select timestamptz '{GC_NOW}+00' - interval 30 day c), old as (select distinct id from commands, cut where started_at < c and finished_at is not null),
kc as (select * from commands, cut where not coalesce(started_at < c and finished_at is not null, false)),
kt as (select * from session_files, cut where (command_id is null and not coalesce(t < c, false)) or (command_id is not null and command_id not in (select id from old where id is not null))),
se as (select session_id, max(started_at) last_seen from commands where session_id is not null group by 1),
ks as (select * from se, cut where not (last_seen < c) or session_id in (select session_id from kc union select session_id from kt))
select 'commands' what, count(*) n from kc union all select 'files', count(*) from kt union all select 'sessions', count(*) from ks""",
)
def e6(spark: SparkSession, d: str) -> DataFrame:
    c, t = table(spark, d, "commands"), table(spark, d, "session_files")
    s = c.where("session_id is not null").groupBy("session_id").agg(F.max("started_at").alias("last_seen"))
    kept = ss.retain(c, t, s, F.lit(GC_NOW).cast("timestamp"))
    parts = [k.agg(F.lit(n).alias("what"), F.count(F.lit(1)).alias("n")) for n, k in zip(("commands", "files", "sessions"), kept)]
    return ru.union_all(parts)


@query("e7_signatures", "select distinct cmd_text, signature from (select cmd_text, split_part(cmd_text, ' ', 1) || ' ' || split_part(cmd_text, ' ', 2) signature from commands where cmd_text is not null and regexp_matches(cmd_text, '^[a-z-]+ [a-z]+( [a-zA-Z0-9_.-]+)*$'))")
def e7(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "commands").where("cmd_text is not null").where(F.col("cmd_text").rlike("^[a-z-]+ [a-z]+( [a-zA-Z0-9_.-]+)*$")).select("cmd_text").distinct()
    return c.select("cmd_text", ss.signature("cmd_text").alias("signature"))


@query("e7_all_signatures")
def e7_all(spark: SparkSession, d: str) -> DataFrame:
    """Signatures of all commands: redirects, paths, quotes and assignments too, which the SQL twin of e7_signatures cannot follow."""
    c = table(spark, d, "commands").where("cmd_text is not null").select("cmd_text").distinct()
    return c.select("cmd_text", ss.signature("cmd_text").alias("signature"))


BURSTS = """with x as (select user_id "key", ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 6 hour then 0 else 1 end brk from events),
g as (select *, sum(brk) over (partition by "key" order by ts rows unbounded preceding) g from x)
select "key", min(ts) "start", max(ts) "end", count(*) n from g group by "key", g"""


@query("t1_debounce", BURSTS)
def t1(spark: SparkSession, d: str) -> DataFrame:
    """Bursts of a user's events: sessions with a gap of six hours."""
    return ss.bursts(table(spark, d, "events"), "user_id", "ts", "6 hours")


@query("t2_path_filter", "select distinct path from session_files where path is not null and not list_has_any(string_split(path, '/'), ['node_modules', 'target', 'bin', 'obj', '.git', '.symloom']) and lower(regexp_extract(path, '\\.([^./]+)$', 1)) in ('rs', 'py', 'go', 'ts') and not regexp_matches(path, 'ledger')")
def t2(spark: SparkSession, d: str) -> DataFrame:
    from symloom.streaming.watch import relevant

    return relevant(table(spark, d, "session_files").where("path is not null").select("path").distinct(), ("rs", "py", "go", "ts"), ("ledger",))


@query("t3_is_stale", "select e.user_id \"key\", max(event_id) > coalesce(max(r), -1) is_stale from events e left join (select user_id, max(event_id) r from events where event_type <> 'error' group by 1) x on x.user_id = e.user_id group by 1")
def t3(spark: SparkSession, d: str) -> DataFrame:
    from symloom.operators.reports import event_lag

    e = table(spark, d, "events").selectExpr("user_id key", "event_id seq", "event_type")
    return event_lag(e, e.where("event_type <> 'error'"))
