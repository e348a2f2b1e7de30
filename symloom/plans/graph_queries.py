"""Queries over the projected code graph: fetches, scans, traversal and locations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom import model
from symloom.operators import lookup as lk
from symloom.operators import traversal as tr
from symloom.plans import query
from symloom.plans.projection import CTES, graph
from symloom.runtime import Scratch, table


def add(name: str, sql: str):
    return query(name, CTES + "\n" + sql)


# point fetch, catalogue, scans --------------------------------------------------------------


@add("q1_fetch_symbol", "select language, pub_id, min(id) id, arg_min(name, id) name from g_symbols where kind in ('interface', 'function') group by language, pub_id")
def q1(spark: SparkSession, d: str) -> DataFrame:
    s = graph(spark, d, "g_symbols")
    wanted = s.where(F.col("kind").isin("interface", "function")).select("language", "pub_id")
    return lk.fetch_symbols(s, wanted).select("language", "pub_id", "id", "name")


@add("q2_fetch_by_short_id", "select id, pub_id from g_symbols where id in (select l_suppkey + 1000000 from lineitem)")
def q2(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "lineitem").select((F.col("l_suppkey") + 1_000_000).alias("x"))
    return lk.by_ids(graph(spark, d, "g_symbols"), ids).select("id", "pub_id")


@query("q3_first_docs", "select sym_id, m.sig, m.doc from (select sym_id, min(struct_pack(sig := sig, doc := doc)) m from symbol_docs where sig is not null and doc is not null group by sym_id)")
def q3(spark: SparkSession, d: str) -> DataFrame:
    return lk.first_docs(table(spark, d, "symbol_docs").where("sig is not null and doc is not null"))


@add("q4_fetch_defs", "select sym_id, file_id, start_line, end_line from g_defs where sym_id in (select id from g_symbols where kind = 'function')")
def q4(spark: SparkSession, d: str) -> DataFrame:
    ids = graph(spark, d, "g_symbols").where("kind = 'function'").select("id")
    return lk.by_ids(graph(spark, d, "g_defs"), ids, "sym_id").select("sym_id", "file_id", "start_line", "end_line")


@add("q4_def_lines", "select file_id, min(start_line) first_line, max(end_line) last_line, count(*) n from g_defs group by file_id")
def q4b(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d, "g_defs").groupBy("file_id").agg(F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"), F.count(F.lit(1)).alias("n"))


@add("q5_fetch_package_and_file", "select 'package' what, id, name from g_packages union all select 'file', id, path from g_files")
def q5(spark: SparkSession, d: str) -> DataFrame:
    p, f = graph(spark, d, "g_packages"), graph(spark, d, "g_files")
    return p.select(F.lit("package").alias("what"), "id", "name").unionByName(f.select(F.lit("file").alias("what"), "id", F.col("path").alias("name")))


@add("q6_distinct_languages", "select distinct language from g_symbols order by 1")
def q6(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d, "g_symbols").select("language").distinct().orderBy("language")


@add("q6_distinct_packages", "select distinct name, external from g_packages order by 1")
def q6b(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d, "g_packages").select("name", "external").distinct().orderBy("name")


@add(
    "q7_count_tables",
    """select 'symbols' table_name, count(*) n_rows from g_symbols union all select 'edges', count(*) from g_edges union all select 'defs', count(*) from g_defs
union all select 'files', count(*) from g_files union all select 'packages', count(*) from g_packages union all select 'sessions', 0""",
)
def q7(spark: SparkSession, d: str) -> DataFrame:
    tables = {n: graph(spark, d, f"g_{n}") for n in ("symbols", "edges", "defs", "files", "packages")}
    return lk.count_tables(tables | {"sessions": table(spark, d, "commands")})


@add("q9_symbols_by_ids", "select id, name, kind from g_symbols where id in (select src_id from g_edges where kind = 8)")
def q9(spark: SparkSession, d: str) -> DataFrame:
    ids = graph(spark, d, "g_edges").where("kind = 8").select("src_id")
    return lk.by_ids(graph(spark, d, "g_symbols"), ids).select("id", "name", "kind")


@add("q10_scan_symbols", "select id, pub_id, kind, external, test from g_symbols")
def q10(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d, "g_symbols").select("id", "pub_id", "kind", "external", "test")


@add("q10_scan_def_files", "select distinct sym_id, file_id from g_defs")
def q10b(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d, "g_defs").select("sym_id", "file_id").distinct()


@query("q10_scan_file_docs", "select file_id, doc from file_docs where doc <> ''")
def q10c(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "file_docs").where("doc <> ''").select("file_id", "doc")


@add(
    "q11_symbol_bodies",
    """select d.sym_id, d.file_id, f.path, f.language file_language, s.name, body_start_line, body_end_line from g_defs d join g_files f on f.id = d.file_id join g_symbols s on s.id = d.sym_id
where body_start_line > 0 and body_end_line >= body_start_line""",
)
def q11(spark: SparkSession, d: str) -> DataFrame:
    return lk.symbol_bodies(graph(spark, d, "g_defs"), graph(spark, d, "g_files"), graph(spark, d, "g_symbols"))


@add(
    "q12_symbol_surfaces",
    """select s.id, s.pub_id, s.kind, s.name, coalesce(t.sig, '') sig, coalesce(t.doc, '') doc, coalesce(f.path, '') path, d.start_line
from g_symbols s left join g_docs t on t.sym_id = s.id left join g_defs d on d.sym_id = s.id left join g_files f on f.id = d.file_id where s."language" = 'rust'""",
)
def q12(spark: SparkSession, d: str) -> DataFrame:
    """All symbols of one language, as the scan takes them."""
    return lk.symbol_surfaces(*(graph(spark, d, f"g_{t}") for t in ("symbols", "docs", "defs", "files")), language="rust")


@add("q13_scan_edges", "select distinct src_id, target_id from g_edges where kind = 3 order by 1, 2")
def q13(spark: SparkSession, d: str) -> DataFrame:
    e = graph(spark, d, "g_edges").where(F.col("kind") == model.EDGE_KINDS["calls"])
    return e.select("src_id", "target_id").distinct().orderBy("src_id", "target_id")


@add("q15_aggregation_extents", "select sym_id, file_id, case when body_end_line > 0 then body_start_line else start_line end first_line, case when body_end_line > 0 then body_end_line else end_line end last_line from g_defs")
def q15(spark: SparkSession, d: str) -> DataFrame:
    body = F.col("body_end_line") > 0
    return graph(spark, d, "g_defs").select(
        "sym_id", "file_id", F.when(body, F.col("body_start_line")).otherwise(F.col("start_line")).alias("first_line"), F.when(body, F.col("body_end_line")).otherwise(F.col("end_line")).alias("last_line")
    )


@query("q16_code_node_resolver", "select embed_key, pub_id, pub_id in (select pub_id from symbols) known from (select distinct embed_key, pub_id from knowledge where pub_id <> '')")
def q16(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "knowledge").where("pub_id <> ''").select("embed_key", "pub_id").distinct()
    ids = table(spark, d, "symbols").select("pub_id").distinct().withColumn("hit", F.lit(True))
    return k.join(ids, "pub_id", "left").select("embed_key", "pub_id", F.col("hit").isNotNull().alias("known"))


@add("q17_files_by_basename", "select id, path, split_part(path, '/', -1) base from g_files where not external and language <> 'markdown' and split_part(path, '/', -1) in ('lib.rs', 'model.ts', 'demo.py', 'n1.md')")
def q17(spark: SparkSession, d: str) -> DataFrame:
    names = spark.createDataFrame([("lib.rs",), ("model.ts",), ("demo.py",), ("n1.md",)], "b string")
    return lk.files_by_basename(graph(spark, d, "g_files"), names).select("id", "path", "base")


@add(
    "q18_symbols_by_short_name",
    "select s.id, s.name, min(f.path) path from g_symbols s join g_defs d on d.sym_id = s.id join g_files f on f.id = d.file_id where s.name_lower in (select lower(replace(p_name, ' ', '_')) from part) group by s.id, s.name",
)
def q18(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").select(F.lower(F.regexp_replace("p_name", " ", "_")).alias("n"))
    return lk.symbols_by_short_name(graph(spark, d, "g_symbols"), names, graph(spark, d, "g_defs"), graph(spark, d, "g_files"))


# traversal ----------------------------------------------------------------------------------


def listing_sql(kind: int, node: str, other: str, keep: str = "not s.external and not s.test", limit: int = 25, after: int = 0, which: str = "true") -> str:
    return f"""
, lp as (select distinct {node} node, {other} other from g_edges where kind = {kind} and {other} > {after} and {which}),
lt as (select node, count(*) total from lp group by node),
lr as (select node, s.id, s.name, row_number() over (partition by node order by s.id) rn from lp join g_symbols s on s.id = other where {keep}),
lg as (select *, count(*) over (partition by node) size from lr where rn <= {limit})
select node, id, name, total, (size = {limit} and size < total) more from lg join lt using (node)"""


def _list(spark: SparkSession, d: str, kind: str, outbound: bool, **kw) -> DataFrame:
    return tr.listing(graph(spark, d, "g_edges"), graph(spark, d, "g_symbols"), kind, outbound, **kw)


@add("g1_list_outbound", listing_sql(4, "src_id", "target_id", limit=3, after=1000010))
def g1(spark: SparkSession, d: str) -> DataFrame:
    return _list(spark, d, "type_use", True, limit=3, after=1_000_010)


@add("g1_list_inbound", listing_sql(8, "target_id", "src_id"))
def g1b(spark: SparkSession, d: str) -> DataFrame:
    return _list(spark, d, "instantiates", False)


@add("g2_row_narrowing", listing_sql(3, "target_id", "src_id", "s.kind in ('method') and s.language in ('rust', 'go') and s.pkg_id in (select id from g_packages where name in ('pkg_0', 'pkg_7', 'pkg_15', 'pkg_14', 'none'))"))
def g2(spark: SparkSession, d: str) -> DataFrame:
    narrow = tr.Narrow(True, True, ("pkg_0", "pkg_7", "pkg_15", "pkg_14", "none"), ("method",), ("rust", "go"))
    return _list(spark, d, "calls", False, narrow=narrow, packages=graph(spark, d, "g_packages"))


@add(
    "g3_find_at_location",
    """, pl as (select distinct file_id, start_line + 1 line from g_defs),
h as (select p.file_id, p.line, sym_id, min(end_line - start_line) span from pl p join g_defs d on d.file_id = p.file_id and p.line between d.start_line and d.end_line where start_line >= 1 group by all)
select *, row_number() over (partition by file_id, line order by span, sym_id) rank from h""",
)
def g3(spark: SparkSession, d: str) -> DataFrame:
    defs = graph(spark, d, "g_defs")
    return lk.at_location(defs, defs.select("file_id", (F.col("start_line") + 1).alias("line")))


@add("g4_module_files", "select distinct src_id module, f.id, f.path from g_edges e join g_files f on f.id = e.target_id where e.kind = 2")
def g4(spark: SparkSession, d: str) -> DataFrame:
    return tr.module_files(graph(spark, d, "g_edges"), graph(spark, d, "g_files"))


@add("g5_list_callers", listing_sql(3, "target_id", "src_id"))
def g5(spark: SparkSession, d: str) -> DataFrame:
    return _list(spark, d, "calls", False)


@add("g5_list_callees", listing_sql(3, "src_id", "target_id", limit=2))
def g5b(spark: SparkSession, d: str) -> DataFrame:
    return _list(spark, d, "calls", True, limit=2)


@add("g5_list_implementers", listing_sql(6, "target_id", "src_id"))
def g5c(spark: SparkSession, d: str) -> DataFrame:
    return _list(spark, d, "implements", False)


@add("g5_list_in_scope", listing_sql(1, "target_id", "src_id"))
def g5d(spark: SparkSession, d: str) -> DataFrame:
    return _list(spark, d, "defined_in", False)


@add(
    "g5_list_overrides",
    """, o as (select o1.o_orderkey + 10000000 src_id, 10000000 + min(o2.o_orderkey) target_id from orders o1 join orders o2 on o1.o_custkey = o2.o_custkey and o2.o_orderkey > o1.o_orderkey group by 1)
select target_id node, s.id, s.name from o join g_symbols s on s.id = src_id where not s.external and not s.test""",
)
def g5e(spark: SparkSession, d: str) -> DataFrame:
    """Overrides are not in the projected edges: each order's method overrides the customer's next one."""
    nxt = F.expr("lead(o_orderkey) over (partition by o_custkey order by o_orderkey)")
    e = table(spark, d, "orders").select((F.col("o_orderkey") + 10_000_000).alias("src_id"), (nxt + 10_000_000).alias("target_id")).where("target_id is not null")
    e = e.withColumn("kind", F.lit(model.EDGE_KINDS["overrides"]))
    return tr.listing(e, graph(spark, d, "g_symbols"), "overrides", False).select("node", "id", "name")


@add(
    "g6_list_correspondences",
    """, c as (select distinct 1000000 + l_suppkey a, 4000000 + l_partkey b from lineitem where l_discount >= 0.09)
select * from (select b node, s.id, 'inbound' direction, row_number() over (partition by b order by s.id) rn from c join g_symbols s on s.id = a where not external and not test
union all select a, s.id, 'outbound', row_number() over (partition by a order by s.id) from c join g_symbols s on s.id = b where not external and not test) where rn <= 5""",
)
def g6(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "lineitem").where("l_discount >= 0.09").select(
        (F.col("l_suppkey") + 1_000_000).alias("src_id"), (F.col("l_partkey") + 4_000_000).alias("target_id"), F.lit(model.EDGE_KINDS["corresponds_to"]).alias("kind")
    )
    out = tr.both_ways(e, graph(spark, d, "g_symbols"), "corresponds_to", 5)
    rn = F.expr("row_number() over (partition by node, direction order by id)")
    return out.select("node", "id", "direction", rn.alias("rn"))


@add("g7_list_imports", "select src_id node, target_id id, 'outbound' direction from g_edges where kind = 10 and target_id in (select id from g_symbols where not external and not test) union select target_id, src_id, 'inbound' from g_edges where kind = 10 and src_id in (select id from g_symbols where not external and not test)")
def g7(spark: SparkSession, d: str) -> DataFrame:
    return tr.both_ways(graph(spark, d, "g_edges"), graph(spark, d, "g_symbols"), "imports").select("node", "id", "direction")


USAGES_SQL = """
, k(kind, ordinal, via) as (values (3, 0, 'calls'), (4, 1, 'type_use'), (5, 2, 'field_access'), (8, 3, 'instantiates')),
up as (select distinct target_id node, src_id id, ordinal, via from g_edges join k using (kind)),
ur as (select up.*, row_number() over (partition by node, ordinal order by id) rn from up join g_symbols s using (id) where not s.external and not s.test),
uo as (select *, row_number() over (partition by node order by ordinal, id) pos from ur where rn <= 25)
select node, id, via, pos from uo where pos <= 25"""


@add("g8_list_usages", USAGES_SQL)
def g8(spark: SparkSession, d: str) -> DataFrame:
    return tr.usages(graph(spark, d, "g_edges"), graph(spark, d, "g_symbols"))


@add(
    "g9_find_usages",
    """
, qs as (select distinct q from (select name q from g_symbols where kind in ('function', 'interface') union all select pub_id from g_symbols where kind = 'module' union all select path from g_files union all select 'nothing')),
hits as (select q, min(id) target_id, false is_file, 0 tier from qs join g_symbols on pub_id = q group by q
 union all select q, min(id), true, 1 from qs join g_files on path = q group by q
 union all select q, id, false, 2 from qs join g_symbols on name_lower = lower(q)),
best as (select *, min(tier) over (partition by q) best from hits),
kept as (select *, count(*) over (partition by q) n_targets, row_number() over (partition by q order by target_id) rn from best where tier = best),
k(kind, ordinal, via) as (values (3, 0, 'calls'), (4, 1, 'type_use'), (5, 2, 'field_access'), (8, 3, 'instantiates'), (10, 4, 'imports')),
used as (select distinct src_id, target_id, ordinal, via from g_edges join k using (kind)),
r as (select q, target_id, src_id id, via, n_targets, count(*) over (partition by q) n_rows, row_number() over (partition by q order by rn, ordinal, src_id) pos from kept join used using (target_id) join g_symbols s on s.id = src_id
 where rn <= 10 and not s.external and not s.test and (not is_file or via = 'imports'))
select q, target_id, id, via, pos, n_targets, (n_targets > 1 and n_rows > 25) truncated from r where pos <= 25""",
)
def g9(spark: SparkSession, d: str) -> DataFrame:
    s, f = graph(spark, d, "g_symbols"), graph(spark, d, "g_files")
    qs = s.where(F.col("kind").isin("function", "interface")).select(F.col("name").alias("q"))
    qs = qs.union(s.where("kind = 'module'").select("pub_id")).union(f.select("path")).union(spark.createDataFrame([("nothing",)], "q string"))
    return tr.find_usages(qs, s, f, graph(spark, d, "g_edges"))


HYDRATE_SQL = """
, sp as (select sym_id, min(struct_pack(file_id := file_id, a := start_line, b := end_line)) s from g_defs where file_id <> 0 and start_line >= 1 group by sym_id)
select y.id, y.name, p.name package, './' || f.path || '#' || s.a || case when s.b > s.a then '-' || s.b else '' end "location", least(nargs, 255) nargs
from g_symbols y left join g_packages p on p.id = y.pkg_id left join sp on sp.sym_id = y.id left join g_files f on f.id = s.file_id"""


@add("g10_hydrate", HYDRATE_SQL)
def g10(spark: SparkSession, d: str) -> DataFrame:
    out = lk.hydrate(*(graph(spark, d, f"g_{t}") for t in ("symbols", "defs", "files", "packages")))
    return out.select("id", "name", "package", "location", "nargs")


@add(
    "g11_get_symbol",
    """
, w as (select distinct l_partkey + 4000000 id from lineitem union select 5::bigint union select 99::bigint),
fd as (select sym_id, min(sig) sig from g_docs group by sym_id),
sp as (select sym_id, string_agg('./' || f.path || '#' || start_line || case when end_line > start_line then '-' || end_line else '' end, ',' order by './' || f.path || '#' || start_line || case when end_line > start_line then '-' || end_line else '' end) places
 from g_defs d join g_files f on f.id = d.file_id group by sym_id)
select w.id, s.id is not null found, s.name, s.kind, p.name parent, fd.sig, sp.places from w left join g_symbols s using (id) left join g_symbols p on p.id = s.enclosing_sym_id left join fd on fd.sym_id = w.id left join sp on sp.sym_id = w.id""",
)
def g11(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "lineitem").select((F.col("l_partkey") + 4_000_000).alias("id")).union(spark.createDataFrame([(5,), (99,)], "id long"))
    return lk.symbol_cards(*(graph(spark, d, f"g_{t}") for t in ("symbols", "docs", "defs", "files")), w)


@query(
    "g12_get_source",
    "select doc_id sym_id, array_to_string(list_slice(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 2, 4), chr(10)) source from documents where text is not null",
)
def g12(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("file_id"), "text")
    spans = texts.select(F.col("file_id").alias("sym_id"), "file_id", F.lit(2).alias("start_line"), F.lit(4).alias("end_line"))
    return lk.source_lines(spans, texts)


@add(
    "g13_provenance_closure",
    """, links as (select distinct src_id src, target_id dst from g_edges where kind = 10 union select id, enclosing_sym_id from g_symbols where kind in ('module', 'interface')),
c as (select src, dst from links union select c.src, l.dst from c join links l on l.src = c.dst)
select src, dst from c""",
)
def g13(spark: SparkSession, d: str) -> DataFrame:
    """Successors of every node over imports and scopes; cyclic data reaches itself."""
    a = graph(spark, d, "g_edges").where("kind = 10").select(F.col("src_id").alias("src"), F.col("target_id").alias("dst"))
    b = graph(spark, d, "g_symbols").where(F.col("kind").isin("module", "interface")).select(F.col("id").alias("src"), F.col("enclosing_sym_id").alias("dst"))
    return tr.closure(a.unionByName(b), Scratch(spark, "closure"))


@add(
    "flagship_top_callers",
    """, c as (select e.target_id id, count(distinct e.src_id) n_callers from g_edges e join g_symbols s on s.id = e.src_id where e.kind = 3 and not s.external and not s.test group by e.target_id)
select s.id, s.name, p.name package, n_callers from c join g_symbols s using (id) join g_packages p on p.id = s.pkg_id where s.kind = 'function' order by n_callers desc, s.id limit 20""",
)
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The functions with the most callers, with package and place: a top-20 report."""
    s, e = graph(spark, d, "g_symbols"), graph(spark, d, "g_edges")
    callers = tr.adjacent(e, "calls", False).join(s.where("not external and not test").select(F.col("id").alias("other")), "other", "left_semi")
    n = callers.groupBy(F.col("node").alias("id")).agg(F.count(F.lit(1)).alias("n_callers"))
    refs = lk.hydrate(s.where("kind = 'function'"), *(graph(spark, d, f"g_{t}") for t in ("defs", "files", "packages")))
    return refs.join(n, "id").select("id", "name", "package", "n_callers").orderBy(F.desc("n_callers"), "id").limit(20)
