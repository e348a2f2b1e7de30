"""Queries of the finished store, the rolled-up graph and its analytics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.functions.hashing import xxh3_64
from symloom.functions.identifiers import SPLIT_SQL, split_identifier, verbatim
from symloom.operators import analytics as an
from symloom.operators import axes as ax
from symloom.operators import finalize as fin
from symloom.operators import rollup as ru
from symloom.plans import query
from symloom.plans.projection import CTES, graph
from symloom.runtime import Scratch, input_mark, published, table


def add(name: str, sql: str):
    return query(name, CTES + "\n" + sql)


# store finalisation --------------------------------------------------------------------------


@query(
    "f1_purge_placeholders",
    "select sym_id, start_line::bigint start_line, count(*) n from defs where not (start_line = 0 and sym_id in (select sym_id from defs where start_line >= 1 and sym_id is not null)) group by all",
)
def f1(spark: SparkSession, d: str) -> DataFrame:
    out = fin.purge_placeholders(table(spark, d, "defs"))
    return out.groupBy("sym_id", F.col("start_line").cast("long").alias("start_line")).agg(F.count(F.lit(1)).alias("n"))


SUBSET = "case when external then 'external' when test then 'test' else 'internal' end"
STATS = f"""
, st as (select 'language' scope, language "key", {SUBSET} subset, 'symbols' metric, count(*) "value" from g_symbols group by all
union all select 'language', language, {SUBSET}, 'files', count(*) from g_files group by all
union all select 'language', s.language, case when s.external then 'external' when s.test then 'test' else 'internal' end, 'defs', count(*) from g_defs x join g_symbols s on s.id = x.sym_id group by all
union all select 'manager', manager, case when external then 'external' else 'internal' end, 'packages', count(*) from g_packages group by all)"""


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return fin.entity_stats(*(graph(spark, d, f"g_{t}") for t in ("symbols", "files", "defs", "packages")))


@add("f2_entity_stats", STATS + " select * from st")
def f2(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d)


@add("q8_stats", STATS + " select scope, metric, sum(\"value\")::bigint total from st group by all")
def q8(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d).groupBy("scope", "metric").agg(F.sum("value").alias("total"))


@add(
    "r4_workspace_overview",
    STATS + """ select "key" "language", metric, sum(case when subset = 'internal' then "value" else 0 end)::bigint internal, sum(case when subset = 'test' then "value" else 0 end)::bigint test,
sum(case when subset = 'external' then "value" else 0 end)::bigint external, sum("value")::bigint total from st where scope = 'language' group by all""",
)
def r4(spark: SparkSession, d: str) -> DataFrame:
    return fin.workspace_overview(_stats(spark, d))


@add(
    "s6_upsert_stats",
    STATS + """, nw as (select scope, "key", subset, metric, "value" + 1 "value" from st where metric = 'symbols'),
b as (select *, 0 seq from st union all select *, 1 from nw)
select scope, "key", subset, metric, arg_max("value", seq) "value" from b group by all""",
)
def s6(spark: SparkSession, d: str) -> DataFrame:
    old = _stats(spark, d)
    return fin.upsert_stats(old, old.where("metric = 'symbols'").withColumn("value", F.col("value") + 1))


NAME_ROWS = f"""
, fd as (select sym_id, min(sig) sig, min(case when doc <> '' then doc end) doc from g_docs group by sym_id)
select 'name:' || s."language" || ':' || s.pub_id embed_key, s.id, coalesce(fd.sig, s.kind || ' ' || s.name) sig, {SPLIT_SQL.format(c="s.name")} name_text, fd.doc from g_symbols s left join fd on fd.sym_id = s.id"""


def _name_rows(spark: SparkSession, d: str) -> DataFrame:
    return fin.name_rows(graph(spark, d, "g_symbols"), graph(spark, d, "g_docs"))


@add("f3_name_rows", NAME_ROWS)
def f3(spark: SparkSession, d: str) -> DataFrame:
    return _name_rows(spark, d)


@add("f3_fingerprints", NAME_ROWS.replace("select 'name:'", ", nr as (select 'name:'") + ') select id, min(id) over (partition by doc) first_id from nr where doc is not null')
def f3b(spark: SparkSession, d: str) -> DataFrame:
    """The first symbol of equal docs, by XXH3 fingerprints; a test compares the fingerprints with the library."""
    rows = _name_rows(spark, d).where("doc is not null").select("id", xxh3_64("doc").alias("fingerprint"))
    return rows.join(rows.groupBy("fingerprint").agg(F.min("id").alias("first_id")), "fingerprint").select("id", "first_id")


@add("f4_doc_rows", "select 'doc:' || s.\"language\" || ':' || s.pub_id embed_key, s.id, t.doc doc_text from g_symbols s join g_docs t on t.sym_id = s.id where t.doc <> ''")
def f4(spark: SparkSession, d: str) -> DataFrame:
    return fin.doc_rows(graph(spark, d, "g_symbols"), graph(spark, d, "g_docs"))


@query("f5_file_doc_rows", "select 'doc:' || f.\"language\" || ':' || f.path embed_key, '' pub_id, f.id, f.path, t.doc doc_text from files f join file_docs t on t.file_id = f.id where t.doc <> ''")
def f5(spark: SparkSession, d: str) -> DataFrame:
    return fin.file_doc_rows(table(spark, d, "files"), table(spark, d, "file_docs"))


@add("f6_name_words", f"select id, word, count(*) n from (select id, unnest(string_split({SPLIT_SQL.format(c='name')}, ' ')) word from g_symbols) where word <> '' group by all")
def f6(spark: SparkSession, d: str) -> DataFrame:
    return fin.name_words(graph(spark, d, "g_symbols"))


FLAT = "translate(coalesce(sig, ''), '<>=\"/', '     ')"
for _a, _b in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&apos;", "''"), ("&amp;", "&")):
    FLAT = f"replace({FLAT}, '{_a}', '{_b}')"
FLAT = f"trim(regexp_replace({FLAT}, '\\s+', ' ', 'g'))"


@query("f7_verbatim", f"select sym_id, case when doc <> '' and f <> '' then f || ' ' || doc when doc <> '' then doc else f end \"text\" from (select sym_id, doc, {FLAT} f from (select distinct sym_id, coalesce(sig, '') sig, coalesce(doc, '') doc from symbol_docs))")
def f7(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "symbol_docs").select("sym_id", F.coalesce("sig", F.lit("")).alias("sig"), F.coalesce("doc", F.lit("")).alias("doc"))
    return t.distinct().select("sym_id", verbatim(F.col("sig"), F.col("doc")).alias("text"))


@query(
    "f8_reuse_vectors",
    "select k.row_id, v.vec_id from (select row_id, abs(fingerprint % 500) f from knowledge where fingerprint is not null) k join (select vec_id, min(vec_id) over (partition by label) f from embeddings) v on v.f = k.f and v.vec_id = v.f",
)
def f8(spark: SparkSession, d: str) -> DataFrame:
    """Knowledge rows with the vector of their fingerprint, here the first vector of each label."""
    names = table(spark, d, "knowledge").where("fingerprint is not null").select("row_id", F.abs(F.col("fingerprint") % 500).alias("fingerprint"))
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.expr("min(vec_id) over (partition by label)").alias("fingerprint"), "embedding")
    vectors = v.groupBy("fingerprint").agg(F.min("id").alias("id"))
    hit = fin.reuse_vectors(names, v)
    return hit.join(vectors, "fingerprint").select("row_id", F.col("id").alias("vec_id"))


@query(
    "f9_pending",
    "select row_id id, embed_key from knowledge k where row_id > 100 and doc_text <> '' and \"language\" not in ('xml', 'sql') and fingerprint is not null and not exists (select 1 from knowledge p where p.fingerprint = k.fingerprint and p.run_id = 101) order by row_id limit 1000",
)
def f9(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "knowledge").where("fingerprint is not null")
    rows = k.select(F.col("row_id").alias("id"), "embed_key", "language", F.col("doc_text").alias("doc"), "fingerprint")
    return fin.pending(rows, k.where("run_id = 101"), after=100).select("id", "embed_key")


@query(
    "f10_quantise",
    """select vec_id, round("scale", 9) "scale", list_transform(e, lambda x: greatest(-127, least(127, round(x / "scale")))::bigint) codes
from (select vec_id, e, case when m > 0 then m / 127.0::double else 1.0::double end "scale" from (select vec_id, embedding::double[] e, list_max(list_transform(embedding::double[], lambda x: abs(x))) m from embeddings))""",
)
def f10(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "embeddings").select("vec_id", fin.quantise(F.col("embedding")).alias("q"))
    return q.select("vec_id", F.round("q.scale", 9).alias("scale"), F.transform("q.codes", lambda c: c.cast("long")).alias("codes"))


# roll-up -------------------------------------------------------------------------------------

AGG = """
, up as (select id, id cur, 0 depth from g_symbols union all
  select u.id, s.enclosing_sym_id, depth + 1 from up u join g_symbols s on s.id = u.cur where s.enclosing_sym_id not in (0, s.id) and s.kind not in ('class', 'struct', 'trait', 'interface', 'enum', 'type_alias', 'document', 'attachment')),
chain as (select u.id, u.depth, s.id cur, s.kind in ('class', 'struct', 'trait', 'interface', 'enum', 'type_alias', 'document', 'attachment') leaf, s.kind in ('module', 'namespace', 'package') and not s.external md from up u join g_symbols s on s.id = u.cur),
agg as (select id, coalesce(min(cur) filter (leaf), arg_min(cur, depth) filter (md), id) agg_id from chain group by id),
kw(kind, kind_name, w) as (values (3, 'calls', 3), (4, 'type_use', 2), (5, 'field_access', 2), (6, 'implements', 2), (8, 'instantiates', 2), (10, 'imports', 1)),
ae as (select a.agg_id src_id, b.agg_id dst_id, kind_name kind, sum(w)::bigint weight from (select distinct src_id, target_id, kind_name, w from g_edges join kw using (kind)) e
  join agg a on a.id = e.src_id join agg b on b.id = e.target_id join g_symbols x on x.id = a.agg_id join g_symbols y on y.id = b.agg_id
  where a.agg_id <> b.agg_id and (kind_name <> 'imports' or (x.kind in ('module', 'namespace', 'package') and y.kind in ('module', 'namespace', 'package'))) group by all),
pf as (select sym_id, min(file_id) file_id from g_defs where file_id <> 0 group by sym_id),
an0 as (select s.id, s.kind, s.name, s."language", s.external, s.test, coalesce(len(list_intersect(string_split(lower(f.path), '/'), ['example', 'examples', 'sample', 'samples', 'demo', 'demos', 'fixtures'])) > 0, false) example,
  coalesce(p.name, split_part(f.path, '/', 1), '<unanchored>') anchor_name
  from g_symbols s left join g_packages p on p.id = s.pkg_id left join pf on pf.sym_id = s.id left join g_files f on f.id = pf.file_id where s.id in (select src_id from ae union select dst_id from ae)),
an as (select *, dense_rank() over (order by anchor_name) anchor_id from an0),
pr as (select least(src_id, dst_id) a, greatest(src_id, dst_id) b, sum(weight)::bigint weight from ae group by all),
dg as (select id, sum(weight)::bigint degree from (select a id, weight from pr union all select b, weight from pr) group by id),
fp as (select * from an where anchor_name <> '<unanchored>' and not external and "language" in ('rust', 'typescript', 'csharp', 'go', 'python', 'swift')),
mb as (select short_id id, community_id from g_communities)"""


ROLLED_FROM = ["region", "nation", "supplier", "customer", "part", "orders", "lineitem"]


class Rolled:
    """The rolled-up graph of the projection: published once for a state of the tables, read by all queries of it."""

    def __init__(self, spark: SparkSession, d: str):
        self._inputs = (spark, d)
        self.scratch = Scratch(spark, "rollup")
        self.mark = input_mark(spark, d, ROLLED_FROM)

    def _table(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return published(self._inputs[0], f"rollup-{name}", self.mark, build)

    @property
    def symbols(self) -> DataFrame:
        return self._table("symbols", lambda: graph(*self._inputs, "g_symbols"))

    @property
    def edges(self) -> DataFrame:
        def build() -> DataFrame:
            aggregates = ru.aggregate_ids(self.symbols, self.scratch)
            return ru.aggregate_edges(graph(*self._inputs, "g_edges"), aggregates, self.symbols)

        return self._table("edges", build)

    @property
    def nodes(self) -> DataFrame:
        others = (graph(*self._inputs, f"g_{t}") for t in ("packages", "defs", "files"))
        return self._table("nodes", lambda: ru.aggregate_nodes(self.edges, self.symbols, *others))

    @property
    def pairs(self) -> DataFrame:
        return self._table("pairs", lambda: an.collapse(self.edges))

    @property
    def degrees(self) -> DataFrame:
        return self._table("degrees", lambda: an.weighted_degree(self.pairs))

    @property
    def membership(self) -> DataFrame:
        return graph(*self._inputs, "g_communities").select(F.col("short_id").alias("id"), "community_id")


@add("a1_aggregate_ids", AGG + " select id, agg_id from agg")
def a1(spark: SparkSession, d: str) -> DataFrame:
    return ru.aggregate_ids(graph(spark, d, "g_symbols"), Scratch(spark, "a1"))


@add("a2_aggregate_edges", AGG + " select * from ae")
def a2(spark: SparkSession, d: str) -> DataFrame:
    return Rolled(spark, d).edges


@query("a3_edge_weights", "select * from (values ('calls', 3), ('type_use', 2), ('field_access', 2), ('implements', 2), ('extends_type', 2), ('instantiates', 2), ('embeds', 2), ('overrides', 1), ('imports', 1), ('links_to', 1)) t(kind, weight)")
def a3(spark: SparkSession, d: str) -> DataFrame:
    from symloom.model import ROLLUP_WEIGHTS

    return spark.createDataFrame(list(ROLLUP_WEIGHTS.items()), "kind string, weight int")


@query("a4_primary_files", "select sym_id, min(file_id) file_id from defs where file_id <> 0 group by sym_id")
def a4(spark: SparkSession, d: str) -> DataFrame:
    return ru.primary_files(table(spark, d, "defs"))


@query(
    "a5_covering_manifest",
    """with m as (select distinct regexp_extract(path, '^(([^/]+/)?[^/]+)/', 1) rel_dir from files where path like '%/%'), k as (select rel_dir, 'pkg:' || rel_dir anchor from m where length(rel_dir) % 2 = 0 union all select '', 'top')
select path, arg_max(anchor, length(rel_dir)) anchor from (select distinct path from files) f join k on rel_dir = '' or path like rel_dir || '/%' group by path""",
)
def a5(spark: SparkSession, d: str) -> DataFrame:
    """The deepest manifest directory over each path; here every second directory of one or two levels has one."""
    files = table(spark, d, "files").select("path")
    dirs = files.where("path like '%/%'").select(F.regexp_extract("path", "^(([^/]+/)?[^/]+)/", 1).alias("rel_dir")).distinct()
    m = dirs.where("length(rel_dir) % 2 = 0").select("rel_dir", F.concat(F.lit("pkg:"), "rel_dir").alias("anchor"))
    return ru.covering_manifest(files.where("path is not null"), m.union(spark.createDataFrame([("", "top")], "a string, b string")))


@query("a6_example_paths", "select id, len(list_intersect(string_split(lower(path), '/'), ['example', 'examples', 'sample', 'samples', 'demo', 'demos', 'fixtures', 'tests'])) > 0 and not 'tests' in string_split(lower(path), '/') example from files where path is not null")
def a6(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").where("path is not null").select("id", (ru.example_path(F.col("path")) & ~F.array_contains(F.split(F.lower("path"), "/"), "tests")).alias("example"))


@add("a7_aggregate_nodes", AGG + " select * from an")
def a7(spark: SparkSession, d: str) -> DataFrame:
    return Rolled(spark, d).nodes


@add("a8_edge_order", AGG + " select src_id, dst_id, kind, row_number() over (partition by src_id order by dst_id, kind) pos from ae")
def a8(spark: SparkSession, d: str) -> DataFrame:
    return Rolled(spark, d).edges.select("src_id", "dst_id", "kind", F.expr("row_number() over (partition by src_id order by dst_id, kind)").alias("pos"))


# graph analytics -----------------------------------------------------------------------------


@add("k1_collapse", AGG + " select * from pr")
def k1(spark: SparkSession, d: str) -> DataFrame:
    return Rolled(spark, d).pairs


@add("k2_weighted_degree", AGG + " select * from dg")
def k2(spark: SparkSession, d: str) -> DataFrame:
    return Rolled(spark, d).degrees


GODS = """, gn as (select case when external then 'external' when test then 'test' else 'live' end "filter", an.id short_id, coalesce(degree, 0) weighted_degree, name from an left join dg using (id)),
gods as (select * from (select *, row_number() over (partition by "filter" order by weighted_degree desc, short_id) - 1 "rank" from gn) where "rank" < 20)"""


@add("k3_god_nodes", AGG + GODS + ' select "filter", "rank", short_id, weighted_degree, name from gods')
def k3(spark: SparkSession, d: str) -> DataFrame:
    r = Rolled(spark, d)
    return an.god_nodes(r.nodes, r.degrees)


@add(
    "k4_clustering_view",
    AGG + """ select least(src_id, dst_id) a, greatest(src_id, dst_id) b, sum(weight * case when ae.kind in ('implements', 'overrides', 'extends_type') then 4 else 1 end)::bigint weight
from ae join an x on x.id = src_id join an y on y.id = dst_id where not x.external and not y.external group by all""",
)
def k4(spark: SparkSession, d: str) -> DataFrame:
    r = Rolled(spark, d)
    return an.clustering_pairs(r.nodes, r.edges)


@query("k5_communities")
def k5(spark: SparkSession, d: str) -> DataFrame:
    """Communities of the clustering view; the partition is checked by its invariants."""
    r = Rolled(spark, d)
    nodes = r.nodes.where("not external").select("id", F.lit("all").alias("part"))
    return an.dense_communities(an.communities(nodes, an.clustering_pairs(r.nodes, r.edges), r.scratch), r.scratch)


@query("k6_anchored_hierarchy")
def k6(spark: SparkSession, d: str) -> DataFrame:
    """Communities within anchors, split while large."""
    r = Rolled(spark, d)
    return an.hierarchy(r.nodes.where("not external"), an.clustering_pairs(r.nodes, r.edges), r.scratch)


@query("k8_hierarchy_records")
def k8(spark: SparkSession, d: str) -> DataFrame:
    """Size and real share of tests of every community of the hierarchy."""
    r = Rolled(spark, d)
    nodes = r.nodes.where("not external")
    tree = an.hierarchy(nodes, an.clustering_pairs(nodes, r.edges), r.scratch).join(nodes.select("id", "test"), "id")
    ratio = F.avg(F.col("test").cast("double"))
    return tree.groupBy("community", "parent", "depth").agg(F.count(F.lit(1)).alias("size"), F.round(ratio, 6).alias("test_ratio"), (ratio >= 0.6).alias("test_infra"))


@add(
    "k7_community_records",
    AGG + """, per as (select community_id, anchor_name, count(*) n, sum(coalesce(degree, 0)) w from mb join an using (id) left join dg using (id) group by all)
select community_id, sum(n)::bigint size, sum(w)::bigint total_weight, count(*) > 1 cross_anchor, max(struct_pack(n := n, a := anchor_name)).a primary_anchor_name from per group by community_id""",
)
def k7(spark: SparkSession, d: str) -> DataFrame:
    r = Rolled(spark, d)
    return an.community_records(r.nodes, r.degrees, r.membership)


@add("k9_membership", AGG + " select an.id short_id, coalesce(case when community_id % 3 > 0 then community_id end, 4294967295) flat_community_id, 4294967295 anchored_leaf_community_id from an left join mb using (id)")
def k9(spark: SparkSession, d: str) -> DataFrame:
    r = Rolled(spark, d)
    return an.membership_records(r.nodes, r.membership.where("community_id % 3 > 0"))


@add(
    "k10_graph_stats",
    AGG + GODS + """, by_l as (select "language", count(*) nodes from an group by 1),
g as (select "language", count(distinct short_id) n from gods join an on an.id = short_id group by 1),
cl as (select community_id, min(struct_pack(n := -n, l := "language")).l "language" from (select community_id, "language", count(*) n from mb join an using (id) group by all) group by 1),
al as (select anchor_name, min(struct_pack(n := -n, l := "language")).l "language" from (select anchor_name, "language", count(*) n from an group by all) group by 1)
select b."language", nodes, coalesce(g.n, 0) god_nodes, (select count(*) from cl where cl."language" = b."language") communities, (select count(*) from al where al."language" = b."language") anchors from by_l b left join g using ("language")""",
)
def k10(spark: SparkSession, d: str) -> DataFrame:
    r = Rolled(spark, d)
    nodes = r.nodes
    return an.graph_stats(nodes, an.god_nodes(nodes, r.degrees), r.membership)


# axes ----------------------------------------------------------------------------------------

PW = """, pw as (select x.anchor_name src_pkg, y.anchor_name dst_pkg, ae.kind, sum(weight)::bigint weight from ae join fp x on x.id = src_id join fp y on y.id = dst_id where x.anchor_name <> y.anchor_name group by all)"""


@add("x1_pair_weights", AGG + PW + " select * from pw")
def x1(spark: SparkSession, d: str) -> DataFrame:
    r = Rolled(spark, d)
    return ax.pair_weights(r.nodes, r.edges)


@add(
    "x2_couplings",
    AGG + PW + """, dr as (select src_pkg pkg, 'out' direction, dst_pkg other, kind, weight from pw union all select dst_pkg, 'in', src_pkg, kind, weight from pw),
per as (select pkg, direction, other, sum(weight)::bigint weight, string_agg(kind, ',' order by weight desc, kind) relations from dr group by all),
t as (select *, count(*) over w n_total, (sum(weight) over w)::bigint w_total, row_number() over (partition by pkg, direction order by weight desc, other) rn from per window w as (partition by pkg, direction))
select pkg, direction, other, weight, relations, n_total, w_total from t where rn <= case direction when 'out' then 8 else 24 end""",
)
def x2(spark: SparkSession, d: str) -> DataFrame:
    r = Rolled(spark, d)
    return ax.couplings(ax.pair_weights(r.nodes, r.edges))


@add(
    "x2b_list_packages",
    AGG + PW + """, b as (select anchor_name pkg, count(*) n_symbols, sum(test::int) tests from fp group by 1),
l as (select anchor_name pkg, min(struct_pack(n := -n, l := "language")).l "language" from (select anchor_name, "language", count(*) n from fp group by all) group by 1),
o as (select src_pkg pkg, count(distinct dst_pkg) uses, sum(weight) w_out from pw group by 1), i as (select dst_pkg pkg, count(distinct src_pkg) used_by, sum(weight) w_in from pw group by 1)
select pkg, n_symbols, "language", coalesce(used_by, 0) used_by, coalesce(uses, 0) uses, case when 2 * tests > n_symbols then 'tests' when coalesce(w_in, 0) + coalesce(w_out, 0) = 0 then 'isolated'
 when coalesce(w_out, 0) / (coalesce(w_in, 0) + coalesce(w_out, 0)) <= 0.25 then 'provider' when coalesce(w_out, 0) / (coalesce(w_in, 0) + coalesce(w_out, 0)) >= 0.75 then 'consumer' else 'layer' end "role"
from b join l using (pkg) left join o using (pkg) left join i using (pkg)""",
)
def x2b(spark: SparkSession, d: str) -> DataFrame:
    r = Rolled(spark, d)
    return ax.packages(r.nodes, r.edges)


@add(
    "x2c_central_symbols",
    AGG + """, t as (select anchor_name, 2 * sum(test::int) > count(*) tests from fp group by 1),
c as (select anchor_name pkg, fp.id, name, degree, row_number() over (partition by anchor_name order by degree desc, name, fp.id) "rank" from fp join t using (anchor_name) join dg using (id) where kind not in ('package', 'module', 'namespace') and (not test or tests))
select pkg, "rank", id, name, degree from c where "rank" <= 8""",
)
def x2c(spark: SparkSession, d: str) -> DataFrame:
    r = Rolled(spark, d)
    return ax.central_symbols(r.nodes, r.pairs)


PATHS = """with p as (select distinct split_part(path, '/', 1) pkg, path from files where path like '%/%'),
s as (select pkg, string_split(regexp_replace(path, '/?[^/]*$', ''), '/') dirs from p),
n as (select pkg, count(*) total from s group by 1),
pre as (select pkg, k, list_slice(dirs, 1, k) pre, count(*) c from s, generate_series(1, 12) g(k) where len(dirs) >= k group by all),
rt as (select pkg, arg_max(array_to_string(pre, '/'), k) prefix from pre join n using (pkg) where c = total group by 1),
root as (select pkg, regexp_replace(prefix, '(^|/)(src|source|sources|lib)$', '') root from rt)"""


def _paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "files").where("path like '%/%'").select(F.split("path", "/")[0].alias("pkg"), "path").distinct()


@query("x2e_package_roots", PATHS + " select pkg, root from root")
def x2e(spark: SparkSession, d: str) -> DataFrame:
    return ax.package_roots(_paths(spark, d))


@query(
    "x2d_namespace_prefix",
    """with s as (select "language" l, string_split(regexp_extract(pub_id, '^[a-z]+:(.*)$', 1), '/') p from symbols where pub_id is not null), n as (select l, count(*) total from s group by 1),
pre as (select l, k, list_slice(p, 1, k) pre, count(*) c from s, generate_series(1, 12) g(k) where len(p) >= k group by all), ok as (select l, array_to_string(pre, '/') v, k from pre join n using (l) where c = total)
select n.l "language", coalesce(arg_max(v, k), '') prefix from n left join ok using (l) group by 1""",
)
def x2d(spark: SparkSession, d: str) -> DataFrame:
    """The common leading namespace of each language's public ids."""
    rows = table(spark, d, "symbols").where("pub_id is not null").select("language", F.regexp_extract("pub_id", "^[a-z]+:(.*)$", 1).alias("ns"))
    return ax.common_prefix(rows, "language", "ns", "/")


@query("x8_directory_histogram", PATHS + """ select pkg, case when contains(rel, '/') then split_part(rel, '/', 1) else '(root)' end dir, count(*) n
from (select p.pkg, case when root = '' then path else substring(path, length(root) + 2) end rel from p join root using (pkg)) group by all""")
def x8(spark: SparkSession, d: str) -> DataFrame:
    return ax.directory_histogram(_paths(spark, d))


@query("x7_components", """with p as (select distinct path, 'all' pkg from files where path like '%/%') select split_part(path, '/', 1) dir, count(*) n from p group by 1 having count(*) >= 5""")
def x7(spark: SparkSession, d: str) -> DataFrame:
    """Sub-areas of the one package that all files form together."""
    return ax.components(_paths(spark, d).select(F.lit("all").alias("pkg"), "path"))


DOMAINS = """
, el as (select fp.id, fp.name, anchor_name pkg, community_id from fp join mb using (id) where not test and not example and name <> '' and kind not in ('package', 'module', 'namespace')),
m as (select *, count(*) over (partition by community_id) raw from el),
mm as (select * from m where raw >= 4),
inn as (select ae.src_id, ae.dst_id, x.community_id c, x.pkg p, y.pkg q, weight from ae join mm x on x.id = src_id join mm y on y.id = dst_id where x.community_id = y.community_id),
lk as (select c, least(p, q) p, greatest(p, q) q, count(*) n from (select distinct src_id, dst_id, c, p, q from inn where p <> q) group by all),
cd as (select community_id c, pkg from mm group by all having count(*) >= 2),
ok as (select * from lk where (c, p) in (select c, pkg from cd) and (c, q) in (select c, pkg from cd)),
sp as (select c, sum(n)::bigint n_links from ok group by c having sum(n) >= 2),
kp as (select distinct c, pkg from (select c, p pkg from ok union all select c, q from ok) where c in (select c from sp)),
dgi as (select id, sum(weight) deg from (select src_id id, weight from inn union all select dst_id, weight from inn) group by id),
dom as (select mm.*, n_links, coalesce(deg, 0) deg from mm join kp on kp.c = mm.community_id and kp.pkg = mm.pkg join sp on sp.c = mm.community_id left join dgi on dgi.id = mm.id)
select community_id, count(*) size, max(n_links) n_links, count(distinct pkg) n_packages, min(struct_pack(d := -deg, n := name, i := id)).n hub from dom group by community_id"""


@add("x3_domains", AGG + DOMAINS)
def x3(spark: SparkSession, d: str) -> DataFrame:
    r = Rolled(spark, d)
    return ax.domains(r.nodes, r.edges, r.membership, r.scratch).drop("hub_id")


DOMAIN_LIST = AGG + DOMAINS[: DOMAINS.rindex("select community_id")] + """, dl as (select community_id, count(*) size, max(n_links) links, count(distinct pkg) packages_count, min(struct_pack(d := -deg, n := name, i := id)).i hub_id from dom group by community_id)
select s.pub_id symbol, s.name title, size, packages_count, links from dl join g_symbols s on s.id = hub_id"""


@add("x3b_list_domains", DOMAIN_LIST)
def x3b(spark: SparkSession, d: str) -> DataFrame:
    r = Rolled(spark, d)
    return ax.list_domains(ax.domains(r.nodes, r.edges, r.membership, r.scratch), r.symbols)


@add("x3b_one_domain", DOMAIN_LIST + " where s.name = (select min(name) from dl join g_symbols t on t.id = hub_id)")
def x3b_one(spark: SparkSession, d: str) -> DataFrame:
    """The domain of one title, here the first one."""
    r = Rolled(spark, d)
    found = r.scratch.save(ax.domains(r.nodes, r.edges, r.membership, r.scratch))
    first = ax.list_domains(found, r.symbols).agg(F.min("title")).collect()[0][0]  # one title
    return ax.list_domains(found, r.symbols, first or "")


@query(
    "x2e_root_documents",
    PATHS + """, rl as (select pkg, root, 'rust' l from root where length(pkg) % 2 = 0 union all select pkg, root, 'python' from root where length(pkg) % 2 = 1),
dc as (select file_id, min(doc) doc from file_docs where doc <> '' group by 1),
c as (select rl.pkg, f.path, dc.doc, list_position(case l when 'rust' then ['lib.rs', 'main.rs', 'mod.rs', 'chunk.rs', 'span.rs'] else ['__init__.py', 'chunk.py', 'span.py'] end, regexp_extract(f.path, '[^/]*$')) o, len(string_split(f.path, '/')) n
 from (select distinct id, path from files where path is not null) f join dc on dc.file_id = f.id join rl on root = '' or starts_with(f.path, root || '/'))
select pkg, arg_min(path, struct_pack(o := o, n := n, p := path)) path, arg_min(doc, struct_pack(o := o, n := n, p := path)) doc from c where o > 0 group by pkg""",
)
def x2e_docs(spark: SparkSession, d: str) -> DataFrame:
    """Root documents of top directories; here every second one counts as Rust, the others as Python."""
    roots = ax.package_roots(_paths(spark, d)).withColumn("language", F.when(F.length("pkg") % 2 == 0, "rust").otherwise("python"))
    names = {"rust": ["lib.rs", "main.rs", "mod.rs", "chunk.rs", "span.rs"], "python": ["__init__.py", "chunk.py", "span.py"]}
    files = table(spark, d, "files").where("path is not null").select("id", "path").distinct()
    return ax.root_documents(roots, files, table(spark, d, "file_docs"), names)


@add(
    "x2d_root_symbols",
    AGG + """, l as (select anchor_name pkg, min(struct_pack(n := -n, l := "language")).l lang from (select anchor_name, "language", count(*) n from fp group by all) group by 1),
c as (select pkg, case lang when 'rust' then 'rs:' || pkg || '::crate' when 'csharp' then 'cs:' || pkg when 'typescript' then 'ts:' || pkg when 'go' then 'go:' || pkg when 'python' then 'py:' || pkg end pub_id from l),
st as (select case "language" when 'rust' then 'rs:' || replace(name, 'nation', 'pkg') || '::crate' when 'csharp' then 'cs:' || replace(name, 'nation', 'pkg') else 'ts:' || replace(name, 'nation', 'pkg') end pub_id, id from g_symbols where kind = 'module')
select pkg, min(id) root_id, pub_id from c join st using (pub_id) group by all""",
)
def x2d_roots(spark: SparkSession, d: str) -> DataFrame:
    """Packages with the symbol that stands for them; modules play those symbols."""
    r = Rolled(spark, d)
    at = F.regexp_replace("name", "nation", "pkg")
    pub = F.when(F.col("language") == "rust", F.concat(F.lit("rs:"), at, F.lit("::crate"))).when(F.col("language") == "csharp", F.concat(F.lit("cs:"), at)).otherwise(F.concat(F.lit("ts:"), at))
    return ax.root_symbols(r.nodes, r.symbols.where("kind = 'module'").select("id", pub.alias("pub_id")))


@add("k11_earned_domains", AGG + DOMAINS[: DOMAINS.rindex("select community_id")] + "select count(distinct community_id) domains from dom")
def k11(spark: SparkSession, d: str) -> DataFrame:
    return x3(spark, d).agg(F.count(F.lit(1)).alias("domains"))


@add(
    "x4_contracts",
    AGG + """ select y.id, y.name, count(distinct x.anchor_name) span, count(distinct x.id) implementers from ae join fp x on x.id = src_id join fp y on y.id = dst_id
where ae.kind in ('implements', 'extends_type') and x.name <> '' and y.name <> '' and not x.test and not y.test group by y.id, y.name having count(distinct x.anchor_name) >= 2""",
)
def x4(spark: SparkSession, d: str) -> DataFrame:
    r = Rolled(spark, d)
    return ax.contracts(r.nodes, r.edges)


@add(
    "x5_tables",
    """, tb as (select n_nationkey id, n_name name from nation),
rf as (select s_nationkey table_id, d.file_id, y."language", case when l_linenumber = 1 and l_quantity > 49 then 18 else 20 end kind from lineitem join supplier on s_suppkey = l_suppkey and s_nationkey % 5 <> 4 join g_defs d on d.sym_id = l_orderkey + 10000000 join g_symbols y on y.id = d.sym_id)
select name, coalesce(max((kind = 18)::int), 0) = 1 internal, count(distinct file_id) file_span, count(distinct "language") language_span, count(file_id) total_refs from tb left join rf on table_id = id group by id, name""",
)
def x5(spark: SparkSession, d: str) -> DataFrame:
    """Nations stand for tables; line items read them and some define them."""
    tb = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    li = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_orderkey") + 10_000_000).alias("sym_id"), F.when((F.col("l_linenumber") == 1) & (F.col("l_quantity") > 49), 18).otherwise(20).alias("kind"))
    su = table(spark, d, "supplier").where("s_nationkey % 5 <> 4").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("table_id"))
    refs = li.join(su, "l_suppkey").join(graph(spark, d, "g_defs").select("sym_id", "file_id"), "sym_id").join(graph(spark, d, "g_symbols").select(F.col("id").alias("sym_id"), "language"), "sym_id")
    return ax.tables(tb, refs)


@add("x6_documents", """select split_part(path, '/', 1) dir, count(*) n_files from g_files where not external and path like '%/%' group by 1 having max(("language" in ('rust', 'typescript', 'csharp', 'go', 'python', 'swift'))::int) = 0""")
def x6(spark: SparkSession, d: str) -> DataFrame:
    return ax.documents(graph(spark, d, "g_files"))


@add("z1_supernodes", AGG + " select anchor_name, count(*) n_nodes, sum(coalesce(degree, 0))::bigint degree from an left join dg using (id) group by 1")
def z1(spark: SparkSession, d: str) -> DataFrame:
    r = Rolled(spark, d)
    return ax.supernodes(r.nodes, r.degrees)


@add("z2_bundles", AGG + " select least(x.anchor_name, y.anchor_name) a, greatest(x.anchor_name, y.anchor_name) b, sum(weight)::bigint weight, count(*) n from pr join an x on x.id = a join an y on y.id = b where x.anchor_name <> y.anchor_name group by all")
def z2(spark: SparkSession, d: str) -> DataFrame:
    r = Rolled(spark, d)
    return ax.bundles(r.nodes, r.pairs)


@add("i20_split_identifier", f"select distinct name, {SPLIT_SQL.format(c='name')} words from g_symbols")
def i20(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d, "g_symbols").select("name").distinct().select("name", split_identifier(F.col("name")).alias("words"))
