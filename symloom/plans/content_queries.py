"""Queries of the content producers. Style sheets, markup and statements are composed from the tables' rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symloom.functions import parsers as ps
from symloom.functions.identifiers import slug
from symloom.operators import content as co
from symloom.plans import query
from symloom.plans.projection import CTES, graph
from symloom.runtime import Scratch, table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("key"), "text")


COMPOSED = "(select c_custkey \"key\", 12 + c_custkey % 40 n from customer)"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").selectExpr("c_custkey key", "repeat('abcdefghi\n', cast(12 + c_custkey % 40 as int)) text")


@query(
    "content_p01_text_chunks",
    f"""select "key", k::int ordinal, repeat('abcdefghi' || chr(10), least(10, n - 8 * k)::int) chunk, (8 * k + 1)::int first_line, least(8 * k + 10, n)::int last_line
from {COMPOSED}, generate_series(0, 10) g(k) where k = 0 or 8 * (k - 1) + 10 < n""",
)
def p01(spark: SparkSession, d: str) -> DataFrame:
    """Texts of lines of ten bytes: chunks of ten lines, two of them again in the next one."""
    return co.chunks(_lines(spark, d), 100, 20)


@query("content_p01_documents")
def p01_documents(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all documents; a test compares them with a plain reading of the rule."""
    return co.chunks(_docs(spark, d))


@query(
    "content_p02_text_graph",
    f"""with c as (select "key"::varchar k, 't' || "key" || '#' || k node from {COMPOSED}, generate_series(0, 10) g(k) where k = 0 or 8 * (k - 1) + 10 < n)
select k src, node dst, 'contains' kind from c union all select node, k, 'defined_in' from c""",
)
def p02(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "customer").selectExpr("c_custkey key", "concat('a/b/t', c_custkey, '.txt') path")
    return co.text_graph(co.chunks(_lines(spark, d), 100, 20), docs)


@query("content_p03_slugs", "select distinct name, regexp_replace(regexp_replace(lower(trim(name)), '[^\\p{L}\\p{N}\\s_-]', '', 'g'), '\\s', '-', 'g') slug from (select replace(p_name, ' ', case p_size % 3 when 0 then ' & ' when 1 then '. ' else '_' end) name from part)")
def p03(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "part").selectExpr("replace(p_name, ' ', case p_size % 3 when 0 then ' & ' when 1 then '. ' else '_' end) name").distinct()
    return n.select("name", slug(F.col("name")).alias("slug"))


@query(
    "content_p03_front_matter",
    """select "key", field, entry from (select c_custkey "key", unnest([struct_pack(field := 'title', entry := 'T ' || c_custkey), struct_pack(field := 'aliases', entry := 'A' || c_custkey), struct_pack(field := 'aliases', entry := 'b c'),
struct_pack(field := 'related', entry := 'R' || c_custkey), struct_pack(field := 'related', entry := 'x')], recursive := true) from customer where c_custkey % 3 <> 0)""",
)
def p03b(spark: SparkSession, d: str) -> DataFrame:
    """Two of three texts have a front matter; a rule further down is none."""
    t = table(spark, d, "customer").selectExpr(
        "c_custkey key",
        "concat(if(c_custkey % 3 = 0, 'Text.\\n', ''), '---\\ntitle: T ', c_custkey, '\\naliases: [A', c_custkey, ', \"b c\"]\\nother: [q]\\nrelated:\\n  - R', c_custkey, '\\n  - x\\n---\\nbody: no') text",
    )
    return ps.flat_map(t, ps.front_matter, "key long, field string, entry string")


SECTION = "key long, ordinal int, level int, title string, slug string, first_line int, last_line int, parent int"


@query(
    "content_p04_sections",
    """select c_custkey "key", x.o ordinal, x.l "level", x.t title, x.s slug, x.a first_line, x.b last_line, x.p parent from customer, lateral (select unnest([
struct_pack(o := 0, l := 1, t := 'Top ' || c_custkey, s := 'top-' || c_custkey, a := 1, b := 13, p := -1), struct_pack(o := 1, l := 2, t := 'Part', s := 'part', a := 5, b := 10, p := 0),
struct_pack(o := 2, l := 2, t := 'Part', s := 'part-1', a := 11, b := 13, p := 0)]) x)""",
)
def p04(spark: SparkSession, d: str) -> DataFrame:
    """A heading, two of one name below it and one in a fence, which is none."""
    t = table(spark, d, "customer").selectExpr("c_custkey key", "concat('# Top ', c_custkey, '\\n\\nText.\\n\\n## Part\\n\\n```\\n# no\\n```\\n\\n## Part\\n\\nx') text")
    return ps.flat_map(t, ps.sections, SECTION)


@query("content_p04_documents")
def p04_documents(spark: SparkSession, d: str) -> DataFrame:
    return ps.flat_map(_docs(spark, d), ps.sections, SECTION)


LINK = "key long, line int, kind string, target string, anchor string, label string"


@query(
    "content_p05_links",
    """select c_custkey "key", x.l line, x.k kind, x.t target, x.a anchor, x.b "label" from customer, lateral (select unnest([
struct_pack(l := 1, k := 'link', t := 'a/b' || c_custkey || '.md', a := 'top', b := 'one'), struct_pack(l := 1, k := 'wiki', t := 'Page ' || c_custkey, a := '', b := 'shown'),
struct_pack(l := 2, k := 'image', t := 'img/x' || c_custkey || '.png', a := '', b := 'pic'), struct_pack(l := 2, k := 'embed', t := 'Note ' || c_custkey, a := 'sec', b := '')]) x)""",
)
def p05(spark: SparkSession, d: str) -> DataFrame:
    """An inline link, a wiki link, an image and an embedding; code holds no links."""
    t = table(spark, d, "customer").selectExpr("c_custkey key", "concat('See [one](a/b', c_custkey, '.md#top) and [[Page ', c_custkey, '|shown]].\\n![pic](img/x', c_custkey, '.png) ![[Note ', c_custkey, '#sec]] `[no](x)`') text")
    return ps.flat_map(t, ps.links, LINK)


@query("content_p05_documents")
def p05_documents(spark: SparkSession, d: str) -> DataFrame:
    both = _docs(spark, d).unionByName(table(spark, d, "file_docs").where("doc is not null").select(F.col("file_id").alias("key"), F.col("doc").alias("text")))
    return ps.flat_map(both, ps.links, LINK)


LINKED = """with pg as (select doc_id id, path, row_number() over (order by doc_id) rn from documents where path is not null),
fo as (select a.id "key", a.path, 1 line, case a.rn % 2 when 0 then 'wiki' else 'link' end kind, case when a.rn % 10 < 5 then b.path when a.rn % 10 < 8 then 'nowhere/' || a.rn || '.md' else regexp_extract(b.path, '([^/]*)\\.md$', 1) end target, case a.rn % 3 when 0 then 'top' else '' end anchor
 from pg a join pg b on b.rn = 1 + a.rn * 7 % 101),
sw as (select id, lower(path) p, lower(regexp_extract(path, '([^/]*?)(\\.[^.]*)?$', 1)) s from pg)"""


@query(
    "content_p06_resolve_links",
    LINKED + """, t as (select fo.*, sw.id dst, 0 tier from fo join sw on sw.p = lower(target) or (kind = 'wiki' and sw.p = lower(target) || '.md')
 union all select fo.*, sw.id, 1 from fo join sw on sw.s = regexp_replace(lower(target), '\\.md$', '') where kind = 'wiki'
 union all select fo.*, sw.id, 5 from fo join sw on sw.s = lower(regexp_extract(target, '([^/]*?)(\\.[^.]*)?$', 1)) where kind = 'link' and not exists (select 1 from sw x where x.p = lower(target)) and not contains(target, '/')),
b as (select *, min(tier) over (partition by "key", target) best from (select distinct * from t)), c as (select *, count(*) over (partition by "key", target) k from b where tier = best)
select fo."key", fo.line, fo.kind, fo.target, fo.anchor, c.dst, case when c.dst is null then 'dangling' when k > 1 then 'ambiguous' when tier = 5 or (fo.anchor <> '' and c.dst % 2 = 1) then 'drifted' else 'exact' end grade
from fo left join c on c."key" = fo."key" and c.target = fo.target""",
)
def p06(spark: SparkSession, d: str) -> DataFrame:
    """Each document links to another one: by path, by bare stem or to nothing; even documents have the anchor "top"."""
    pg = table(spark, d, "documents").where("path is not null").selectExpr("doc_id id", "path", "row_number() over (order by doc_id) rn")  # ranked for the fixture only
    b = pg.selectExpr("path bpath", "rn brn")
    fo = pg.join(b, F.expr("brn = 1 + rn * 7 % 101")).selectExpr(
        "id key", "path", "1 line", "case rn % 2 when 0 then 'wiki' else 'link' end kind",
        "case when rn % 10 < 5 then bpath when rn % 10 < 8 then concat('nowhere/', rn, '.md') else regexp_extract(bpath, '([^/]*)\\\\.md$', 1) end target", "case rn % 3 when 0 then 'top' else '' end anchor",
    )
    names = spark.createDataFrame([], "id long, name string, what string")
    anchors = pg.where("id % 2 = 0").select("id", F.lit("top").alias("slug"))
    return co.resolve_links(fo, pg.select("id", "path"), names, anchors)


@query(
    "content_p07_resolve_code",
    CTES + """, rf as (select distinct id "key", case id % 3 when 0 then name when 1 then 'nation_' || (pkg_id - 1) || '.' || name else name || '_gone' end ref from g_symbols where kind = 'function' union select id, path from g_files union select id, split_part(path, '/', -1) from g_files where id % 5 = 0),
sp as (select *, contains(ref, '/') or regexp_matches(ref, '\\.[a-z]{1,4}$') pl, regexp_split_to_array(ref, '::|\\.|#') parts from rf),
h as (select "key", ref, 'file' what, f.id dst, case when f.path = ref then 0 when ends_with(f.path, '/' || ref) then 1 else 2 end tier from sp join g_files f on split_part(f.path, '/', -1) = split_part(ref, '/', -1) where pl
 union all select "key", ref, 'symbol', s.id, case when len(parts) > 1 and contains(lower(s.pub_id), lower(parts[-2])) then 0 else 1 end from sp join g_symbols s on s.name_lower = lower(parts[-1]) where not pl),
b as (select *, min(tier) over (partition by "key", ref) best from h), c as (select "key", ref, what, dst, tier, count(*) over (partition by "key", ref) k from (select distinct "key", ref, what, dst, tier from b where tier = best))
select "key", ref, what, dst, case when k > 1 then 'ambiguous' when tier = 0 then 'exact' else 'drifted' end grade from c""",
)
def p07(spark: SparkSession, d: str) -> DataFrame:
    s, f = graph(spark, d, "g_symbols"), graph(spark, d, "g_files")
    rf = s.where("kind = 'function'").selectExpr("id key", "case id % 3 when 0 then name when 1 then concat('nation_', pkg_id - 1, '.', name) else concat(name, '_gone') end ref")
    rf = rf.union(f.select("id", "path")).union(f.where("id % 5 = 0").selectExpr("id", "element_at(split(path, '/'), -1)")).distinct()
    return co.resolve_code(rf, f, s)


# style sheets: one sheet a nation, its parts are classes --------------------------------------

_CLS = "concat('c-', p_brand)"


def _sheets(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    rule = "concat('/* part */\\n.k', p_partkey % 40, ' > #i', p_partkey % 7, ' { --gap-', p_size, ': 1px; @extend .k', (p_partkey + 1) % 40, '; }\\n.k', p_partkey % 40, ' { @extend .k', (p_partkey + 2) % 40, '; }')"
    return p.groupBy((F.col("p_partkey") % 25).alias("key")).agg(F.array_join(F.array_sort(F.collect_list(F.expr(rule))), "\n").alias("text"))  # a small fixture: one sheet a nation


@query(
    "content_p08_css_atoms",
    """select p_partkey % 25 "key", 'class' kind, 'k' || (p_partkey % 40) "name" from part group by all union select p_partkey % 25, 'id', 'i' || (p_partkey % 7) from part union select p_partkey % 25, 'property', '--gap-' || p_size from part""",
)
def p08(spark: SparkSession, d: str) -> DataFrame:
    return ps.flat_map(_sheets(spark, d), ps.css_atoms, "key long, kind string, name string, line int").select("key", "kind", "name")


@query("content_p09_css_extends", "select distinct p_partkey % 25 \"key\", 'k' || (p_partkey % 40) src, 'extend' verb, 'k' || ((p_partkey + 2) % 40) dst from part")
def p09(spark: SparkSession, d: str) -> DataFrame:
    return ps.flat_map(_sheets(spark, d), ps.css_extends, "key long, src string, verb string, dst string").distinct()


@query("content_p10_css_imports", "select n_nationkey \"key\", 'import' verb, 's' || n_regionkey || '.css' target from nation")
def p10(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "nation").selectExpr("cast(n_nationkey as bigint) key", "concat('@import \"s', n_regionkey, '.css\";\\n@import url(\"https://x.example/a.css\"); // @import \"b\"') text")
    return ps.flat_map(t, ps.css_imports, "key long, verb string, target string")


@query(
    "content_p10_import_targets",
    """select n_nationkey "key", '../base/s' || n_regionkey target, case when n_regionkey % 2 = 0 then 'css/base/s' || n_regionkey || '.scss' else 'css/base/_s' || n_regionkey || '.scss' end path, (10 + n_regionkey)::bigint dst from nation where n_regionkey < 4
union all select n_nationkey, './reset.css', 'css/n/reset.css', 1 from nation""",
)
def p10_targets(spark: SparkSession, d: str) -> DataFrame:
    """Each sheet imports one of its region, found as it stands or as a partial, a plain one beside it and one that is not there."""
    t = table(spark, d, "nation").selectExpr("cast(n_nationkey as bigint) key", "concat('@use \"../base/s', n_regionkey, '\";\\n@import \\'./reset.css\\';\\n@forward \"gone\";') text")
    found = ps.flat_map(t, ps.css_imports, "key long, verb string, target string").withColumn("path", F.concat(F.lit("css/n/n"), "key", F.lit(".scss")))
    sheets = spark.range(4).selectExpr("10 + id id", "concat('css/base/', if(id % 2 = 0, '', '_'), 's', id, '.scss') path").union(spark.createDataFrame([(1, "css/n/reset.css")], "id long, path string"))
    return co.css_import_targets(found, sheets)


@query("content_p11_class_usage", """with t as (select c_custkey "key", 'k' || (c_custkey % 60) name, c_custkey % 2 = 0 marked from customer), cl as (select i id, 'k' || (i % 40) name from range(45) r(i))
select "key", t.name, cl.id dst, case when (select count(*) from cl x where x.name = t.name) > 1 then 'ambiguous' when marked then 'exact' else 'fuzzy' end grade from t join cl using (name)""")
def p11(spark: SparkSession, d: str) -> DataFrame:
    code = table(spark, d, "customer").selectExpr("c_custkey key", "concat(case c_custkey % 2 when 0 then '<div className=' else 'let name = ' end, '\"k', c_custkey % 60, '\"') text")
    tokens = ps.flat_map(code, ps.string_tokens, "key long, line int, token string, marked boolean")
    classes = spark.range(45).selectExpr("id", "concat('k', id % 40) name")
    return co.mine_usage(tokens, classes)[0]


@query("content_p12_module_members", """select c_custkey "key", 's' binding, 'btn' || (c_custkey % 9) || 'Wide' member, unnest(['btn' || (c_custkey % 9) || 'Wide', 'btn' || (c_custkey % 9) || '-wide']) spelling from customer""")
def p12(spark: SparkSession, d: str) -> DataFrame:
    code = table(spark, d, "customer").selectExpr("c_custkey key", "concat('import s from \"./a.css\";\\nuse(s.btn', c_custkey % 9, 'Wide)') text")
    m = ps.flat_map(code, ps.module_members, "key long, binding string, member string, target string")
    kebab = F.lower(F.regexp_replace("member", "(?<=[a-z0-9])([A-Z])", "-$1"))
    return m.select("key", "binding", "member", F.explode(F.array_distinct(F.array(F.col("member"), kebab))).alias("spelling"))


# markup: one page a customer -----------------------------------------------------------------


def _pages(spark: SparkSession, d: str) -> DataFrame:
    html = "concat('<html><body id=b', c_custkey, '><div><p class=\"k1 k', c_custkey % 50, '\">x<br><a href=\"r', c_nationkey, '.html#s', c_custkey % 3, '\">y</a><a href=https://e.example/>z</a><img src=\"i', c_custkey % 5, '.png\"></div><ul id=\"i', c_custkey % 12, '\"><li class=k2>q')"
    return table(spark, d, "customer").selectExpr("c_custkey key", f"{html} text")


ELEMENTS = "key long, ordinal int, parent int, tag string, line int, id string, class string, link string, style string"


def _elements(spark: SparkSession, d: str) -> DataFrame:
    return ps.flat_map(_pages(spark, d), ps.html_elements, ELEMENTS)


@query("content_p14_html_elements", "select c_custkey \"key\", unnest(['html', 'body', 'div', 'p', 'br', 'a', 'a', 'img', 'ul', 'li']) tag, unnest([-1, 0, 1, 2, 3, 3, 3, 3, 1, 8]) parent, unnest(range(10))::int ordinal from customer")
def p14(spark: SparkSession, d: str) -> DataFrame:
    return _elements(spark, d).select("key", "tag", "parent", "ordinal")


@query(
    "content_p15_id_correspondence",
    """with j as (select c_custkey "key", 'i' || (c_custkey % 12) name, n sheet from customer join (select distinct p_partkey % 25 n, 'i' || (p_partkey % 7) i from part) on i = 'i' || (c_custkey % 12))
select "key" src, sheet dst, name, 'html_css' direction from j union all select sheet, "key", name, 'css_html' from j""",
)
def p15(spark: SparkSession, d: str) -> DataFrame:
    ids = ps.flat_map(_sheets(spark, d), ps.css_atoms, "key long, kind string, name string, line int").where("kind = 'id'").select(F.col("key").alias("sheet"), "name")
    return co.id_correspondence(_elements(spark, d), ids)


@query(
    "content_p16_page_links",
    """select c_custkey "key", 'r' || c_nationkey || '.html' target, 's' || (c_custkey % 3) anchor, case when c_nationkey % 5 <> 0 then c_nationkey end dst, 'page' what, case when c_nationkey % 5 = 0 then 'dangling' when c_custkey % 3 = 0 then 'drifted' else 'exact' end grade from customer
union all select c_custkey, 'i' || (c_custkey % 5) || '.png', '', case when c_custkey % 5 < 4 then 100 + c_custkey % 5 end, 'media', case when c_custkey % 5 < 4 then 'exact' else 'dangling' end from customer""",
)
def p16(spark: SparkSession, d: str) -> DataFrame:
    """Local links of pages: pages of every fifth nation are absent, so is one image; anchors s1 and s2 exist."""
    pages = table(spark, d, "nation").where("n_nationkey % 5 <> 0").selectExpr("cast(n_nationkey as long) id", "concat('site/r', n_nationkey, '.html') path")
    files = pages.union(spark.range(4).selectExpr("100 + id", "concat('site/i', id, '.png')"))
    anchors = pages.select("id", F.explode(F.array(F.lit("s1"), F.lit("s2"))).alias("anchor"))
    return co.page_links(_elements(spark, d).withColumn("path", F.concat(F.lit("site/c"), "key", F.lit(".html"))), files, anchors)


@query(
    "content_p17_html_classes",
    """with u as (select distinct c_custkey "key", "owner", name from (select c_custkey, 1 "owner", unnest(['k1', 'k' || (c_custkey % 50)]) name from customer union all select c_custkey, 8, 'k2' from customer)), cl as (select i id, 'k' || (i % 40) name from range(45) r(i))
select "key", "owner", u.name, cl.id dst, case when cl.id is null then 'dangling' when (select count(*) from cl x where x.name = u.name) > 1 then 'ambiguous' else 'exact' end grade from u left join cl using (name)""",
)
def p17(spark: SparkSession, d: str) -> DataFrame:
    return co.html_class_usage(_elements(spark, d), spark.range(45).selectExpr("id", "concat('k', id % 40) name"))


# statements: three an order ------------------------------------------------------------------


def _sql(spark: SparkSession, d: str) -> DataFrame:
    s = "concat('WITH c AS (SELECT 1) SELECT * FROM c JOIN t', o_orderkey % 30, ' x ON 1=1 WHERE y = ''from z''; CREATE TABLE IF NOT EXISTS s', o_custkey % 4, '.t', o_custkey % 45, ' (a int); DROP INDEX i; -- from nobody\\nDELETE FROM \"S1\".t', o_orderkey % 9, '; SELECT * FROM gen(1), {name}')"
    return table(spark, d, "orders").selectExpr("o_orderkey key", f"{s} text")


SQL_ROWS = """sr as (select o_orderkey "key", 0 ordinal, 'accesses' "role", '' "schema", 't' || (o_orderkey % 30) tbl from orders union all select o_orderkey, 1, 'defines', 's' || (o_custkey % 4), 't' || (o_custkey % 45) from orders union all select o_orderkey, 3, 'accesses', 's1', 't' || (o_orderkey % 9) from orders)"""


def _statements(spark: SparkSession, d: str) -> DataFrame:
    return ps.flat_map(_sql(spark, d).where(co.looks_like_sql(F.col("text"))), ps.sql_tables, "key long, ordinal int, role string, schema string, tbl string")


@query("content_p18_sql_tables", "with " + SQL_ROWS + " select * from sr")
def p18(spark: SparkSession, d: str) -> DataFrame:
    return _statements(spark, d)


@query("content_p19_sql_prefilter", "select doc_id, length(\"text\") >= 12 and regexp_matches(\"text\", '(?i)\\b(select|insert|update|delete|create|alter|drop|merge|with)\\b') sql from documents where \"text\" is not null")
def p19(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", co.looks_like_sql(F.col("text")).alias("sql"))


IDENTITY = """, kn as (select tbl, count(distinct "schema") k, min("schema") one from sr where "schema" <> '' group by 1),
idn as (select distinct sr."schema", sr.tbl, case when sr."schema" <> '' then sr."schema" || '.' || sr.tbl when k = 1 then one || '.' || sr.tbl else sr.tbl end identity from sr left join kn using (tbl))"""


@query("content_p20_table_identities", "with " + SQL_ROWS + IDENTITY + " select * from idn")
def p20(spark: SparkSession, d: str) -> DataFrame:
    return co.table_identities(_statements(spark, d))


@query("content_p21_sql_edges", "with " + SQL_ROWS + IDENTITY + """ select sr."key", identity, case "role" when 'defines' then 'defines_table' when 'alters' then 'alters_table' else 'accesses_table' end kind, count(*) n from sr join idn using ("schema", tbl) group by all""")
def p21(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "sql")
    s = scratch.save(_statements(spark, d), "statements")
    j = s.join(co.table_identities(s), ["schema", "tbl"])
    return j.groupBy("key", "identity", F.concat("role", F.lit("_table")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("content_p22_literals", "select o_orderkey \"key\", unnest([1, 2]) line, unnest(['select ' || (o_custkey % 9) || ' from t', 'raw \"' || (o_orderkey % 7) || '\" text']) \"value\" from orders")
def p22(spark: SparkSession, d: str) -> DataFrame:
    code = "concat('let a = \"select ', o_custkey % 9, ' from t\"; // \"no\"\\nlet b = r#\"raw \"', o_orderkey % 7, '\" text\"#; /* \"nor\" */')"
    t = table(spark, d, "orders").selectExpr("o_orderkey key", f"{code} text", "'rust' language")
    return ps.flat_map(t, ps.literals, "key long, line int, value string")


OWN = """, lp as (select file_id, sym_id pt, start_line + 2 line from g_defs), ow as (select p.file_id, pt, min(struct_pack(z := body_end_line - body_start_line, s := sym_id)).s sym_id from lp p join g_defs d on d.file_id = p.file_id and p.line between body_start_line and body_end_line where body_start_line > 0 group by all)"""


@query("content_p23_literal_owners", CTES + OWN + " select * from ow")
def p23(spark: SparkSession, d: str) -> DataFrame:
    g = graph(spark, d, "g_defs")
    return co.owners(g.selectExpr("file_id", "sym_id pt", "start_line + 2 line"), g)


@query("content_p24_code_tables", CTES + OWN + ", lt as (select 10000000 + o_orderkey pt, 't' || (o_orderkey % 30) tbl from orders) select distinct ow.sym_id src, tbl, 'accesses_table' kind from ow join lt using (pt)")
def p24(spark: SparkSession, d: str) -> DataFrame:
    """Statements in literals of methods, owned by the smallest body around them."""
    g = graph(spark, d, "g_defs")
    own = co.owners(g.selectExpr("file_id", "sym_id pt", "start_line + 2 line"), g)
    code = table(spark, d, "orders").selectExpr("10000000 + o_orderkey key", "concat('let q = \"SELECT a FROM t', o_orderkey % 30, ' WHERE b = 1\";') text", "'rust' language")
    lits = ps.flat_map(code, ps.literals, "key long, line int, value string").where(co.looks_like_sql(F.col("value")))
    refs = ps.flat_map(lits.select("key", "value"), ps.sql_tables, "pt long, ordinal int, role string, schema string, tbl string")
    return own.join(refs, "pt").select(F.col("sym_id").alias("src"), "tbl", F.concat("role", F.lit("_table")).alias("kind")).distinct()


def _xml(spark: SparkSession, d: str) -> DataFrame:
    x = "concat('<log><set id=\"c', s_suppkey, '\"><createTable tableName=\"T', s_suppkey % 12, '\"/><sql>select 1\\n  from t2 &amp; x</sql><sql>b</sql></set></log>')"
    return ps.flat_map(table(spark, d, "supplier").selectExpr("s_suppkey key", f"{x} text"), ps.xml_elements, "key long, chain string, tag string, sig string, own string")


@query(
    "content_p25_xml_elements",
    """select s_suppkey "key", 'log' chain, 'log' tag, '' own from supplier union all select s_suppkey, 'log/set[c' || s_suppkey || ']', 'set', '' from supplier
union all select s_suppkey, 'log/set[c' || s_suppkey || ']/createTable:1', 'createTable', '' from supplier union all select s_suppkey, 'log/set[c' || s_suppkey || ']/sql:' || unnest([1, 2]), 'sql', unnest(['select 1 from t2 & x', 'b']) from supplier""",
)
def p25(spark: SparkSession, d: str) -> DataFrame:
    return _xml(spark, d).select("key", "chain", "tag", "own")


@query("content_p26_xml_tables", "select s_suppkey \"key\", 'log/set[c' || s_suppkey || ']/createTable:1' chain, 't' || (s_suppkey % 12) tbl, 'defines' \"role\" from supplier")
def p26(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([("tableName", "createTable", "defines"), ("tableName", "dropTable", "alters")], "attribute string, element string, role string")
    return co.xml_table_refs(_xml(spark, d), rules)


# stores of vectors ---------------------------------------------------------------------------


@query("s8_sidecar_load", "select f fingerprint, arg_max(label, struct_pack(p := vec_id % 3 = 0, s := vec_id)) label from (select vec_id % 200 f, vec_id, label from embeddings) group by f")
def s8(spark: SparkSession, d: str) -> DataFrame:
    """Segments of repeated fingerprints; packs, every third, come first."""
    from symloom.sources.frames import load_sidecar

    seg = table(spark, d, "embeddings").selectExpr("vec_id % 200 fingerprint", "cast(label as double) scale", "array(cast(1 as tinyint)) codes", "vec_id % 3 = 0 is_pack", "vec_id segment")
    manifest = spark.createDataFrame([("m1", "64")], "model string, dim string")
    return load_sidecar(seg, manifest, {"model": "m1", "dim": "64"}).select("fingerprint", F.col("scale").cast("int").alias("label"))
