"""A code graph projected from the relational test tables, in SQL both engines read.

Packages are nations; regions, nations, suppliers, customers, parts and orders are symbols; line items
are calls, type uses and field accesses. The text of each table is kept once: Spark reads it with the
tables' DataFrames put in, the SQL twins as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from symloom.runtime import table

LANG = "case {r} when 0 then 'rust' when 1 then 'typescript' when 2 then 'csharp' when 3 then 'go' else 'python' end"

_NATION = "(select n_nationkey n, n_regionkey r, (n_nationkey % 8 = 7) ext from nation)"

TEXT = {
    "g_packages": "select cast(n_nationkey + 1 as bigint) id, concat('pkg_', n_nationkey) name, '1.0.0' version, 'npm' manager, (n_nationkey % 8 = 7) external from nation",
    "g_symbols": f"""
select id, concat(language, ':', kind, '/', name, '#', id) pub_id, language, pkg_id, kind, name, lower(name) name_lower, enclosing_sym_id, nargs, external, test from (
  select cast(1 + r_regionkey as bigint) id, {LANG.format(r="r_regionkey")} language, cast(0 as bigint) pkg_id, 'package' kind, concat('region_', r_regionkey) name, cast(0 as bigint) enclosing_sym_id, cast(null as int) nargs, false external, false test from region
  union all select cast(100 + n as bigint), {LANG.format(r="r")}, cast(n + 1 as bigint), 'module', concat('nation_', n), cast(1 + r as bigint), null, ext, false from {_NATION} x
  union all select 1000000 + s_suppkey, {LANG.format(r="r")}, cast(n + 1 as bigint), 'interface', concat('SupplierApi', s_suppkey), cast(100 + n as bigint), null, ext, false from supplier join {_NATION} x on n = s_nationkey
  union all select 2000000 + c_custkey, {LANG.format(r="r")}, cast(n + 1 as bigint), case c_mktsegment when 'AUTOMOBILE' then 'struct' when 'MACHINERY' then 'trait' when 'HOUSEHOLD' then 'enum' else 'class' end,
    concat(case c_mktsegment when 'AUTOMOBILE' then 'Automobile' when 'MACHINERY' then 'Machinery' when 'HOUSEHOLD' then 'Household' when 'BUILDING' then 'Building' else 'Furniture' end, 'Customer', c_custkey), cast(100 + n as bigint), null, ext, false from customer join {_NATION} x on n = c_nationkey
  union all select 4000000 + p_partkey, {LANG.format(r="r")}, cast(n + 1 as bigint), 'function', replace(p_name, ' ', '_'), cast(100 + n as bigint), cast(p_size % 5 as int), ext, false from part join {_NATION} x on n = p_partkey % 25
  union all select 10000000 + o_orderkey, {LANG.format(r="r")}, cast(n + 1 as bigint), 'method', concat('processOrder', o_orderkey), 2000000 + o_custkey, cast(o_orderkey % 4 as int), ext, (o_orderstatus = 'P') from orders join customer on c_custkey = o_custkey join {_NATION} x on n = c_nationkey) g""",
    "g_edges": """
select id src_id, enclosing_sym_id target_id, 1 kind, cast(null as int) field_op from g_symbols where enclosing_sym_id <> 0
union all select cast(100 + n_nationkey as bigint), cast(1 + 4 * n_nationkey + j as bigint), 2, null from nation cross join (select 0 j union all select 1 union all select 2 union all select 3) k
union all select 10000000 + l_orderkey, 4000000 + l_partkey, 3, null from lineitem
union all select 10000000 + l_orderkey, 1000000 + l_suppkey, 4, null from lineitem
union all select 10000000 + l_orderkey, 4000000 + l_partkey, 5, case when l_linestatus = 'F' then 0 else 1 end from lineitem where l_quantity >= 40
union all select 2000000 + o_custkey, 1000000 + l_suppkey, 6, null from lineitem join orders on o_orderkey = l_orderkey where l_returnflag = 'R' and l_discount >= 0.09 and l_partkey % 7 = 3 group by o_custkey, l_suppkey
union all select 10000000 + o_orderkey, 2000000 + o_custkey, 8, null from orders where o_totalprice > 400000
union all select cast(100 + c_nationkey as bigint), cast(100 + s_nationkey as bigint), 10, null from lineitem join orders on o_orderkey = l_orderkey join customer on c_custkey = o_custkey join supplier on s_suppkey = l_suppkey
  where l_discount >= 0.1 and l_partkey % 11 = 5 and c_nationkey <> s_nationkey group by c_nationkey, s_nationkey""",
    "g_files": f"""
select cast(1 + 4 * n + j as bigint) id, concat('r', r, '/n', n, '/', stem, case r when 0 then '.rs' when 1 then '.ts' when 2 then '.cs' when 3 then '.go' else '.py' end) path, {LANG.format(r="r")} language, (j = 2) test, ext external
from {_NATION} x cross join (select 0 j, 'src/lib' stem union all select 1, 'src/model' union all select 2, 'tests/model' union all select 3, 'examples/demo') k
union all select cast(1001 + n_nationkey as bigint), concat('docs/n', n_nationkey, '.md'), 'markdown', false, false from nation""",
    "g_defs": """
select id sym_id, cast(1 + 4 * (pkg_id - 1) + id % 4 as bigint) file_id, cast(1 + id % 997 * 10 as int) start_line, 0 start_col, cast(1 + id % 997 * 10 + id % 3 as int) end_line, 10 end_col,
  cast(1 + id % 997 * 10 + 1 as int) body_start_line, cast(1 + id % 997 * 10 + case when id >= 2000000 and id < 4000000 then 60 else 7 end as int) body_end_line
from g_symbols where pkg_id > 0""",
    "g_docs": "select 4000000 + doc_id sym_id, concat('fn doc_', doc_id) sig, text doc from documents",
    "g_communities": """
select id short_id, cast((id % 2) * 25 + id % 13 % 5 as bigint) community_id from g_symbols""",
}
SOURCES = {
    "g_packages": ["nation"], "g_symbols": ["region", "nation", "supplier", "customer", "part", "orders"], "g_edges": ["nation", "lineitem", "orders", "customer", "supplier", "g_symbols"],
    "g_files": ["nation"], "g_defs": ["g_symbols"], "g_docs": ["documents"], "g_communities": ["g_symbols"],
}

CTES = "with recursive " + ",\n".join(f"{n} as ({t})" for n, t in TEXT.items())


def graph(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A graph table; g_edges is narrow (src_id, target_id, kind, field_op)."""
    text = TEXT[name]
    inputs = {}
    for s in SOURCES[name]:
        inputs[f"v_{s}"] = graph(spark, d, s) if s.startswith("g_") else table(spark, d, s)
        for before in ("from ", "join "):
            text = text.replace(f"{before}{s} ", f"{before}{{v_{s}}} ").replace(f"{before}{s})", f"{before}{{v_{s}}})")
        if text.endswith(f"from {s}"):
            text = text[: -len(s)] + f"{{v_{s}}}"
        text = text.replace(f"from {s}\n", f"from {{v_{s}}}\n")
    return spark.sql(text, **inputs)
