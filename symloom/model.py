"""The code graph's data model: enumerations with fixed codes and the schemas of its tables."""

from __future__ import annotations

# Edge kinds and their stored codes.
EDGE_KINDS = {
    "defined_in": 1, "contains": 2, "calls": 3, "type_use": 4, "field_access": 5, "implements": 6, "overrides": 7, "instantiates": 8, "generic_constraint": 9, "imports": 10,
    "corresponds_to": 11, "links_to": 12, "embeds": 13, "links_to_file": 14, "uses_css_class": 15, "extends_rule": 16, "extends_type": 17, "defines_table": 18, "alters_table": 19, "accesses_table": 20,
}
KIND_OF_CODE = {v: k for k, v in EDGE_KINDS.items()}
FIELD_OPS = {"read": 0, "write": 1}
IMPORT_KINDS = {"explicit": 0, "re_export": 1}
CORRESPONDENCE_SOURCES = {"config": 0, "auto_inferred": 1, "codegen": 2}
LINK_GRADES = {"exact": 0, "drifted": 1, "fuzzy": 2, "ambiguous": 3, "dangling": 4}
MATCH_KINDS = ("exact", "prefix", "contains", "fuzzy")
LANGUAGE_PREFIX = {
    "csharp": "cs", "typescript": "ts", "rust": "rs", "go": "go", "python": "py", "markdown": "md", "css": "css", "sass": "sass", "html": "html", "swift": "sw", "sql": "sql", "xml": "xml", "text": "text",
}
CODE_LANGUAGES = ("rust", "typescript", "csharp", "go", "python", "swift")
SCOPES = ("package", "module", "namespace")
CLASS_LIKE = ("class", "struct", "trait", "interface", "enum", "type_alias")
LEAVES = (*CLASS_LIKE, "document", "attachment")
CALLABLE = ("function", "method", "constructor", "destructor", "operator")

# How much an edge kind weighs in the rolled-up graph; other kinds are left out.
ROLLUP_WEIGHTS = {
    "calls": 3, "type_use": 2, "field_access": 2, "implements": 2, "extends_type": 2, "instantiates": 2, "embeds": 2, "overrides": 1, "imports": 1, "links_to": 1,
}
# These kinds count four times when communities are sought.
CLUSTER_BOOST = {"implements": 4, "overrides": 4, "extends_type": 4}
UNASSIGNED = 4294967295

# The order in which usages are walked.
USAGE_KINDS = ("calls", "type_use", "field_access", "instantiates", "imports", "links_to", "links_to_file", "embeds", "uses_css_class")
LISTED_USAGES = ("calls", "type_use", "field_access", "instantiates", "defines_table", "alters_table", "accesses_table")
PAGE, PAGE_MOST = 25, 50

SCHEMAS = {
    "files": "id long, path string, language string, test boolean, external boolean, content_hash long",
    "packages": "id long, name string, version string, manager string, external boolean",
    "symbols": "id long, pub_id string, language string, pkg_id long, kind string, name string, name_lower string, enclosing_sym_id long, partial boolean, nargs int, targs int, external boolean, test boolean",
    "symbol_docs": "sym_id long, sig string, doc string",
    "file_docs": "file_id long, doc string",
    "defs": "sym_id long, file_id long, start_line int, start_col int, end_line int, end_col int, body_start_line int, body_end_line int",
    "edges": "src_id long, target_id long, kind int, field_op byte, import_kind byte, corr_source byte, corr_generator string, corr_canon_id long, link_grade byte, link_relation string",
    "aggregate_nodes": "id long, kind string, name string, language string, external boolean, test boolean, example boolean, anchor_id long, anchor_name string",
    "aggregate_edges": "src_id long, dst_id long, kind string, weight long",
    "stats": "scope string, key string, subset string, metric string, value long",
    "findings": "id string, text string, tags array<string>, parent_ids array<string>, created_at timestamp",
    "anchor_events": "finding_id string, seq long, op string, anchor string, `from` string, `to` string, ts timestamp, sha string, outcome string",
    "vectors": "id long, row_kind string, fingerprint long, embedding array<float>",
}
