"""Queries over source text: extraction, indexing and refresh, interfaces, policy facts, facts of documents, declaring.

The texts are made from the relational tables' keys, in expressions that Spark and DuckDB read alike; the SQL states
what they hold. So each query reads as many files as its table has rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import declarations, docs, indexing, interfaces, policy, reports, resolve, syntax
from ..sources import files
from ..sources.projection import Graph
from .stored_catalogue import STORED, rows, stored_query, texts


def _text(*lines: str) -> str:
    return " || chr(10) || ".join(lines)


K = "cast(floor(p_partkey / 2) as bigint)"
PYTHON = _text(
    "'import os'", f"'from ..pkg' || ({K} % 7) || '.m' || {K} || ' import f' || {K}", "''", "'class C' || p_partkey || '(Base):'", "'    def run(self, a, b=1):'", "'        if a and b:'", f"'            return f' || {K} || '(a)'",
    "'        elif a:'", "'            self.stop()'", "'        for x in a:'", "'            print(x)'", "'        return None'", "''", "'def f' || p_partkey || '(x):'", "'    return C' || p_partkey || '().run(x)'",
)
PY_PATH = "'pkg' || (p_partkey % 7) || '/m' || p_partkey || '.py' as path"
Q, D = "chr(39)", "'$'"
STORED |= {
    "py_files": ("part", (PY_PATH, "'python' as language", f"case when p_partkey % 10 = 0 then 'def (' else {PYTHON} end as text", "p_partkey as n")),
    "changed_py_files": ("part", (PY_PATH, "'python' as language", f"case when p_partkey % 10 = 0 then 'def (' else {PYTHON} || case when p_partkey % 3 = 0 then {_text("''", "''", "'def g' || p_partkey || '():'", "'    f' || p_partkey || '(1)'")} else '' end end as text", "p_partkey as n")),
    "route_files": ("part", ("'r' || p_partkey || '.ts' as path", _text(f"'import express from ' || {Q} || 'express' || {Q} || ';'", f"'const BASE = ' || {Q} || '/api/v' || (p_partkey % 3) || {Q} || ';'", f"'router.get(`' || {D} || '{{BASE}}/items/:id`, h);'", f"'app.post(' || {Q} || '/x' || p_partkey || {Q} || ', h);'", f"'cache.get(' || {Q} || '/no' || {Q} || ');'", "'router.put(BASE, h);'").replace("{{", "{").replace("}}", "}") + " as text", "p_partkey as n")),
    "request_files": ("part", ("'q' || p_partkey || '.ts' as path", _text(f"'const PATH = ' || {Q} || '/p' || p_partkey || {Q} || ';'", f"'axios.get(`' || {D} || '{{API_URL}}/u/' || {D} || '{{id}}`);'", f"'fetch(' || {Q} || '/f' || p_partkey || {Q} || ', {{'", f"'  method: ' || {Q} || 'POST' || {Q} || ' }});'", "'axios.put(PATH, d);'", "'fetch(url);'").replace("{{", "{").replace("}}", "}") + " as text", "p_partkey as n")),
    "java_files": ("part", ("'J' || p_partkey || '.java' as path", _text("'@RestController'", "'@RequestMapping(\"/api/c' || p_partkey || '\")'", "'public class C {'", "'  @GetMapping(\"/{id}\")'", "'  X a() {}'", "'  @RequestMapping(value = \"/m\", method = RequestMethod.PUT)'", "'  X b() {}'", "'  @PostMapping'", "'  X c() {}'", "'}'") + " as text", "p_partkey as n")),
    "command_files": ("part", ("'c' || p_partkey || '.ts' as path", _text("'import { Command } from \"commander\";'", "'const repo = program'", "'  .command(\"repo' || p_partkey || '\");'", "'repo.command(\"add <path>\").description(\"Adds\").action(add);'", "'repo.command(\"silent\");'") + " as text", "p_partkey as n")),
    "c_files": ("part", ("'c' || p_partkey || '.c' as path", "'c' as language", _text(
        "'static op_res_t map_res(code_t c, int *n) {'", "'  switch (c) {'", "'    case A' || p_partkey || ':'", "'    case B: return X' || p_partkey || '; // case Z: return NO;'", "'    case C: n = 0; break;'", "'    default: return BAD;'", "'  }'", "'}'",
        "'int fetch_it(int n)'", "'{'", "'  int rc = 0;'", "'  for (int t = 0; t < ' || (p_partkey % 5 + 1) || '; t++) {'", "'    rc = get_it(n);'", "'    if (rc == 0) break;'", "'    sleep(' || (p_partkey % 4 + 1) || ');'", "'  }'", "'  curl_easy_setopt(h, CURLOPT_RESUME_FROM, off' || p_partkey || ');'",
        "'  if (!check(rc)) { log_it(fmt(rc), \"f(x) {\"); }'", "'  free(p);'", "'  (void)ignored(rc);'", "'  return map_res(rc, 0);'", "'}'") + " as text", "p_partkey as n")),
    "front_docs": ("part", ("'d' || p_partkey || '/README.md' as path", "p_partkey % 2 = 0 as generated", f"case p_partkey % 4 when 0 then {_text("'---'", "'replaces: old-' || p_partkey", "'deprecated: true'", "'---'", "'deprecated_by: body'")} when 1 then {_text("'---'", "'deprecated_by: \"new-' || p_partkey || '\"'", "'deprecated: true'", "'---'")} when 2 then {_text("'---'", "'alternative_to: other'", "'---'")} else 'replaces: nothing' end as text", "p_partkey as n")),
    "config_docs": ("part", ("case p_partkey % 3 when 0 then 'deploy' || p_partkey || '/prod/docker-compose.yml' when 1 then 'app' || p_partkey || '/.env.stage' else 'x' || p_partkey || '/compose.yaml' end as path", "false as generated", _text("'version: \"3\"'", "'services:'", "'  # api'", "'  api' || p_partkey || ':'", "'    image: x'", "''", "'  \"db\":'", "'    image: y'", "'volumes:'", "'  v:'") + " as text", "p_partkey as n")),
    "asked_waivers": ("orders", ("'repo' || (o_custkey % 5) as repo_uid", "'REQ-' || o_orderkey as req_id", "case o_orderkey % 4 when 0 then 'one' when 1 then null else '' || (o_orderkey % 9) end as requirement_version", "'OB' || (o_custkey % 3) as obligation_id", "case when o_orderkey % 5 > 0 then 'late' else ' ' end as reason")),
    "file_bindings": ("supplier", ("'S' || s_suppkey as file_uid", "case s_suppkey % 4 when 0 then 'lodash' when 1 then 'app' when 2 then 'helper' else 'console' end as identifier", "case s_suppkey % 4 when 0 then 'lodash' when 1 then 'express' when 2 then './helper' else 'fs' end as specifier", "s_suppkey % 4 = 2 as relative")),
    "file_symbols": ("supplier", ("'S' || s_suppkey as file_uid", "case when s_suppkey % 2 = 0 then 'fn' || (s_suppkey % 50) else 'Cls' || (s_suppkey % 20) end as name", "case s_suppkey % 3 when 0 then 'FUNCTION' when 1 then 'INTERFACE' else 'CLASS' end as subtype")),
    "diff_lines": ("part", ("case p_partkey % 4 when 0 then 'A' when 1 then 'M' when 2 then 'D' else 'R090' || chr(9) || 'was/' || p_partkey end || chr(9) || 'src/' || p_partkey as value",)),
}


# Syntax


def _facts(g: Graph, table: str = "py_files") -> DataFrame:
    return syntax.facts(_hashed(texts(g, table)))


def _hashed(df: DataFrame) -> DataFrame:
    return df.select("path", files.content_hash(F.col("text")).alias("content_hash"), "language", "text")


def parsed_query(sql: str, *names: str, among: str = "true"):
    """A query whose SQL reads ``all_files`` and, of these, ``good``: files that parse, with k the number of the file that each imports."""
    return stored_query(f"select * from (with all_files as (select * from py_files where {among}), good as (select *, n // 2 as k from all_files where n % 10 <> 0) {sql})", "py_files", *names)


@stored_query("""select path, case when n % 10 = 0 then 'failed' else 'parsed' end as parse_status, case when n % 10 = 0 then 1 else 15 end as line_count from py_files""", "py_files")
def extracted_files(g):
    return _facts(g).select("path", "parse_status", "line_count")


@parsed_query("""select path, 'C' || n as qualified_name, 'C' || n as name, 'CLASS' as subtype, 'export' as visibility, 4 as line_start, 12 as line_end, null as signature from good
  union all select path, 'C' || n || '.run', 'run', 'METHOD', 'export', 5, 12, 'def run(self, a, b=1)' from good
  union all select path, 'f' || n, 'f' || n, 'FUNCTION', 'export', 14, 15, 'def f' || n || '(x)' from good""")
def extracted_symbols(g):
    return syntax.symbols(_facts(g)).select("path", "qualified_name", "name", "subtype", "visibility", "line_start", "line_end", "signature")


REFERENCES = """refs as (select path, 0 as ord, null as source, 'IMPORTS' as type, 'os' as target_key, 1 as line from good
  union all select path, 1, null, 'IMPORTS', 'pkg' || (k % 7) || '/m' || k, 2 from good
  union all select path, 2, 'C' || n || '.run', 'CALLS', 'f' || k, 7 from good union all select path, 3, 'C' || n || '.run', 'CALLS', 'self.stop', 9 from good
  union all select path, 4, 'f' || n, 'CALLS', 'C' || n, 15 from good union all select path, 5, 'f' || n, 'CALLS', 'C' || n || '().run', 15 from good)"""


@parsed_query(f", {REFERENCES} select * from refs")
def extracted_references(g):
    return syntax.references(_facts(g))


@parsed_query("""select path, 'os' as identifier, 'os' as specifier, false as relative, null as imported_name, 1 as line from good
  union all select path, 'f' || k, '..pkg' || (k % 7) || '.m' || k, true, 'f' || k, 2 from good""")
def extracted_bindings(g):
    return syntax.bindings(_facts(g))


@parsed_query("""select path, q as qualified_name, kind, value from good, lateral (values ('C' || n || '.run', 'cyclomatic_complexity', 5), ('C' || n || '.run', 'max_nesting_depth', 1), ('C' || n || '.run', 'parameter_count', 3),
  ('C' || n || '.run', 'function_length', 8), ('C' || n || '.run', 'cognitive_complexity', 4), ('f' || n, 'cyclomatic_complexity', 1), ('f' || n, 'max_nesting_depth', 0), ('f' || n, 'parameter_count', 1), ('f' || n, 'function_length', 2), ('f' || n, 'cognitive_complexity', 0)) v(q, kind, value)""")
def extracted_metrics(g):
    return syntax.measurements(_facts(g))


# A whole index, and its refresh


EDGES = """targets as (select g.*, t.path as to_path, t.n % 10 <> 0 as to_good from good g join all_files t on t.n = g.k),
edges as (select path as src, to_path as dst, 'IMPORTS' as type from targets
  union select path || '#C' || n || '.run#METHOD', to_path || '#f' || k || '#FUNCTION', 'CALLS' from targets where to_good
  union select path || '#f' || n || '#FUNCTION', path || '#C' || n || '#CLASS', 'CALLS' from good
  union select 'pkg' || (n % 7) || ':MODULE', path, 'OWNS' from all_files
  union select 'pkg' || (n % 7) || ':MODULE', 'pkg' || (k % 7) || ':MODULE', 'IMPORTS' from targets where n % 7 <> k % 7)"""


def _index(g: Graph) -> indexing.Index:
    return indexing.index(_hashed(texts(g, "py_files")))


@parsed_query("""select path as uid, 'FILE' as kind, null as subtype, 'm' || n || '.py' as name, path from all_files
  union all select distinct 'pkg' || (n % 7) || ':MODULE', 'MODULE', null, 'pkg' || (n % 7), 'pkg' || (n % 7) from all_files
  union all select path || '#C' || n || '#CLASS', 'SYMBOL', 'CLASS', 'C' || n, path from good union all select path || '#C' || n || '.run#METHOD', 'SYMBOL', 'METHOD', 'run', path from good
  union all select path || '#f' || n || '#FUNCTION', 'SYMBOL', 'FUNCTION', 'f' || n, path from good""")
def index_nodes(g):
    return _index(g).nodes


@parsed_query(f", {EDGES} select * from edges")
def index_edges(g):
    return _index(g).edges


@parsed_query(f""", {REFERENCES}, u as (select r.*, path || coalesce('#' || source || case when contains(source, '.') then '#METHOD' else '#FUNCTION' end, '') as source_uid, g.k from refs r join good g using (path))
  select path || '#' || ord as edge_uid, source_uid, path, type, target_key, case when type = 'IMPORTS' then 'imports_file_not_found' when contains(target_key, '.') then 'calls_obj_method_needs_type_info' else 'calls_function_ambiguous_or_missing' end as category
  from u where ord in (0, 3, 5) or ord = 1 and k not in (select n from all_files) or ord = 2 and k not in (select n from good)""")
def index_unresolved(g):
    return _index(g).unresolved


LEFT = "n % 11 <> 0"


@parsed_query(f", {EDGES} select * from edges union select path || '#g' || n || '#FUNCTION', path || '#f' || n || '#FUNCTION', 'CALLS' from good where n % 3 = 0", among=LEFT)
def refreshed_edges(g):
    """After some files changed and others went: what an index of the files left would hold."""
    return indexing.refresh(_facts(g), _hashed(texts(g, "changed_py_files").filter("n % 11 <> 0"))).edges


@parsed_query(f", {EDGES} select * from edges union select path || '#g' || n || '#FUNCTION', path || '#f' || n || '#FUNCTION', 'CALLS' from good where n % 3 = 0", among=LEFT)
def refreshed_edges_by_links(g):
    """The same by linking again only what the change touches."""
    return indexing.refresh_links(indexing.stored(_index(g)), _hashed(texts(g, "changed_py_files").filter("n % 11 <> 0"))).edges


# Interfaces


@stored_query("""select path, line, method, address from route_files, lateral (values (3, 'GET', '/api/v' || (n % 3) || '/items/{id}'), (4, 'POST', '/x' || n), (6, 'PUT', '/api/v' || (n % 3))) v(line, method, address)""", "route_files")
def routes_in_source(g):
    return interfaces.routes(texts(g, "route_files"))


@stored_query("""select path, line, client, method, address, basis, confidence::double as confidence from request_files, lateral (values (2, 'axios', 'GET', '/u/{param}', 'template', 0.8), (3, 'fetch', 'POST', '/f' || n, 'literal', 0.9), (5, 'axios', 'PUT', '/p' || n, 'template', 0.85)) v(line, client, method, address, basis, confidence)""", "request_files")
def requests_in_source(g):
    return interfaces.requests(texts(g, "request_files"))


@stored_query("""select path, line, method, address from java_files, lateral (values (4, 'GET', '/api/c' || n || '/{id}'), (6, 'PUT', '/api/c' || n || '/m'), (8, 'POST', '/api/c' || n)) v(line, method, address)""", "java_files")
def annotated_routes(g):
    return interfaces.annotated_routes(texts(g, "java_files"))


@stored_query("select path, 4 as line, 'repo' || n || ' add' as address, 'add <path>' as raw, 'Adds' as description from command_files", "command_files")
def commands_in_source(g):
    return interfaces.commands(texts(g, "command_files"))


# Policy facts


@stored_query("""select path, 'map_res' as function_name, 1 as line_start, 8 as line_end, 'code_t' as source_type, 'op_res_t' as target_type, 'A' || n || ',B' as inputs, 'X' || n as output, 'BAD' as default_output from c_files""", "c_files")
def status_mappings(g):
    return policy.status_mappings(texts(g, "c_files")).withColumn("m", F.explode("mappings")).select("path", "function_name", "line_start", "line_end", "source_type", "target_type", F.array_join("m.inputs", ",").alias("inputs"), "m.output", "default_output")


@stored_query("""select path, 'fetch_it' as function_name, 'RETRY_LOOP' as kind, 12 as line_start, 16 as line_end, 'for' as form, 'sleep' as value, (n % 4 + 1) * 1000 as delay_ms, n % 5 + 1 as max_attempts, 'rc == 0' as break_condition from c_files
  union all select path, 'fetch_it', 'RESUME_OFFSET', 17, 17, 'CURLOPT_RESUME_FROM', 'off' || n, null, null, null from c_files""", "c_files")
def behavioral_markers(g):
    return policy.behavioral_markers(texts(g, "c_files"))


@stored_query("""select path, 'fetch_it' as caller, callee, line, fate, detail, callee = 'map_res' as own from c_files, (values ('get_it', 13, 'STORED', 'rc'), ('sleep', 15, 'IGNORED', null), ('curl_easy_setopt', 17, 'IGNORED', null), ('check', 18, 'CHECKED', 'if'),
  ('log_it', 18, 'IGNORED', null), ('fmt', 18, 'TRANSFORMED', 'log_it'), ('ignored', 20, 'IGNORED', 'void'), ('map_res', 21, 'PROPAGATED', null)) v(callee, line, fate, detail)""", "c_files")
def return_fates(g):
    return policy.fates(texts(g, "c_files"))


# Documents, declarations, changes


@stored_query("""select path, v.fact_kind, 'd' || n as subject, v.object, 0.9::double * case when generated then 0.8 else 1 end as confidence from front_docs, lateral (values (0, 'replacement_for', 'old-' || n), (0, 'deprecated_by', null), (1, 'deprecated_by', 'new-' || n), (2, 'alternative_to', 'other')) v(r, fact_kind, object) where n % 4 = r""", "front_docs")
def front_matter_facts(g):
    return docs.front_matter_facts(texts(g, "front_docs"))


@stored_query("""select path, s as subject, case n % 3 when 0 then 'production' when 1 then 'staging' else 'default' end as environment, 0.9::double as confidence from config_docs, lateral (values (0, 'api' || n), (0, 'db'), (1, 'app' || n), (2, 'api' || n), (2, 'db')) v(r, s) where n % 3 = r""", "config_docs")
def environment_facts(g):
    return docs.environment_facts(texts(g, "config_docs"))


@stored_query("""select repo_uid, 'waiver' as kind, case when e is null then repo_uid || ':waiver:' || req_id || '#' || obligation_id end as target_stable_key,
  case when e is null then '{"obligation_id":"' || obligation_id || '","reason":"' || reason || '","req_id":"' || req_id || '","requirement_version":' || requirement_version || '}' end as value_json, e as error
  from (select *, case when requirement_version is null and trim(reason) = '' then 'missing: requirement_version, reason' when requirement_version is null then 'missing: requirement_version' when trim(reason) = '' then 'missing: reason' when requirement_version = 'one' then 'not a number: requirement_version' end as e from asked_waivers)""", "asked_waivers")
def declared_waivers(g):
    return declarations.declare(rows(g, "asked_waivers"), "waiver").drop("declaration_uid")


@stored_query("select 'src/' || p_partkey as path, ['added', 'modified', 'deleted', 'renamed'][p_partkey % 4 + 1] as change from part")
def changed_paths(g):
    return reports.changed_paths(rows(g, "diff_lines"))


# Classification by file

BY_FILE = """e as (select u.*, s.file_uid, case when category in ('calls_function_ambiguous_or_missing', 'instantiates_class_not_found') then target_key when category = 'calls_obj_method_needs_type_info' then split_part(target_key, '.', 1) end as id,
    case when category = 'calls_obj_method_needs_type_info' then 'receiver' else 'callee' end as role, substr(s.file_uid, 2)::bigint as k from unresolved u join symbols s on s.uid = u.source_uid),
j as (select e.*, b.specifier as spec, b.relative, coalesce(case when category like 'calls_%' then y.subtype in ('FUNCTION', 'CLASS') when category = 'instantiates_class_not_found' then y.subtype = 'CLASS' end, false) as own
  from e left join file_bindings b on b.file_uid = e.file_uid and b.identifier = e.id left join file_symbols y on y.file_uid = e.file_uid and y.name = e.id),
v as (select edge_uid, file_uid, category, target_key, case
  when category = 'calls_obj_method_needs_type_info' and id = 'app' and k % 4 = 1 then 'framework_boundary_candidate|express_route_registration'
  when category like 'calls_this_%' then 'internal_candidate|this_receiver_implies_internal'
  when category = 'imports_file_not_found' then case target_key when './local/x' then 'internal_candidate|relative_import_target_unresolved' when 'lodash/fp' then case when k % 2 = 0 then 'external_library_candidate|specifier_matches_package_dependency' end
    when 'fs' then 'external_library_candidate|specifier_matches_runtime_module' when '@app/core' then case when k % 3 = 0 then 'internal_candidate|specifier_matches_project_alias' end
    when 'serde_json::value' then case when k % 2 = 0 then 'external_library_candidate|specifier_matches_package_dependency' else 'internal_candidate|rust_crate_internal_module_heuristic' end end
  when category = 'other' or id is null then null
  when own then 'internal_candidate|' || role || '_matches_same_file_symbol' when spec = 'fs' then 'external_library_candidate|specifier_matches_runtime_module'
  when spec = 'lodash' and k % 2 = 0 then 'external_library_candidate|' || role || '_matches_external_import' when relative then 'internal_candidate|' || role || '_matches_internal_import'
  when id in ('console', 'fn7', 'Cls7') then 'external_library_candidate|' || role || '_matches_runtime_global' end as x from j)"""


@stored_query(f"+ & {BY_FILE} select edge_uid, file_uid, category, target_key, split_part(coalesce(x, 'unknown|no_supporting_signal'), '|', 1) as classification, split_part(coalesce(x, 'unknown|no_supporting_signal'), '|', 2) as basis from v", "file_bindings", "file_symbols")
def classify_unresolved_by_file(g):
    homes = g.symbols().select(F.col("uid").alias("source_uid"), "file_uid")
    edges = g.unresolved().join(homes, "source_uid").select("edge_uid", "file_uid", "category", "target_key")
    key, none = F.col("s_suppkey"), F.array().cast("array<string>")
    packages = g.table("supplier").select(F.concat(F.lit("S"), key).alias("file_uid"), F.when(key % 2 == 0, F.array(F.lit("lodash"), F.lit("serde-json"))).otherwise(none).alias("dependencies"), F.when(key % 3 == 0, F.array(F.lit("@app/*"))).otherwise(none).alias("aliases"))
    runtime = g.spark.createDataFrame([(["fs", "path"], ["console", "fn7", "Cls7"])], "runtime_modules array<string>, runtime_globals array<string>")
    return resolve.classify_by_file(edges, rows(g, "file_bindings"), rows(g, "file_symbols"), packages, runtime)
