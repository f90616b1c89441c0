"""Queries over stored tables: declarations, assessments, facts, surfaces, resources and refresh.

The projection's relational tables stand in for stored ones. ``STORED`` says how, in expressions that Spark and DuckDB
read alike, so both sides start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..operators import agent, declarations, detectors, discovery, docs, graph, incremental, modules, quality, reports, resolve, seams, state, stored
from ..sources import files, schema, store
from ..sources.projection import Graph
from .catalogue import query

# name -> source table, expressions
STORED: dict[str, tuple[str, tuple[str, ...]]] = {
    "paths": ("part", ("'src/f' || p_partkey || '.' || case p_partkey % 10 when 0 then 'ts' when 1 then 'tsx' when 2 then 'jsx' when 3 then 'java' when 4 then 'py' when 5 then 'rs' when 6 then 'H' when 7 then 'hpp' when 8 then 'cxx' else 'txt' end as path",)),
    "decl": ("orders", (
        "'D' || o_orderkey as declaration_uid", "o_orderstatus <> 'F' as is_active", "'repo:mod' || (o_custkey % 50) || case when o_custkey % 9 = 0 then ':FILE' else ':MODULE' end as target_stable_key",
        "case o_custkey % 5 when 0 then 'boundary' when 1 then 'requirement' when 2 then 'quality_policy' when 3 then 'waiver' else 'entrypoint' end as kind",
        """case o_custkey % 5 when 0 then case o_orderkey % 3 when 0 then '{"selectorDomain":"discovered_module","source":{"canonicalRootPath":"m' || (o_custkey % 50) || '"},"forbids":{"canonicalRootPath":"m' || (o_custkey % 7) || '"},"reason":"layering"}'
             when 1 then '{"forbids":"mod' || (o_custkey % 7) || '","reason":"old"}' else '{"selectorDomain":"discovered_module","reason":"half"}' end
           when 1 then '{"req_id":"REQ-' || (o_custkey % 20) || '","version":' || (o_custkey % 3) || ',"verification":[{"obligation_id":"o1","obligation":"covered","method":"coverage_threshold","target":"mod' || (o_custkey % 5) || '","threshold":0.5,"operator":">="},{"obligation":"simple","method":"complexity_threshold","threshold":' || (o_custkey % 40) || '.5}]}'
           when 2 then '{"policy_id":"p' || (o_custkey % 30) || '","version":' || (o_custkey % 3) || ',"policy_kind":"absolute_max","measurement_kind":"cyclomatic_complexity","threshold":' || (o_custkey % 60) || '.5,"severity":"fail"}' else '{}' end as value_json""",
    )),
    "resource_nodes": ("orders", ("'K' || o_orderkey as stable_key", "case o_custkey % 5 when 0 then 'FS_PATH' when 1 then 'DB_RESOURCE' when 2 then 'STATE' when 3 then 'BLOB' else 'SYMBOL' end as kind", "case o_custkey % 3 when 0 then 'CACHE' when 1 then 'QUEUE' end as subtype")),
    "resource_requests": ("orders", ("'K' || (o_orderkey + o_custkey % 3) as key",)),
    "versions": ("customer", ("'C' || c_custkey as file_uid", "'s' || (c_custkey % 3) as snapshot_uid", "case c_custkey % 4 when 0 then 'stale' when 1 then 'failed' else 'parsed' end as parse_status")),
    "scores": ("part", ("'P' || p_partkey as target_stable_key", "case p_partkey % 3 when 0 then 'hotspot_score' else 'pytest_test' end as kind", """case when p_partkey % 7 = 0 then '{"normalized_score":"none"}' else '{"normalized_score":' || p_size || '}' end as value_json""")),
    "judged": ("orders", ("'A' || o_orderkey as assessment_uid", "'p' || (o_custkey % 7) as policy_uid", "case when o_custkey % 2 = 0 then 'b' || (o_custkey % 3) end as baseline_snapshot_uid", "case o_orderkey % 3 when 0 then 'PASS' when 1 then 'FAIL' else 'NOT_APPLICABLE' end as computed_verdict", "'REQ-' || (o_custkey % 40) as req_id")),
    "providers": ("orders", ("'F' || o_orderkey as fact_uid", "case o_custkey % 3 when 0 then 'http' when 1 then 'cli_command' else 'queue' end as mechanism", "case o_custkey % 2 when 0 then 'express' else 'spring' end as framework", "'f' || (o_custkey % 9) || '.ts' as source_file")),
    "doc_facts": ("orders", ("'F' || o_orderkey as fact_uid", "case o_custkey % 3 when 0 then 'replacement_for' when 1 then 'deprecated_by' else 'alternative_to' end as fact_kind", "cast((o_custkey % 10) as double) / 10.0 as confidence", "'d' || (o_custkey % 30) || '.md' as source_file", "o_orderkey % 100 as line_start")),
    "package_facts": ("part", ("'P' || (p_partkey % 200) as target_stable_key", "case p_partkey % 3 when 0 then 'package_name' when 1 then 'package_version' else 'line_coverage' end as kind", """case when p_partkey % 2 = 0 then '{"value":"v' || (p_partkey % 5) || '"}' else '{"name":"n' || (p_partkey % 5) || '"}' end as value_json""")),
    "doc_nodes": ("supplier", ("'repo:dir' || (s_suppkey % 40) || case when s_suppkey % 3 = 0 then ':MODULE' when s_suppkey % 3 = 1 then ':FILE' else '/x:' || s_suppkey || ':SYMBOL' end as stable_key", "case s_suppkey % 3 when 0 then 'MODULE' when 1 then 'FILE' else 'SYMBOL' end as kind", "'name' || (s_suppkey % 25) as name")),
    "doc_requests": ("nation", ("case n_nationkey % 4 when 0 then 'dir' || n_nationkey when 1 then 'name' || n_nationkey when 2 then 'repo:dir' || n_nationkey || ':MODULE' else 'nothing' || n_nationkey end as query",)),
    "surface_evidence": ("orders", ("'S' || (o_custkey % 60) as project_surface_uid", "'p' || (o_orderkey % 8) as source_path", "case o_orderkey % 7 when 0 then 'config_file' when 1 then 'workspace_root' when 2 then 'package_root' when 3 then 'binary_entrypoint' when 4 then 'main_export' when 5 then 'container_command' else 'script' end as evidence_kind", "o_orderkey as confidence")),
    "functions": ("part", ("'P' || p_partkey as uid", "case p_partkey % 4 when 0 then 'test_' || p_partkey when 1 then 'TestThing' when 2 then 'helper' else 'Testify' end as name", "'t/' || case p_partkey % 3 when 0 then 'test_a.py' when 1 then 'conftest.py' else 'plain.py' end as path", "case p_partkey % 5 when 0 then '@pytest.fixture(scope=x)' when 1 then 'fixture' when 2 then 'fixtures' else 'other' end as decorator")),
    "macro_sources": ("part", ("'k/' || p_partkey || '.c' as path", "case p_partkey % 5 when 0 then 'module_init(fn' || p_partkey || ');' when 1 then 'int x; SYSCALL_DEFINE3( fn' || p_partkey || ', a)' when 2 then 'EXPORT_SYMBOL_GPL(fn' || p_partkey || ');' when 3 then 'my_module_init(fn' || p_partkey || ')' else 'none' end as text")),
    "macro_symbols": ("part", ("'P' || p_partkey as uid", "'fn' || p_partkey as name", "'k/' || p_partkey || '.c' as path")),
    "callsites": ("orders", ("'E' || o_orderkey as edge_uid", "'P' || (o_custkey % 90) as source_uid", "'f' || (o_custkey % 30) as file_uid", "'typescript' as language", "case o_custkey % 4 when 0 then 'fs' when 1 then 'node:fs' when 2 then 'fs/promises' end as module", "case o_orderkey % 4 when 0 then 'readFile' when 1 then 'writeFileSync' when 2 then 'appendFile' else 'stat' end as symbol", "case when o_orderkey % 11 = 0 then '' else '/data/' || (o_custkey % 25) end as logical_name", "o_orderkey % 2 = 0 as literal")),
    "file_modules": ("orders", ("'f' || (o_custkey % 30) as file_uid", "case o_orderkey % 6 when 0 then 'fs' when 1 then 'node:fs' when 2 then 'fs/promises' else 'path' end as module")),
    "scripts": ("part", ("'s' || p_partkey as source", "case p_partkey % 4 when 0 then 'npm run build' || p_partkey || ' && NODE_ENV=test npx jest --ci | tee log' when 1 then 'sudo make -j ; # done' when 2 then 'A=1 B=2 cargo test > out.txt' else '  tsc -p ' || p_partkey || ' || exec node x.js' end as script")),
    "notes": ("orders", ("'T' || (o_custkey % 80) as target", "case o_orderkey % 6 when 0 then 'module_readme' when 1 then 'file_header_comment' when 2 then 'jsdoc_block' when 3 then 'docstring' when 4 then 'package_description' else 'other' end as kind", "o_orderkey as line", "'f' || (o_custkey % 5) as file")),
    "surface_rows": ("supplier", ("'srf' || s_suppkey as uid", "'r' || (s_suppkey % 11) as root", "case s_suppkey % 3 when 0 then 'cli' when 1 then 'library' else 'web_app' end as kind", "case when s_suppkey % 4 = 0 then 'node' else 'jvm' end as runtime", "case when s_suppkey % 5 > 0 then 'n' || (s_suppkey % 13) end as name", "'k' || s_suppkey as key", "'m' || (s_suppkey % 3) as module", "'surface' as sort", "case s_suppkey % 4 when 0 then 'cargo_bin' when 1 then 'dockerfile' when 2 then 'package_json_bin' else 'docker_compose' end as source", "'e' || s_suppkey as detail", "cast((s_suppkey % 9) as double) / 10.0 as confidence")),
    "surface_requests": ("nation", ("case n_nationkey % 5 when 0 then 'srf' || n_nationkey when 1 then 'k' || n_nationkey when 2 then 'n' || (n_nationkey % 13) when 3 then 'srf' || n_nationkey || 'x' else 'sr' end as query",)),
    "found_roots": ("orders", ("case o_custkey % 3 when 0 then './' else '' end || 'pkg' || (o_custkey % 40) || case o_orderkey % 2 when 0 then '/' else '' end as root", "case o_orderkey % 3 when 0 then 'declared' when 1 then 'operational' else 'inferred' end as kind", "cast((o_orderkey % 10) as double) / 10.0 as confidence", "case when o_orderkey % 4 > 0 then 'n' || o_orderkey end as name", "o_orderkey as ord")),
    "accessed": ("part", ("'E' || (p_partkey % 40) as env_name", "'f' || (p_partkey % 90) as file")),
    "file_surfaces": ("supplier", ("'f' || (s_suppkey % 70) as file", "'S' || s_suppkey as surface")),
    "imported": ("orders", ("'f' || (o_custkey % 100) as file_uid", "case o_orderkey % 9 when 0 then 'aws-lambda' when 1 then '@aws-lambda-powertools/logger' when 2 then 'middy' else 'lodash' end as specifier")),
    "handlers": ("part", ("'P' || p_partkey as uid", "case when p_partkey % 2 = 0 then 'handler' else 'other' end as name", "case when p_size % 2 = 0 then 'export' else 'private' end as visibility", "case p_partkey % 3 when 0 then 'FUNCTION' when 1 then 'CONSTANT' else 'CLASS' end as subtype", "'f' || (p_partkey % 100) as file_uid")),
    "annotated": ("part", ("'P' || p_partkey as uid", "case when p_partkey % 2 = 0 then 'CLASS' else 'METHOD' end as subtype", "case p_partkey % 6 when 0 then 'org.springframework.stereotype.Service' when 1 then 'Bean' when 2 then 'Deprecated' when 3 then 'org.x.Bean' when 4 then 'RestController' else 'Override' end as annotation")),
    "policy_rows": ("orders", ("case when o_custkey % 7 = 0 then ' ' else 'p' || o_orderkey end as policy_id", "cast(o_custkey % 3 as int) as version", "case o_orderkey % 4 when 0 then 'line_coverage' when 1 then 'cyclomatic_complexity' when 2 then 'bogus' else 'parameter_count' end as measurement_kind", "case o_custkey % 4 when 0 then 'no_new' when 1 then 'absolute_max' when 2 then 'no_worsened' else 'absolute_min' end as policy_kind", "case when o_custkey % 5 > 0 then cast(o_custkey as double) end as threshold")),
    "typed_calls": ("orders", ("'E' || o_orderkey as edge_uid", "'P' || o_custkey as source_uid", "case when o_custkey % 6 > 0 then 'Cls' || (o_custkey % 40) end as receiver_type", "case when o_orderkey % 5 > 0 then 'm' || (o_orderkey % 12) end as method")),
    "members": ("part", ("'P' || p_partkey as uid", "case when p_partkey % 4 = 0 then 'Cls' || (p_partkey % 60) else 'm' || (p_partkey % 10) end as name", "case when p_partkey % 4 = 0 then 'CLASS' else 'METHOD' end as subtype", "'P' || (p_partkey % 50 * 4) as parent_uid")),
    "includes": ("orders", ("'E' || o_orderkey as edge_uid", "'a/b' || (o_custkey % 3) || '/x.c' as source_path", "case o_orderkey % 4 when 0 then 'h' || (o_custkey % 8) || '.h' when 1 then '../top.h' when 2 then 'sys/none.h' else 'lib/l' || (o_custkey % 3) || '.h' end as include", "o_custkey % 2 = 0 as quoted")),
    "headers": ("nation", ("case n_nationkey % 5 when 0 then 'a/b' || (n_nationkey % 3) || '/h' || (n_nationkey % 8) || '.h' when 1 then 'include/h' || (n_nationkey % 8) || '.h' when 2 then 'src/h' || (n_nationkey % 8) || '.h' when 3 then 'a/top.h' else 'lib/l' || (n_nationkey % 3) || '.h' end as path",)),
    "old_files": ("customer", ("'C' || c_custkey as file_uid", "c_custkey % 10 as size")),
    "new_files": ("customer", ("'C' || (c_custkey * 2) as file_uid", "c_custkey % 7 as size")),
    "written": ("orders", ("'C' || o_custkey as file_uid", "o_orderkey as written_at")),
    "snapshots": ("orders", ("'s' || o_orderkey as snapshot_uid", "'repo' || (o_custkey % 50) as repo_uid", "case o_orderkey % 4 when 0 then 'ready' when 1 then 'building' when 2 then 'stale' else 'lost' end as status", "'2024-01-' || (10 + o_orderkey % 20) as created_at")),
    "repos": ("customer", ("'repo' || c_custkey as repo_uid", "'name' || (c_custkey % 200) as name", "'/src/' || c_custkey as root_path")),
    "env_sources": ("part", ("'src/' || p_partkey || '.ts' as path", "'typescript' as language", "case p_partkey % 4 when 0 then 'const a = process.env.VAR_' || (p_partkey % 9) || ' ?? \"x\";' when 1 then '// process.env.HIDDEN' when 2 then 'fs.writeFileSync(\"/out/' || (p_partkey % 9) || '\", d)' else 'process.env[\"KEY_' || (p_partkey % 9) || '\"]' end as text")),
    "typed_samples": ("orders", ("case when o_custkey % 5 > 0 then 'T' || (o_custkey % 60) end as receiver_type",)),
    "raw_accesses": ("orders", ("'E' || o_orderkey as edge_uid", "'P' || o_custkey as source_uid", "case when o_orderkey % 2 = 0 then 'READS' else 'WRITES' end as type", "case o_custkey % 3 when 0 then 'K' || (o_custkey % 90) when 1 then 'tbl' || (o_custkey % 40) else 'gone' || o_custkey end as target_key")),
    "access_targets": ("part", ("'N' || p_partkey as uid", "'K' || p_partkey as stable_key", "'tbl' || (p_partkey % 60) as name", "case p_partkey % 4 when 0 then 'TABLE' when 1 then 'STATE' when 2 then 'FS_PATH' else 'SYMBOL' end as kind")),
}


def rows(g: Graph, name: str) -> DataFrame:
    source, expressions = STORED[name]
    return g.table(source).selectExpr(*expressions)


def texts(g: Graph, name: str) -> DataFrame:
    """The same for texts: a few bytes of keys hold many of them, so keys are dealt over tasks before texts are made."""
    source, expressions = STORED[name]
    keys = g.table(source)
    return graph.dealt(keys, keys.columns[0]).selectExpr(*expressions)


def ctes(*names: str) -> str:
    return ", ".join(f"{n} as (select {', '.join(STORED[n][1])} from {STORED[n][0]})" for n in names)


def stored_query(sql: str, *names: str):
    """Register a query whose SQL reads the named tables of ``STORED`` (and, if it begins with +, the projection's)."""
    if sql.startswith("+"):
        return query(f"+ {ctes(*names)}{', ' if sql[1:].lstrip().startswith('&') else ' '}{sql[1:].lstrip().removeprefix('&')}")
    return query(f"with {ctes(*names)} {sql}" if names else sql, plain=True)


# Sources


@stored_query("select doc_id, substr(sha256(text), 1, 16) as content_hash from documents")
def content_hashes(g):
    return g.table("documents").select("doc_id", files.content_hash(F.col("text")).alias("content_hash"))


@stored_query("""select path, case lower(string_split(path, '.')[-1]) when 'ts' then 'typescript' when 'tsx' then 'typescript' when 'jsx' then 'javascript' when 'java' then 'java' when 'py' then 'python' when 'rs' then 'rust' when 'h' then 'c' when 'hpp' then 'cpp' when 'cxx' then 'cpp' end as language from paths""", "paths")
def source_languages(g):
    return rows(g, "paths").select("path", paths.language(F.col("path")).alias("language"))


@query("""+ places as (select path as directory from modules where substr(uid, 2)::int % 2 = 0 union all select path from regions)
  select f.path, (select max_by(directory, length(directory)) from places where starts_with(f.path, directory || '/')) || '/package.json' as manifest from files f""")
def nearest_manifests(g):
    places = g.modules().filter(F.substring("uid", 2, 9).cast("int") % 2 == 0).select("path").unionByName(g.regions().select("path"))
    found = places.select(F.col("path").alias("directory"), F.concat("path", F.lit("/package.json")).alias("path"), F.lit("package.json").alias("name"), F.array().cast("array<string>").alias("dependencies"), F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("error"))
    return files.nearest(g.files(), found, "package.json").select("path", "manifest")


@stored_query("select file_uid, size from old_files where file_uid not in (select file_uid from new_files) union all select * from new_files", "old_files", "new_files")
def upserted_files(g):
    return incremental.upsert(rows(g, "old_files"), rows(g, "new_files"), ["file_uid"])


@stored_query("select file_uid, max(written_at) as written_at from written group by 1", "written")
def newest_writes(g):
    return store.newest(rows(g, "written"), ["file_uid"], "written_at")


DELETED = "gone as (select distinct file_uid from symbols where substr(file_uid, 2)::bigint % 20 = 0), lost as (select uid from symbols where file_uid in (select file_uid from gone))"


def _deleted(g: Graph) -> tuple[DataFrame, DataFrame]:
    gone = g.symbols().filter(F.substring("file_uid", 2, 20).cast("long") % 20 == 0).select("file_uid").distinct()
    return incremental.delete_files(g.symbols().select("uid", "file_uid"), g.calls(), gone)


@query(f"+ {DELETED} select uid, file_uid from symbols where file_uid is null or file_uid not in (select file_uid from gone)")
def nodes_after_file_deletion(g):
    return _deleted(g)[0]


@query(f"+ {DELETED} select src, dst from calls where src not in (select uid from lost) and dst not in (select uid from lost)")
def edges_after_file_deletion(g):
    return _deleted(g)[1]


@stored_query("""select json_object('command', 'stale', 'repo', 'r', 'snapshot', 's', 'stale', false, 'result', json_object('file_uid', file_uid, 'size', size))::varchar as json from old_files""", "old_files")
def json_envelopes(g):
    return store.envelope(rows(g, "old_files"), "stale", "r", "s")


@stored_query("select 'status' as \"column\", status as value, count(*) as n from snapshots where status not in ('building', 'ready', 'stale', 'failed') group by 2", "snapshots")
def values_outside_vocabulary(g):
    return schema.strangers(rows(g, "snapshots"), "snapshots")


@stored_query("select file_uid, count(*) as n from written group by 1 having count(*) > 1", "written")
def duplicate_keys(g):
    return schema.duplicates(rows(g, "written"), ["file_uid"])


@stored_query("select repo_uid, max(struct_pack(c := created_at, s := snapshot_uid)).s as snapshot_uid from snapshots where status = 'ready' group by 1", "snapshots")
def latest_snapshots(g):
    return store.latest_ready(rows(g, "snapshots"))


@stored_query("select repo_uid, name, root_path, null::varchar as default_branch, null::varchar as created_at, null::varchar as metadata_json from repos", "repos")
def migrated_repos(g):
    """Rows of an older writer in today's columns."""
    return schema.conform(rows(g, "repos"), "repos")


@stored_query("""select q.ref, r.repo_uid, r.name, r.root_path from (select 'repo' || n_nationkey as ref from nation union select 'name' || n_nationkey from nation union select '/src/' || n_nationkey from nation) q
  join repos r on r.repo_uid = q.ref or r.name = q.ref or r.root_path = q.ref""", "repos")
def repos_by_reference(g):
    n = F.col("n_nationkey").cast("string")
    asked = g.table("nation").select(F.explode(F.array(*(F.concat(F.lit(p), n) for p in ("repo", "name", "/src/")))).alias("ref"))
    return store.find_repos(asked, rows(g, "repos"))


@stored_query("+ & n as (select module_uid as snapshot_uid, count(*) as files_total from files group by 1), m as (select f.module_uid as snapshot_uid, count(*) as nodes_total from symbols s join files f on f.uid = s.file_uid group by 1) select snapshot_uid, coalesce(files_total, 0) as files_total, coalesce(nodes_total, 0) as nodes_total from n full join m using (snapshot_uid)", "versions")
def snapshot_counts(g):
    """Modules stand for snapshots."""
    own = g.files().select(F.col("uid").alias("file_uid"), F.col("module_uid").alias("snapshot_uid"))
    return store.counted({"files_total": own, "nodes_total": g.symbols().join(own, "file_uid")})


# Declarations


@stored_query("select declaration_uid, regexp_extract(target_stable_key, '^[^:]*:(.*):MODULE$', 1) as source, json_extract_string(value_json, '$.forbids') as target, json_extract_string(value_json, '$.reason') as reason from decl where is_active and kind = 'boundary' and json_extract_string(value_json, '$.forbids') is not null and target_stable_key like '%:MODULE'", "decl")
def boundary_declarations(g):
    return stored.boundary_declarations(rows(g, "decl"))


SELECTED = "s as (select *, json_extract_string(value_json, '$.source.canonicalRootPath') as source, json_extract_string(value_json, '$.forbids.canonicalRootPath') as target from decl where is_active and kind = 'boundary' and json_extract_string(value_json, '$.selectorDomain') is not null)"


@stored_query(f", {SELECTED} select declaration_uid, source, target, json_extract_string(value_json, '$.reason') as reason from s where source is not null and target is not null", "decl")
def selector_boundaries(g):
    return stored.selector_boundaries(rows(g, "decl"))[0]


@stored_query(f", {SELECTED} select declaration_uid, value_json from s where source is null or target is null", "decl")
def unreadable_selector_boundaries(g):
    return stored.selector_boundaries(rows(g, "decl"))[1]


OBLIGATIONS = """o as (select declaration_uid, json_extract_string(value_json, '$.req_id') as req_id, json_extract_string(value_json, '$.version')::int as version, unnest(json_extract(value_json, '$.verification[*]')) as v from decl where is_active and kind = 'requirement'),
req as (select declaration_uid, req_id, version, json_extract_string(v, '$.obligation_id') as obligation_id, json_extract_string(v, '$.obligation') as obligation, json_extract_string(v, '$.method') as method, json_extract_string(v, '$.target') as target, json_extract_string(v, '$.threshold')::double as threshold, json_extract_string(v, '$.operator') as operator from o)"""


@stored_query(f", {OBLIGATIONS} select * from req", "decl")
def requirement_obligations(g):
    return stored.requirements(rows(g, "decl"))


@stored_query(f", {OBLIGATIONS} select * replace (coalesce(obligation_id, 'obl-' || substr(sha256(concat_ws('|', req_id, obligation, method, target, threshold::varchar, operator)), 1, 12)) as obligation_id) from req", "decl")
def backfilled_obligation_ids(g):
    return stored.with_obligation_ids(stored.requirements(rows(g, "decl")))


@stored_query(f""", {OBLIGATIONS}, k as (select *, sha256(concat_ws('|', coalesce(obligation, ''), coalesce(method, ''), coalesce(target, ''), coalesce(threshold::varchar, ''), coalesce(operator, ''))) as key from req),
  prior as (select key, min(obligation_id) as id from k where version = 1 group by 1) select declaration_uid, obligation, coalesce(id, substr(key, 1, 16)) as obligation_id from k left join prior using (key) where version = 2""", "decl")
def inherited_obligation_ids(g):
    found = stored.requirements(rows(g, "decl"))
    return declarations.inherit_obligations(found.filter("version = 1"), found.filter("version = 2")).select("declaration_uid", "obligation", "obligation_id")


@stored_query("select declaration_uid, json_extract_string(value_json, '$.policy_id') as policy_id, json_extract_string(value_json, '$.version')::int as version, json_extract_string(value_json, '$.threshold')::double as threshold, json_extract_string(value_json, '$.severity') as severity from decl where is_active and kind = 'quality_policy'", "decl")
def active_quality_policies(g):
    return stored.policies(rows(g, "decl")).select("declaration_uid", "policy_id", "version", "threshold", "severity")


@stored_query("select declaration_uid, value_json from decl where is_active and kind = 'boundary' and json_extract_string(value_json, '$.forbids') is null", "decl")
def unreadable_declarations(g):
    return stored.unreadable(rows(g, "decl"), "boundary", ("forbids",))


@stored_query(", old as (select * from decl where substr(declaration_uid, 2)::bigint % 3 > 0) select * from old union all select * from decl where declaration_uid not in (select declaration_uid from old)", "decl")
def inserted_declarations(g):
    """A third is new, and comes twice; what is stored already isn't stored again."""
    every = rows(g, "decl")
    return declarations.insert(every.filter(F.substring("declaration_uid", 2, 20).cast("long") % 3 > 0), every.unionByName(every))


@stored_query("select declaration_uid, substr(sha256(concat_ws('|', kind, target_stable_key, coalesce(value_json, ''))), 1, 32) as identity from decl", "decl")
def declaration_identities(g):
    return rows(g, "decl").select("declaration_uid", declarations.identity(F.col("kind"), F.col("target_stable_key"), F.col("value_json")).alias("identity"))


@stored_query("select target_stable_key, regexp_extract(target_stable_key, '^[^:]*:(.*):MODULE$', 1) as path, 'repo:' || replace(split_part(target_stable_key, ':', 2), 'mod', 'm') || ':MODULE' as module_key from (select distinct target_stable_key from decl)", "decl")
def module_keys(g):
    key = F.col("target_stable_key")
    path = F.replace(F.split_part(key, F.lit(":"), F.lit(2)), F.lit("mod"), F.lit("m"))
    return rows(g, "decl").select("target_stable_key").distinct().select("target_stable_key", paths.module_of_key(key).alias("path"), paths.module_key(F.lit("repo"), path).alias("module_key"))


@stored_query("""select policy_id, version, list_filter([case when trim(policy_id) = '' then 'empty_policy_id' end, case when version <= 0 then 'bad_version' end, case when measurement_kind = 'bogus' then 'unknown_kind' end, case when threshold is null then 'bad_threshold' end,
  case when policy_kind in ('no_new', 'no_worsened') and measurement_kind = 'line_coverage' then 'comparative_coverage' end], lambda e: e is not null)::varchar as errors from policy_rows""", "policy_rows")
def policy_validation_errors(g):
    found = quality.validation_errors(rows(g, "policy_rows"))
    return found.select("policy_id", "version", F.concat(F.lit("["), F.array_join("errors", ", "), F.lit("]")).alias("errors"))


@stored_query("select policy_uid, baseline_snapshot_uid, 's1-qpa-' || policy_uid || coalesce('-vs-' || baseline_snapshot_uid, '') as uid, assessment_uid from judged where computed_verdict = 'FAIL'", "judged")
def failed_assessments(g):
    found = stored.assessments(rows(g, "judged"), "FAIL")
    return found.select("policy_uid", "baseline_snapshot_uid", stored.assessment_uid(F.lit("s1"), F.col("policy_uid"), F.col("baseline_snapshot_uid")).alias("uid"), "assessment_uid")


@stored_query("select req_id, computed_verdict as effective, count(*) as n from judged group by 1, 2", "judged")
def obligation_report(g):
    return stored.obligation_report(rows(g, "judged").withColumnRenamed("computed_verdict", "effective"))


# Facts


@stored_query("select r.key, case when kind is null then 'not_found' when kind in ('FS_PATH', 'DB_RESOURCE', 'BLOB') or (kind = 'STATE' and coalesce(subtype, '') = 'CACHE') then 'found' else 'not_a_resource' end as status, kind from (select distinct key from resource_requests) r left join resource_nodes n on n.stable_key = r.key", "resource_requests", "resource_nodes")
def resource_resolution(g):
    return stored.resolve_resources(rows(g, "resource_requests"), rows(g, "resource_nodes"))


@stored_query("+ select snapshot_uid, file_uid, path from versions join files on uid = file_uid where parse_status = 'stale'", "versions")
def stale_files(g):
    return stored.stale_files(rows(g, "versions"), g.files().withColumnRenamed("uid", "file_uid"))


@stored_query("select *, try_cast(json_extract_string(value_json, '$.normalized_score') as double) as normalized_score from scores where kind = 'hotspot_score'", "scores")
def inferences_by_kind(g):
    return stored.inferences(rows(g, "scores"), "hotspot_score")


@stored_query("select * from providers where mechanism = 'http' and framework = 'express'", "providers")
def provider_facts(g):
    return stored.facts(rows(g, "providers"), mechanism="http", framework="express", source_file=None)


@stored_query("select * from doc_facts where fact_kind = 'deprecated_by'", "doc_facts")
def semantic_facts_by_kind(g):
    return stored.semantic_facts(rows(g, "doc_facts"), "deprecated_by")


@stored_query("select fact_kind, count(*) as n from doc_facts group by 1", "doc_facts")
def semantic_fact_counts(g):
    return stored.counts(rows(g, "doc_facts"), "fact_kind")


@query("select type, count(*) as n from accesses group by 1")
def edge_counts_by_type(g):
    return stored.counts(g.accesses(), "type")


@stored_query("select project_surface_uid, count(*) as n from surface_evidence group by 1", "surface_evidence")
def evidence_counts_by_surface(g):
    return stored.counts(rows(g, "surface_evidence"), "project_surface_uid")


@stored_query("select kind, count(*) as n from decl where is_active group by 1", "decl")
def active_declaration_counts(g):
    return stored.counts(rows(g, "decl").filter("is_active"), "kind")


@stored_query(""", v as (select target_stable_key, kind, coalesce(json_extract_string(value_json, '$.value'), json_extract_string(value_json, '$.name')) as x from package_facts where kind in ('package_name', 'package_version'))
  select target_stable_key, max(x) filter (kind = 'package_name') as package_name, max(x) filter (kind = 'package_version') as package_version from v group by 1""", "package_facts")
def domain_versions(g):
    return stored.domain_versions(rows(g, "package_facts"))


@stored_query(""", hit as (select stable_key as q, 1 as step, stable_key as k from doc_nodes union select regexp_extract(stable_key, '^[^:]*:(.*):(?:FILE|MODULE)$', 1), 2, stable_key from doc_nodes where kind in ('FILE', 'MODULE') union select name, 3, stable_key from doc_nodes where kind = 'MODULE'),
  per as (select r.query, h.step, count(h.k) as n, string_agg(h.k, ',' order by h.k) as keys from (select distinct query from doc_requests) r left join hit h on h.q = r.query group by 1, 2), best as (select *, row_number() over (partition by query order by step) as o from per)
  select query, case n when 0 then 'not_found' when 1 then 'found' else 'ambiguous' end as status, step, coalesce(keys, '') as keys from best where o = 1""", "doc_requests", "doc_nodes")
def docs_target_resolution(g):
    return stored.docs_target(rows(g, "doc_requests"), rows(g, "doc_nodes")).withColumn("keys", F.array_join("keys", ","))


def _topology(kinds: str) -> str:
    return f"select project_surface_uid, source_path as path, max_by(evidence_kind, confidence) as kind, max(confidence) as confidence from surface_evidence where evidence_kind in ({kinds}) group by 1, 2"


@stored_query(_topology("'config_file', 'workspace_root', 'package_root'"), "surface_evidence")
def config_roots(g):
    return stored.topology(rows(g, "surface_evidence"))[0]


@stored_query(_topology("'binary_entrypoint', 'main_export', 'container_command'"), "surface_evidence")
def surface_entrypoints(g):
    return stored.topology(rows(g, "surface_evidence"))[1]


@query("select (select count(*) from calls) as edges_total, (select count(*) from unresolved) as unresolved_total, category, count(*) as n from unresolved group by category")
def extraction_diagnostics(g):
    one = stored.diagnostics(g.unresolved(), g.calls())
    return one.select("edges_total", "unresolved_total", F.explode("unresolved_breakdown").alias("category", "n"))


@query("""select m.target_uid as target, m.kind, json_extract_string(value_json, '$.value')::double as value, s.subtype as symbol_kind, f.path as file, regexp_extract(f.path, '^(.*)/[^/]*$', 1) as module
  from measurements m left join symbols s on s.uid = m.target_uid left join files f on f.uid = s.file_uid where kind in ('cyclomatic_complexity', 'parameter_count')""")
def enriched_measurements(g):
    nodes = g.symbols().withColumnRenamed("uid", "stable_key")
    return stored.measured_facts(g.measurements().withColumnRenamed("target_uid", "target_stable_key"), nodes, g.files().withColumnRenamed("uid", "file_uid"), ("cyclomatic_complexity", "parameter_count")).select("target", "kind", "value", "symbol_kind", "file", "module")


# Liveness


@stored_query("""select uid, case when decorator in ('@pytest.fixture(scope=x)', 'fixture') then 'pytest_fixture' else 'pytest_test' end as kind from functions
  where decorator in ('@pytest.fixture(scope=x)', 'fixture') or (path in ('t/test_a.py', 't/conftest.py') and (name like 'test^_%' escape '^' or regexp_matches(name, '^Test[A-Z]')))""", "functions")
def pytest_liveness(g):
    return stored.pytest_items(rows(g, "functions").withColumn("decorators", F.array("decorator")))


@stored_query("select 'P' || p_partkey as uid, ['module_init', 'SYSCALL_DEFINE3', 'EXPORT_SYMBOL_GPL'][(p_partkey % 5 + 1)::int] as pattern, 'linux_system_managed' as kind from part where p_partkey % 5 < 3")
def linux_liveness(g):
    return stored.linux_managed(rows(g, "macro_sources"), rows(g, "macro_symbols"))


@stored_query("select uid, 'framework_entrypoint' as kind, 0.9::double as confidence from handlers where name = 'handler' and visibility = 'export' and subtype in ('FUNCTION', 'CONSTANT') and file_uid in (select file_uid from imported where specifier <> 'lodash')", "handlers", "imported")
def serverless_entrypoints(g):
    return resolve.handler_entrypoints(rows(g, "imported"), rows(g, "handlers"))


@stored_query("""select uid, string_split(annotation, '.')[-1] as annotation, 'spring_container_managed' as kind, 0.95::double as confidence from annotated
  where (subtype = 'CLASS' and string_split(annotation, '.')[-1] in ('Service', 'RestController')) or (subtype = 'METHOD' and string_split(annotation, '.')[-1] = 'Bean')""", "annotated")
def spring_liveness(g):
    return resolve.container_managed(rows(g, "annotated").withColumn("annotations", F.array("annotation")).drop("annotation"))


@query("""select s.uid, s.name, s.subtype, f.path as file, line_end - line_start + 1 as line_count, coalesce(f.is_test, false) as is_test from symbols s left join files f on f.uid = s.file_uid where s.uid not in (select dst from calls) and line_end - line_start + 1 >= 20""")
def dead_nodes_of_length(g):
    return graph.dead_nodes(g.symbols(), g.calls(), g.files(), min_lines=20)


# Resources, surfaces and commands

MATCHED = """bound as (select *, case symbol when 'readFile' then 'read' else 'write' end as direction from callsites c where module is not null and symbol <> 'stat' and not (module = 'fs/promises' and symbol like '%Sync') and exists (select 1 from file_modules m where m.file_uid = c.file_uid and m.module = c.module))"""


def _bound(g: Graph) -> DataFrame:
    return state.matched(rows(g, "callsites"), rows(g, "file_modules"), state.bindings(g.spark))


@stored_query(f", {MATCHED} select edge_uid, source_uid, module, symbol, 'fs' as resource_kind, direction from bound", "callsites", "file_modules")
def state_bindings(g):
    return _bound(g).select("edge_uid", "source_uid", "module", "symbol", "resource_kind", "direction")


@stored_query(f", {MATCHED} select distinct 'r:fs:' || logical_name || ':FS_PATH' as key, 'FS_PATH' as kind, logical_name as name from bound where logical_name <> ''", "callsites", "file_modules")
def resource_nodes(g):
    return state.emitted(_bound(g), "r")[0]


@stored_query(f", {MATCHED} select source_uid, 'r:fs:' || logical_name || ':FS_PATH' as target_key, case direction when 'read' then 'READS' else 'WRITES' end as type, case when literal then 'static' else 'inferred' end as resolution from bound where logical_name <> ''", "callsites", "file_modules")
def resource_edges(g):
    return state.emitted(_bound(g), "r")[1]


@stored_query("""select r.edge_uid, r.type, coalesce(k.uid, n.uid) as target_uid from raw_accesses r left join access_targets k on k.stable_key = r.target_key and k.kind <> 'SYMBOL'
  left join (select name, min(uid) as uid from access_targets where kind <> 'SYMBOL' group by 1 having count(*) = 1) n on n.name = r.target_key""", "raw_accesses", "access_targets")
def resolved_accesses(g):
    return resolve.resolve_accesses(rows(g, "raw_accesses"), rows(g, "access_targets")).select("edge_uid", "type", "target_uid")


@stored_query("""select source, ord, command from (select 's' || p_partkey as source, unnest(case p_partkey % 4 when 0 then [{'ord': 0, 'command': 'npm run build' || p_partkey}, {'ord': 1, 'command': 'jest --ci'}] when 1 then [{'ord': 0, 'command': 'make -j'}]
  when 2 then [{'ord': 0, 'command': 'cargo test'}] else [{'ord': 0, 'command': 'tsc -p ' || p_partkey}, {'ord': 1, 'command': 'node x.js'}] end, recursive := true) from part)""")
def shell_commands(g):
    return detectors.shell_commands(rows(g, "scripts"))


@stored_query("""select target, kind, line, file, case kind when 'module_readme' then 1 when 'file_header_comment' then 2 when 'jsdoc_block' then 3 when 'docstring' then 4 when 'package_description' then 5 else 6 end as rank
  from (select *, row_number() over (partition by target, kind order by line, file) as n from notes) where n = 1""", "notes")
def annotations_by_target(g):
    return detectors.annotations_by_target(rows(g, "notes"))


@stored_query("select uid, root, kind, name from surface_rows where kind = 'cli' and module = 'm0'", "surface_rows")
def surfaces_filtered(g):
    return detectors.surfaces(rows(g, "surface_rows"), kind="cli", module="m0").select("uid", "root", "kind", "name")


@stored_query(""", hit as (select q.query, s.uid, case when s.uid = q.query then 1 when length(q.query) >= 4 and starts_with(s.uid, q.query) then 2 when s.key = q.query then 3 else 4 end as step from (select distinct query from surface_requests) q
    left join surface_rows s on s.uid = q.query or (length(q.query) >= 4 and starts_with(s.uid, q.query)) or s.key = q.query or s.name = q.query),
  per as (select query, step, count(uid) as n, min(uid) as uid from hit group by 1, 2), best as (select *, row_number() over (partition by query order by step) as o from per)
  select query, case n when 0 then 'not_found' when 1 then 'found' else 'ambiguous' end as status, case when n = 1 then uid end as uid from best where o = 1""", "surface_requests", "surface_rows")
def surface_resolution(g):
    return detectors.resolve_surface(rows(g, "surface_requests"), rows(g, "surface_rows"))


@stored_query("""select root, kind, name, first(detail order by confidence desc, source) as entrypoint, max(confidence) as confidence, string_agg(distinct source, ',' order by source) as sources from surface_rows group by 1, 2, 3""", "surface_rows")
def merged_surfaces(g):
    """Of surfaces with equal confidence and source the first supplier's is the entry point."""
    first = rows(g, "surface_rows").withColumn("ord", F.substring("uid", 4, 20).cast("long"))
    return discovery.merged_surfaces(first).withColumn("sources", F.array_join("sources", ","))


@stored_query(""", p as (select *, case when trim(regexp_replace(root, '^\\./|/+$', '', 'g')) = '' then '.' else regexp_replace(root, '^\\./|/+$', '', 'g') end as path, case kind when 'declared' then 0 when 'operational' then 1 else 2 end as r from found_roots)
  select path as root, min_by(kind, r) as kind, max(confidence) as confidence, min_by(name, ord) filter (name is not null) as name, count(*) as evidence from p group by 1""", "found_roots")
def discovered_modules(g):
    return modules.discover(rows(g, "found_roots"))


@stored_query("select a.env_name, a.file, s.surface from accessed a left join file_surfaces s on s.file = a.file", "accessed", "file_surfaces")
def env_surface_links(g):
    return seams.link(rows(g, "accessed"), rows(g, "file_surfaces")).select("env_name", "file", "surface")


@stored_query("""select path, family, 1::bigint as line, value, kind from (select 'src/' || p_partkey || '.ts' as path, case p_partkey % 4 when 2 then 'fs' else 'env' end as family,
  case p_partkey % 4 when 0 then 'VAR_' || (p_partkey % 9) when 2 then '/out/' || (p_partkey % 9) else 'KEY_' || (p_partkey % 9) end as value, case p_partkey % 4 when 0 then 'optional' when 2 then 'write_file' else 'unknown' end as kind from part where p_partkey % 4 <> 1)""")
def env_and_fs_detectors(g):
    return detectors.detect_all(rows(g, "env_sources")).select("path", "family", "line", "value", "kind")


@stored_query("select doc_id, case when starts_with(p, 'map') or (doc_id % 3 = 1) then true else false end as generated from (select doc_id, case when doc_id % 5 = 0 then 'map.md' else 'x.md' end as p from documents)")
def generated_documents(g):
    path = F.when(F.col("doc_id") % 5 == 0, "a/MAP.md").otherwise("a/x.md")
    text = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("---\ntitle: x\nGenerated: true\n---\n"), F.coalesce("text", F.lit("")))).otherwise(F.concat(F.lit("body\n"), F.coalesce("text", F.lit(""))))
    return g.table("documents").select("doc_id", docs.generated(path, text).alias("generated"))


# Resolution


@stored_query(""", c as (select name, count(*) as n, min(uid) as uid from members where subtype = 'CLASS' group by 1), m as (select parent_uid, name, count(*) as n, min(uid) as uid from members where subtype = 'METHOD' group by 1, 2),
  j as (select t.*, m.uid as target, case when receiver_type is null then 'no_receiver_type' when method is null then 'no_method' when c.n is null then 'class_not_found' when c.n > 1 then 'class_ambiguous' when m.n is null then 'method_not_found' when m.n > 1 then 'method_ambiguous' end as skip
    from typed_calls t left join c on c.name = t.receiver_type left join m on m.parent_uid = c.uid and m.name = t.method)
  select edge_uid, source_uid, case when skip is null then target end as target_uid, skip from j""", "typed_calls", "members")
def promoted_edges(g):
    return resolve.promote_edges(rows(g, "typed_calls"), rows(g, "members"))


@stored_query(""", tried as (select edge_uid, 0 as rank, case when include = '../top.h' then 'a/top.h' else regexp_replace(source_path, '/[^/]*$', '') || '/' || include end as c from includes where quoted
    union select edge_uid, 1, case when include = '../top.h' then 'top.h' else r || include end from includes, (values (''), ('include/'), ('src/')) t(r)),
  hit as (select t.*, min(rank) over (partition by edge_uid) as best from tried t where c in (select path from headers)), per as (select edge_uid, count(distinct c) as n, min(c) as c from hit where rank = best group by 1)
  select i.edge_uid, i.include, case when n = 1 then c end as target, case when n is null then 'unresolved' when n = 1 then 'resolved' else 'ambiguous' end as status from includes i left join per p on p.edge_uid = i.edge_uid""", "includes", "headers")
def resolved_includes(g):
    return resolve.resolve_includes(rows(g, "includes"), rows(g, "headers").distinct())


@stored_query("select receiver_type, count(*) as n from typed_samples where receiver_type is not null group by 1 order by n desc, receiver_type limit 15", "typed_samples")
def enrichment_top_types(g):
    """A report of the first 15."""
    return reports.top_types(rows(g, "typed_samples"))


@query("select f.path, count(*) as symbols, printf('%.1f%%', 100.0 * count(*) filter (visibility = 'export') / count(*)) as exported from symbols s join files f on f.uid = s.file_uid group by 1")
def exported_share(g):
    joined = g.symbols().join(g.files().select(F.col("uid").alias("file_uid"), "path"), "file_uid")
    return joined.groupBy("path").agg(F.count("*").alias("symbols"), reports.percent(F.count(F.when(F.col("visibility") == "export", 1)), F.count("*")).alias("exported"))


@query("select s.uid as query, s.uid || ' ' || s.name || ' (' || s.subtype || ')' || coalesce(' ' || f.path || ':' || s.line_start, '') as line from symbols s left join files f on f.uid = s.file_uid")
def node_listing(g):
    nodes = g.symbols().join(g.files().select(F.col("uid").alias("file_uid"), F.col("path").alias("file")), "file_uid", "left")
    return nodes.select(F.col("uid").alias("query"), reports.node_line().alias("line"))


@stored_query("""select assessment_uid, case when w then 'WAIVED' else computed_verdict end as effective_verdict from (select *, req_id in ('REQ-1', 'REQ-2') as w from judged)""", "judged")
def effective_verdicts(g):
    waived = g.spark.createDataFrame([("REQ-1",), ("REQ-2",)], "req_id string")
    return reports.effective(rows(g, "judged"), waived, "computed_verdict").select("assessment_uid", "effective_verdict")


@stored_query("""select doc_id, case when octet_length(encode(coalesce(text, ''))) > 1024 then true else false end as truncated from documents""")
def truncated_annotations(g):
    return g.table("documents").select("doc_id", reports.clipped(F.coalesce("text", F.lit("")), 1024)["truncated"].alias("truncated"))
