"""Queries of rules on paths, documents, commands, waivers and declarations, over rows that the given tables yield.

As in ``stored_catalogue``, expressions that Spark and DuckDB read alike make the rows from the relational tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths
from ..operators import boundary, declarations, docs, gate, modules, resolve
from .catalogue import NOW, ORACLE_SQL, WAIVERS
from .stored_catalogue import STORED, rows, stored_query

_K = "(doc_id % 50)"
STORED |= {
    "waivers": ("orders", (
        "'w' || o_orderkey as waiver_id", "'REQ-' || (o_custkey % 20) as req_id", "cast(o_custkey % 3 as int) as version", "'o' || (o_orderkey % 4) as obligation_id", "o_orderkey % 5 <> 0 as is_active",
        "case o_orderkey % 3 when 1 then '2030-01-01T00:00:00Z' when 2 then '2020-01-01T00:00:00Z' end as expires_at", "'2024-01-' || (10 + o_orderkey % 7) as created_at",
    )),
    "import_sources": ("part", ("'F' || p_partkey as uid", """case p_partkey % 6 when 0 then 'm' || (p_partkey % 40) || '/f' || p_partkey || '.ts' when 1 then 'm' || ((p_partkey - 1) % 40) || '/f' || (p_partkey - 1) || '.js' when 2 then 'lib' || p_partkey || '/index.ts'
        when 3 then 'pkg' || p_partkey || '/__init__.py' when 4 then 'top' || p_partkey || '.tsx' else 'm' || (p_partkey % 40) || '/sub/f' || p_partkey || '.rs' end as path""")),
    "import_edges": ("orders", ("'E' || o_orderkey as edge_uid", "'m' || (o_custkey % 40) || '/sub/s' || o_custkey || '.ts' as source_path", """case o_orderkey % 7 when 0 then '../f' || o_custkey when 1 then './f' || o_custkey || '.rs' when 2 then 'lib' || o_custkey
        when 3 then '../../pkg' || o_custkey when 4 then '../../../top' || o_custkey when 5 then 'm' || (o_custkey % 40) || '/f' || o_custkey || '.ts' else './/gone/./' || o_custkey end as specifier""")),
    "cli_providers": ("part", ("'V' || p_partkey as uid", "case p_partkey % 4 when 0 then 'Build Docs ' || p_partkey when 1 then 'run tests ' || p_partkey when 2 then 'lint-' || p_partkey else ' Deploy  prod ' || p_partkey end as address")),
    "cli_consumers": ("orders", ("'D' || o_orderkey as uid", """case o_orderkey % 6 when 0 then 'build docs ' || o_custkey when 1 then 'npm run  tests ' || o_custkey when 2 then ' LINT-' || o_custkey when 3 then 'tool deploy  prod ' || o_custkey
        when 4 then 'deploy  PROD ' || o_custkey else 'npm nothing ' || o_custkey end as address""", "cast((o_orderkey % 10) as double) / 10.0 as confidence")),
    "found_surfaces": ("orders", ("'R/' || (o_custkey % 300) as root", "case o_orderkey % 5 when 0 then 'cli' when 1 then 'backend_service' when 2 then 'web_app' when 3 then 'worker' else 'library' end as kind", "cast((o_orderkey % 100) as double) / 100.0 as confidence")),
    "taken_roots": ("supplier", ("'R/' || (s_suppkey * 3) as root",)),
    # The whole text of a document below lines that state facts, or seem to.
    "stated": ("documents", (
        "coalesce(source, 'none') || '/' || doc_id || case when doc_id % 7 = 1 then '/MAP.md' else '/README.md' end as path", "'mod-' || (doc_id % 40) as subject", "doc_id % 7 = 1 as generated",
        f"""case doc_id % 10 when 0 then 'lib-' || doc_id || ' replaces old_' || {_K} || ' and pkg/' || doc_id || ' is a replacement for x-' || {_K} || '.' when 1 then 'This supersedes `core/' || {_K} || '`'
          when 2 then 'deprecated in favor of pkg/' || {_K} || '; use new_api-' || doc_id || ' instead.' when 3 then 'Foo-' || {_K} || ' and Baz-' || doc_id || ' are alternatives, migrate from lib-' || {_K} || ' to Lib' || doc_id
          when 4 then '```' || chr(10) || 'x-1 replaces y-1' || chr(10) || '```' || chr(10) || 'an alternative to z-' || doc_id when 5 then '| a-b replaces c-d |' || chr(10) || 'migration from MyOld' || {_K} || ' to MyNew' || doc_id
          when 6 then '<!-- rg:replaces old/' || {_K} || ' --> <!-- rg:owner team ' || doc_id || ' -->' || chr(10) || '<!-- rg:empty   -->' || chr(10) || 'x <!--rg:note of a/b-->' when 7 then 'use file instead of mod-' || {_K} || chr(10) || 'value replaces values'
          when 8 then 'value-' || {_K} || ' replaces value-' || (doc_id % 100) else '~~~' || chr(10) || 'q-1 replaces r-1' end || chr(10) || text as text""",
    )),
    "rated": ("documents", ("doc_id", "case doc_id % 4 when 0 then 'explicit_marker' when 1 then 'frontmatter' when 2 then 'config_parse' else 'keyword_pattern' end as method", "doc_id % 7 = 1 as generated")),
    "raw_paths": ("orders", ("o_orderkey as id", """case o_orderkey % 8 when 0 then 'a/./b' || o_custkey when 1 then 'a/../b' || o_custkey when 2 then '../a' || o_custkey when 3 then 'a//b' || o_custkey || '/' when 4 then 'a/b/../../c/d' || o_custkey
        when 5 then '../../x/../..' when 6 then 'a/b' || o_custkey || '/..' else '' end as raw""")),
    "specifiers": ("orders", ("o_orderkey as id", "case o_orderkey % 6 when 0 then '@app/core' || o_custkey when 1 then '@lib' when 2 then 'lodash' || o_custkey when 3 then '@library' when 4 then '@app' else '@app/' end as specifier")),
    # Chains of up to 149 links; some begin at a declaration that isn't stored, some run in a ring.
    "superseding": ("orders", ("'D' || o_orderkey as declaration_uid", "case when o_orderkey % 450 = 0 then 'D' || (o_orderkey + 3) when o_orderkey % 600 = 150 then 'gone' when o_orderkey % 150 <> 0 then 'D' || (o_orderkey - 1) end as supersedes_uid")),
}


def _list_path(x: str) -> str:
    """A path without empty, ``.`` and ``..`` segments, in SQL."""
    return f"array_to_string(list_reduce(list_prepend([]::varchar[], list_transform(string_split({x}, '/'), lambda s: [s])), lambda a, s: case when s[1] in ('', '.') then a when s[1] = '..' then a[1:len(a) - 1] else list_concat(a, s) end), '/')"


# Paths and names


@stored_query(f"select id, raw, {_list_path('raw')} as path from raw_paths", "raw_paths")
def relative_path_resolve(g):
    return rows(g, "raw_paths").withColumn("path", paths.resolve_relative(F.col("raw")))


@stored_query("select id, specifier, starts_with(specifier, '@app/') or specifier = '@lib' as matched from specifiers", "specifiers")
def alias_match(g):
    return rows(g, "specifiers").withColumn("matched", paths.alias_matches(F.col("specifier"), F.array(F.lit("@app/*"), F.lit("@lib"), F.lit("*"))))


@stored_query(f""", keys as (select uid, path, path as key, 0 as rank from import_sources union all select uid, path, regexp_replace(path, '\\.(ts|tsx|js|jsx|py)$', ''), 1 from import_sources where regexp_matches(path, '\\.(ts|tsx|js|jsx|py)$')
    union all select uid, path, regexp_extract(path, '^(.*)/(?:index\\.tsx?|__init__\\.py)$', 1), 1 from import_sources where regexp_matches(path, '/(index\\.tsx?|__init__\\.py)$')),
  best as (select key, arg_min(uid, (rank, path)) as uid from keys group by 1),
  e as (select *, case when starts_with(specifier, '.') then {_list_path("regexp_extract(source_path, '^(.*)/[^/]*$', 1) || '/' || specifier")} else specifier end as key from import_edges)
  select edge_uid, source_path, specifier, e.key, b.uid as target_uid, b.uid is not null as resolved from e left join best b on b.key = e.key""", "import_edges", "import_sources")
def resolve_imports(g):
    return resolve.resolve_imports(rows(g, "import_edges"), rows(g, "import_sources"))


@stored_query(""", p as (select uid as provider, trim(lower(address)) as key from cli_providers), c as (select uid as consumer, confidence, trim(lower(address)) as key from cli_consumers),
  w as (select *, regexp_split_to_array(key, '\\s+') as words from c where key not in (select key from p))
  select provider, consumer, 'address_match' as basis, confidence * 0.9::double as confidence from c join p using (key)
  union all select provider, consumer, 'heuristic', confidence * 0.75::double from w join p on p.key = array_to_string(w.words[2:], ' ') where len(words) >= 3""", "cli_providers", "cli_consumers")
def cli_boundary_links(g):
    return boundary.match_cli(rows(g, "cli_providers"), rows(g, "cli_consumers"))


@stored_query("""select root, least(max(confidence), 0.85::double) as confidence, count(*) as surfaces from found_surfaces where kind <> 'library' and confidence >= 0.7::double and root not in (select root from taken_roots) group by 1""", "found_surfaces", "taken_roots")
def promoted_modules(g):
    return modules.promote_surfaces(rows(g, "found_surfaces"), rows(g, "taken_roots"))


# Documents

_LINES = "l0 as (select path, subject, generated, unnest(string_split(text, chr(10))) as x, generate_subscripts(string_split(text, chr(10)), 1)::bigint as line from stated)"
_QUOTED = docs._EDGES.replace("'", "''")
_HITS = " union all ".join(
    f"select path, line, subject as own, generated, '{kind}' as fact_kind, {f'''unnest(regexp_extract_all(x, '{regex}', {s}))''' if s else 'null::varchar'} as s, unnest(regexp_extract_all(x, '{regex}', {o})) as o from kept" for regex, kind, s, o in docs.PATTERNS
)
_MODULE_LIKE = "({0} = '.' or regexp_matches({0}, '[/@_-]|::') or (regexp_matches({0}, '[A-Z]') and regexp_matches({0}, '[a-z]')) or regexp_matches({0}, '^[A-Z][A-Z0-9]{{1,5}}$'))"
_STOP = ", ".join(f"'{w}'" for w in docs.STOP_WORDS)


@stored_query(f""", {_LINES}, l1 as (select *, starts_with(trim(x, ' '), '```') or starts_with(trim(x, ' '), '~~~') as fence from l0),
  l2 as (select *, count(*) filter (fence) over (partition by path order by line) as n from l1), kept as (select * from l2 where not fence and n % 2 = 0 and not starts_with(trim(x, ' '), '|')),
  hits as ({_HITS}), clean as (select *, coalesce(regexp_replace(regexp_replace(s, '^{_QUOTED}+', ''), '{_QUOTED}+$', ''), own) as subject, regexp_replace(regexp_replace(o, '^{_QUOTED}+', ''), '{_QUOTED}+$', '') as object from hits)
  select path, line, fact_kind, subject, object, case when generated then 0.7::double * 0.8::double else 0.7::double end as confidence from clean
  where subject <> object and lower(subject) not in ({_STOP}) and lower(object) not in ({_STOP}) and (length(subject) >= 2 or subject = '.') and {_MODULE_LIKE.format('subject')} and {_MODULE_LIKE.format('object')}""", "stated")
def keyword_facts(g):
    return docs.keyword_facts(rows(g, "stated"))


@stored_query(rf""", {_LINES}, m as (select path, line, unnest(regexp_extract_all(x, '<!--\s*rg:(\S+)\s+(.+?)\s*-->', 1)) as directive, unnest(regexp_extract_all(x, '<!--\s*rg:(\S+)\s+(.+?)\s*-->', 2)) as argument from l0 where contains(x, 'rg:'))
  select * from m where trim(argument, ' ') <> ''""", "stated")
def marker_facts(g):
    return docs.marker_facts(rows(g, "stated"))


@stored_query("select *, case method when 'explicit_marker' then 0.95::double when 'keyword_pattern' then 0.7::double else 0.9::double end * case when generated then 0.8::double else 1::double end as confidence from rated", "rated")
def fact_confidence(g):
    return rows(g, "rated").withColumn("confidence", docs.confidence(F.col("method"), F.col("generated")))


# Waivers and declarations


@stored_query(f", {WAIVERS} select waiver_id, req_id, version, obligation_id from active", "waivers")
def waivers_active(g):
    return gate.active_waivers(rows(g, "waivers"), NOW).select("waiver_id", "req_id", "version", "obligation_id")


@stored_query("select kind, count(*) as n, count(*) filter (is_active) as active from decl group by 1", "decl")
def active_declarations(g):
    return rows(g, "decl").groupBy("kind").agg(F.count("*").alias("n"), F.count(F.when(F.col("is_active"), 1)).alias("active"))


@stored_query(""", up as (select declaration_uid, declaration_uid as root_uid, 0::bigint as depth from superseding where supersedes_uid is null
  union all select d.declaration_uid, u.root_uid, u.depth + 1 from superseding d join up u on d.supersedes_uid = u.declaration_uid) select * from up""", "superseding")
def superseded_chain(g):
    return declarations.chains(rows(g, "superseding"))


ORACLE_SQL["superseded_chain"] = ORACLE_SQL["superseded_chain"].replace("with ", "with recursive ", 1)
