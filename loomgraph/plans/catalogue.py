"""The registered queries over the code graph, each with its SQL equivalent for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.numbers import half_up
from ..operators import agent, boundary, docs, gate, graph, incremental, lookup, modules, quality, resolve, seams, trust
from ..sources.projection import EARLIER, PROJECTION_SQL, Graph, Staged, projected
from ..streaming import windows
from .literals import POLICIES, table, values

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = "2025-01-01T00:00:00Z"


def query(sql: str | None = None, plain: bool = False, staged: bool = False):
    """Register a query f(g: Graph) with SQL over the projection's tables (or, if ``plain``, over the stored ones).

    ``staged``: its parts share fact tables that are written once.
    """

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            g = Graph(spark, sf_dir)
            return f(Staged(g) if staged else g)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql if plain else projected(sql)
        return f

    return register



# Shared pieces of SQL

HALF = "floor(({x}) * 100 + 0.5) / 100"
MODULE_STATS = """
+ fi as (select dst as uid, count(distinct src) as n from module_imports group by 1), fo as (select src as uid, count(distinct dst) as n from module_imports group by 1),
fc as (select module_uid as uid, count(*) as n from files group by 1),
sy as (select module_uid as uid, count(*) filter (visibility = 'export') as e, count(*) filter (subtype in ('INTERFACE', 'TYPE_ALIAS')) as a, count(*) filter (subtype in ('INTERFACE', 'TYPE_ALIAS', 'CLASS', 'ENUM')) as t
       from symbols s join files f on s.file_uid = f.uid group by 1),
x as (select m.path as module, coalesce(fi.n, 0) as fan_in, coalesce(fo.n, 0) as fan_out, fc.n as file_count, coalesce(e, 0) as symbol_count,
             case when coalesce(fi.n, 0) + coalesce(fo.n, 0) > 0 then coalesce(fo.n, 0)::double / (coalesce(fi.n, 0) + coalesce(fo.n, 0)) else 0 end as i,
             case when coalesce(t, 0) > 0 then a::double / t else 0 end as a
      from modules m join fc on fc.uid = m.uid left join fi on fi.uid = m.uid left join fo on fo.uid = m.uid left join sy on sy.uid = m.uid),
module_stats as (select module, fan_in, fan_out, floor(i * 100 + 0.5) / 100 as instability, floor(a * 100 + 0.5) / 100 as abstractness,
       floor(abs(a + i - 1) * 100 + 0.5) / 100 as distance_from_main_sequence, file_count, symbol_count from x)"""
EDGES = """
deps as (select a.module_uid as su, b.module_uid as tu, count(*) as import_count, count(distinct src) as source_file_count
         from file_imports i join files a on a.uid = i.src join files b on b.uid = i.dst where a.module_uid <> b.module_uid group by 1, 2),
dep_edges as (select su as source_uid, s.path as source, tu as target_uid, t.path as target, import_count, source_file_count from deps join modules s on s.uid = su join modules t on t.uid = tu)"""
CHURN = """
by_commit as (select "commit", file_uid, sum(added + deleted) as n from commits group by 1, 2),
churn as (select f.path, f.is_test, count(*) as commit_count, sum(n)::bigint as lines_changed from by_commit join files f on f.uid = file_uid group by 1, 2),
complexity as (select f.path, sum(json_extract_string(value_json, '$.value')::bigint)::bigint as sum_complexity from measurements m join symbols s on s.uid = m.target_uid join files f on f.uid = s.file_uid where kind = 'cyclomatic_complexity' group by 1),
hotspots as (select c.path, c.is_test, commit_count, lines_changed, sum_complexity, lines_changed * sum_complexity as hotspot_score from churn c join complexity x on x.path = c.path)"""
DEAD = """
dead as (select s.uid, s.name, s.subtype, f.path as file, line_end - line_start + 1 as line_count, coalesce(f.is_test, false) as is_test from symbols s left join files f on f.uid = s.file_uid
         where s.uid not in (select dst from calls) and s.uid not in (select target_uid from entrypoints)
           and s.uid not in (select target_uid from inferences where kind in ('framework_entrypoint', 'spring_container_managed', 'pytest_test', 'pytest_fixture', 'linux_system_managed')))"""


# Modules


def _stats(g: Graph) -> DataFrame:
    return modules.module_stats(g.modules(), g.files(), g.symbols(), g.module_imports())


def _edges(g: Graph) -> DataFrame:
    return modules.dependency_edges(g.file_imports(), g.files(), g.modules())


@query(MODULE_STATS + " select * from module_stats")
def module_stats(g):
    return _stats(g)


TRUST_STATS = """+ trust_stats as (select m.path as module, (select count(distinct src) from module_imports where dst = m.uid) as fan_in, (select count(distinct dst) from module_imports where src = m.uid) as fan_out,
  (select count(*) from files where module_uid = m.uid) as file_count from modules m)"""


@query(TRUST_STATS + " select * from trust_stats")
def trust_module_stats(g):
    return modules.trust_stats(g.modules(), g.files(), g.module_imports())


@query(f"+ {EDGES} select * from dep_edges")
def module_dependency_edges(g):
    return _edges(g)


OWN = "own as (select uid as file_uid, case when substr(uid, 2)::bigint % 7 = 0 then null else module_uid end as module_uid from files)"


@query(f"""+ {OWN} select count(*) as imports_total, count(*) filter (a.module_uid is null) as source_unowned, count(*) filter (a.module_uid is not null and b.module_uid is null) as target_unowned,
  count(*) filter (a.module_uid = b.module_uid) as intra, count(*) filter (a.module_uid <> b.module_uid) as cross from file_imports i left join own a on a.file_uid = i.src left join own b on b.file_uid = i.dst""")
def module_edge_diagnostics(g):
    """A seventh of all files has no owner here."""
    own = g.files().select(F.col("uid").alias("file_uid"), F.when(F.substring("uid", 2, 20).cast("long") % 7 != 0, F.col("module_uid")).alias("module_uid"))
    return modules.dependency_diagnostics(g.file_imports(), own)


@query(f"""+ {EDGES}, both_ways as (select source as module, 'outbound' as direction, target as neighbour, target_uid as u, import_count from dep_edges union all select target, 'inbound', source, source_uid, import_count from dep_edges)
  select module, direction, neighbour, import_count, row_number() over (partition by module, direction order by import_count desc, u) as rank from both_ways""")
def weighted_neighbors(g):
    return modules.weighted_neighbours(_edges(g))


RULES = f"""{EDGES}, judged as (select r.source, r.target, r.reason, case when a.uid is null and b.uid is null then 'both' when a.uid is null then 'source' when b.uid is null then 'target' end as stale,
  coalesce(e.import_count, 0) as import_count, coalesce(e.source_file_count, 0) as source_file_count, e.source is not null as hit
  from rules r left join modules a on a.path = r.source left join modules b on b.path = r.target left join dep_edges e on e.source = r.source and e.target = r.target),
violations as (select source, target, reason, stale, case when stale is not null then 'stale' when hit then 'violated' else 'kept' end as status, import_count, source_file_count from judged)"""


def _rules(g: Graph) -> DataFrame:
    return modules.boundary_rules(table(g.spark, "rules"), _edges(g), g.modules())


@query(f"+ {values('rules')}, {RULES} select * from violations")
def module_boundary_violations(g):
    return _rules(g)


@query(f"+ {values('rules')}, {RULES} select source, target, stale from violations where stale is not null")
def stale_boundaries(g):
    return _rules(g).filter("stale is not null").select("source", "target", "stale")


@query(f"""+ {values('rules')}, {values('entrypoints')}, {values('inferences')}, {RULES}, {DEAD}
  select m.path as module, (select count(*) from files where module_uid = m.uid) as files, (select count(*) from files where module_uid = m.uid and is_test) as test_files,
    (select count(*) from dead d join files f on f.path = d.file where f.module_uid = m.uid and not d.is_test) as dead_symbols, (select count(*) from dead d join files f on f.path = d.file where f.module_uid = m.uid and d.is_test) as dead_test_symbols,
    (select count(*) from dep_edges where source = m.path) as outbound_modules, (select coalesce(sum(import_count), 0)::bigint from dep_edges where source = m.path) as outbound_imports,
    (select count(*) from dep_edges where target = m.path) as inbound_modules, (select coalesce(sum(import_count), 0)::bigint from dep_edges where target = m.path) as inbound_imports,
    (select count(*) from violations v where v.source = m.path and status = 'violated') as violations from modules m""", staged=True)
def module_rollups(g):
    return modules.module_rollups(g.modules(), g.files(), _edges(g), _rules(g), _dead(g).select("file", "is_test"))


PARENTS = "up as (select distinct m.parent_uid as src, i.dst from module_imports i join modules m on m.uid = i.src union select distinct i.src, m.parent_uid from module_imports i join modules m on m.uid = i.dst)"


def _with_parents(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Imports between regions and nations from those between nations; and both kinds of module."""
    parent = g.modules().select("uid", "parent_uid")
    rows = g.module_imports()
    up = rows.join(parent, F.col("src") == F.col("uid")).select(F.col("parent_uid").alias("src"), "dst").union(rows.join(parent, F.col("dst") == F.col("uid")).select("src", F.col("parent_uid").alias("dst"))).distinct()
    return up, g.modules().select("uid", "path").unionByName(g.regions())


@query(f"""+ {PARENTS}, every as (select uid, path from modules union all select uid, path from regions), two as (select distinct a.src as a, a.dst as b from up a join up b on a.src = b.dst and a.dst = b.src where a.src < a.dst)
  select case when pb.path like pa.path || '/%' then pa.path else pb.path end as ancestor, case when pb.path like pa.path || '/%' then pb.path else pa.path end as descendant from two join every pa on pa.uid = a join every pb on pb.uid = b
  where starts_with(pb.path, pa.path || '/') or starts_with(pa.path, pb.path || '/')""")
def path_prefix_module_cycles(g):
    return graph.path_prefix_cycles(*_with_parents(g))


@query("select distinct a.src as a, a.dst as b from module_imports a join module_imports b on a.src = b.dst and a.dst = b.src where a.src < a.dst")
def mutual_imports(g):
    return graph.mutual(g.module_imports())


RINGS = """rings as (select src || ',' || dst as members, 2::bigint as length from module_imports a where src < dst and exists (select 1 from module_imports b where b.src = a.dst and b.dst = a.src)
  union all select a.src || ',' || a.dst || ',' || b.dst, 3 from module_imports a join module_imports b on a.dst = b.src join module_imports c on b.dst = c.src and c.dst = a.src where a.src < a.dst and a.src < b.dst and a.dst <> b.dst)"""


@query(f"+ {RINGS} select * from rings")
def module_cycles_len3(g):
    found = graph.cycles(g.module_imports(), 3)
    return found.select(F.array_join(graph.canonical_ring(F.col("members")), ",").alias("members"), "length")


@query(f"+ {RINGS} select m as module, count(*) as cycles, min(length) as shortest from (select unnest(string_split(members, ',')) as m, length from rings) group by 1")
def cycles_involving_module(g):
    rows = graph.cycles(g.module_imports(), 3).select(F.explode("members").alias("module"), "length")
    return rows.groupBy("module").agg(F.count("*").alias("cycles"), F.min("length").alias("shortest"))


# Lookups


@query("select c.dst as key, s.uid as neighbour, s.name, s.qualified_name, s.subtype, f.path as file, s.line_start from calls c join symbols s on s.uid = c.src left join files f on f.uid = s.file_uid")
def direct_callers(g):
    return lookup.neighbours(g.calls(), g.symbols(), g.files(), "callers")


@query("select c.src as key, s.uid as neighbour, s.name, s.qualified_name, s.subtype, f.path as file, s.line_start from calls c join symbols s on s.uid = c.dst left join files f on f.uid = s.file_uid")
def direct_callees(g):
    return lookup.neighbours(g.calls(), g.symbols(), g.files(), "callees")


@query("select c.src as key, s.uid as neighbour, s.name, f.path as file, m.path as module from calls c join symbols s on s.uid = c.dst left join files f on f.uid = s.file_uid left join modules m on m.uid = f.module_uid")
def callees_with_module(g):
    found = lookup.neighbours(g.calls(), g.symbols(), g.files(), "callees")
    return lookup.with_modules(found, g.symbols(), g.files(), g.modules()).select("key", "neighbour", "name", "file", "module")


@query("select c.dst as key, coalesce(m.path, '') as module, count(*) as n from calls c join symbols s on s.uid = c.src left join files f on f.uid = s.file_uid left join modules m on m.uid = f.module_uid group by 1, 2")
def callers_by_module(g):
    found = lookup.neighbours(g.calls(), g.symbols(), g.files(), "callers")
    return agent.callers_by_module(lookup.with_modules(found, g.symbols(), g.files(), g.modules()))


@query("select s.uid, s.qualified_name, f.path as file, m.path as module from symbols s left join files f on f.uid = s.file_uid left join modules m on m.uid = f.module_uid")
def symbol_context(g):
    home = g.files().select(F.col("uid").alias("file_uid"), F.col("path").alias("file"), "module_uid").join(g.modules().select(F.col("uid").alias("module_uid"), F.col("path").alias("module")), "module_uid")
    return g.symbols().join(home, "file_uid", "left").select("uid", "qualified_name", "file", "module")


@query("select a.path as file, b.path as target, b.language, 1::bigint as depth from file_imports i join files a on a.uid = i.src join files b on b.uid = i.dst")
def file_imports(g):
    return lookup.imports_of(g.file_imports(), g.files())


@query("select distinct b.path as target from file_imports i join files b on b.uid = i.dst")
def distinct_file_imports(g):
    return lookup.imports_of(g.file_imports(), g.files()).select("target").distinct()


ACCESS = "select resource, s.uid as symbol, s.name, f.path as file from accesses a join symbols s on s.uid = a.src left join files f on f.uid = s.file_uid where a.type = '{}'"


@query(ACCESS.format("READS"))
def resource_readers(g):
    return lookup.accessors(g.accesses(), g.symbols(), g.files(), "READS")


@query(ACCESS.format("WRITES"))
def resource_writers(g):
    return lookup.accessors(g.accesses(), g.symbols(), g.files(), "WRITES")


@query("""+ asked as (select distinct q from (select uid as q from symbols where substr(uid, 2)::bigint % 100 = 0 union all select qualified_name from symbols union all select name from symbols union all select name || '?' from symbols)),
  hits as (select uid as q, uid, 1 as step from symbols union all select qualified_name, uid, 2 from symbols union all select name, uid, 3 from symbols),
  best as (select q, min(step) as step from hits group by 1)
  select a.q as query, case when b.step is null then 'not_found' when count(h.uid) = 1 then 'found' else 'ambiguous' end as status, b.step::bigint as step, count(h.uid) as n, coalesce(string_agg(h.uid, ',' order by h.uid), '') as keys
  from asked a left join best b on b.q = a.q left join hits h on h.q = a.q and h.step = b.step group by a.q, b.step""")
def symbol_resolution(g):
    """Asked: keys divisible by 100, all qualified names, all names, and as many names that don't exist."""
    s = g.symbols()
    asked = s.filter(F.substring("uid", 2, 20).cast("long") % 100 == 0).select(F.col("uid").alias("query")).union(s.select("qualified_name")).union(s.select("name")).union(s.select(F.concat("name", F.lit("?"))))
    return lookup.resolve_symbols(asked, s)


@query("""+ anc as (select array_to_string(list_slice(string_split(path, '/'), 1, k), '/') as path, uid, language from files, unnest(range(1, len(string_split(path, '/')))) t(k)),
  asked as (select path from files union select path from anc union select path || '/none' from modules)
  select a.path, f.uid is not null as is_file, b.path is not null as has_files_below, f.uid as file_key, m.uid as module_key from asked a left join files f on f.path = a.path left join (select distinct path from anc) b on b.path = a.path left join modules m on m.path = a.path""")
def path_focus(g):
    asked = g.files().select("path").union(g.files().select(F.explode(paths.ancestors(F.col("path"))))).union(g.modules().select(F.concat("path", F.lit("/none"))))
    return lookup.path_focus(asked, g.files(), g.modules())


@query("select (select count(*) from files) as files, (select count(*) from symbols where file_uid is not null) as symbols, (select string_agg(distinct language, ',' order by language) from files) as languages, (select count(*) from calls) as calls, (select count(*) from file_imports) as imports")
def repo_summary(g):
    a = g.files().agg(F.count("*").alias("files"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))
    b = g.symbols().filter("file_uid is not null").agg(F.count("*").alias("symbols"))
    out = a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(g.calls().agg(F.count("*").alias("calls")))).crossJoin(F.broadcast(g.file_imports().agg(F.count("*").alias("imports"))))
    return out.select("files", "symbols", "languages", "calls", "imports")


@query("""+ anc as (select array_to_string(list_slice(string_split(path, '/'), 1, k), '/') as path, uid, language from files, unnest(range(1, len(string_split(path, '/')))) t(k)), n as (select file_uid, count(*) as n from symbols group by 1)
  select a.path, count(distinct uid) as files, coalesce(sum(n.n), 0)::bigint as symbols, string_agg(distinct language, ',' order by language) as languages from anc a left join n on n.file_uid = a.uid group by 1""")
def path_summary(g):
    return lookup.path_summary(g.files(), g.symbols())


@query("select f.path, f.language, (select count(*) from symbols s where s.file_uid = f.uid) as symbols from files f")
def files_in_path(g):
    return lookup.files_with_counts(g.files(), g.symbols())


@query("""select array_to_string(list_slice(string_split(path, '/'), 1, k), '/') as path, count(distinct uid) as files from files, unnest(range(1, len(string_split(path, '/')))) t(k) group by 1""")
def ancestor_modules(g):
    return graph.ancestor_modules(g.files())


@query("""select r.path as source, t.path as target, a.path as source_file, b.path as target_file from file_imports i join files a on a.uid = i.src join files b on b.uid = i.dst
  join regions r on starts_with(a.path, r.path || '/') join regions t on starts_with(b.path, t.path || '/') where r.uid <> t.uid""")
def imports_between_paths(g):
    a, b = g.regions().toDF("_a", "source"), g.regions().toDF("_b", "target")
    rules = a.crossJoin(F.broadcast(b)).filter("_a <> _b").select("source", F.concat("target", F.lit("/")).alias("target"))  # five regions
    return lookup.imports_between(g.file_imports(), g.files(), rules)


@query(f"""+ {values('rules')} select r.source, r.target, a.path as source_file, b.path as target_file from file_imports i join files a on a.uid = i.src join files b on b.uid = i.dst
  join (select distinct source, target from rules) r on starts_with(a.path, r.source || '/') and starts_with(b.path, r.target || '/')""")
def declared_boundary_violations(g):
    return lookup.imports_between(g.file_imports(), g.files(), table(g.spark, "rules"))


# Dead symbols


def _dead(g: Graph) -> DataFrame:
    return graph.dead_nodes(g.symbols(), g.calls(), g.files(), table(g.spark, "entrypoints"), table(g.spark, "inferences"))


DEAD_SQL = f"+ {values('entrypoints')}, {values('inferences')}, {DEAD}"


@query(f"{DEAD_SQL} select * from dead")
def dead_nodes(g):
    return _dead(g)


@query(f"{DEAD_SQL} select d.* from dead d where starts_with(d.file, 'ASIA/') or d.file = 'ASIA'")
def dead_nodes_in_path(g):
    return lookup.in_path(_dead(g), "file", "ASIA")


# Recursion. Bounded depth, so that SQL can follow.

SEED = "seed as (select src as node from calls group by 1 order by count(*) desc, src limit 1)"


def _seed(g: Graph, calls: DataFrame | None = None) -> DataFrame:
    return (calls or g.calls()).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "node").limit(1).select("node")


def _recursive(sql: str) -> str:
    return projected(sql).replace("with ", "with recursive ", 1)


@query()
def reachable_callees(g):
    """What the symbol with most callees reaches in six steps, and in how many."""
    return graph.levels(g.calls(), _seed(g), 6)


ORACLE_SQL["reachable_callees"] = _recursive(f"+ {SEED}, walk as (select node, 0::bigint as depth from seed union select c.dst, w.depth + 1 from walk w join calls c on c.src = w.node where w.depth < 6) select node, min(depth) as depth from walk group by 1")


@query()
def transitive_callers(g):
    back = g.calls().select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.levels(back, _seed(g), 4)


ORACLE_SQL["transitive_callers"] = _recursive(f"+ {SEED}, walk as (select node, 0::bigint as depth from seed union select c.src, w.depth + 1 from walk w join calls c on c.dst = w.node where w.depth < 4) select node, min(depth) as depth from walk group by 1")


@query()
def shortest_path_length(g):
    """The smallest shortest path from the symbol with most callees to the largest key three steps away."""
    calls = graph.written(g.calls())
    seed = graph.written(_seed(g, calls))
    goal = graph.levels(calls, seed, 3, held=True).filter("depth = 3").agg(F.max("node")).first()[0]
    path = graph.shortest_path(calls, seed.first()[0], goal or "", 6, held=True)
    return g.spark.createDataFrame([(len(path) - 1, ",".join(path))] if path else [], "depth long, path string")


ORACLE_SQL["shortest_path_length"] = _recursive(f"""+ {SEED}, walk as (select node, 0::bigint as depth, node as path from seed union all select c.dst, w.depth + 1, w.path || ',' || c.dst from walk w join calls c on c.src = w.node where w.depth < 3),
  least as (select node, min(depth) as depth from walk group by 1), goal as (select max(node) as node from least where depth = 3) select w.depth, min(w.path) as path from walk w join goal g on g.node = w.node where w.depth = 3 group by 1""")


@query()
def reverse_module_imports(g):
    return graph.reverse_impact(g.module_imports(), g.modules().filter("uid = 'M0'").select(F.col("uid").alias("node")), 3)


ORACLE_SQL["reverse_module_imports"] = _recursive("+ walk as (select 'M0' as node, 0::bigint as depth union select i.src, w.depth + 1 from walk w join module_imports i on i.dst = w.node where w.depth < 3) select node, min(depth) as depth from walk group by 1")


@query()
def change_impact(g):
    """Modules of the files whose hash changed since the earlier snapshot, and all that depends on them."""
    changed = _plan(g).filter("disposition = 'changed'").select("file_uid").join(g.files().select(F.col("uid").alias("file_uid"), "module_uid"), "file_uid")
    found = graph.reverse_impact(g.module_imports(), changed.select(F.col("module_uid").alias("node")))
    return found.join(g.modules().select(F.col("uid").alias("node"), "path"), "node").select("path", "depth")


# Quality


@query(f"+ {CHURN} select * from complexity")
def complexity_by_file(g):
    return _complexity(g)


def _complexity(g: Graph) -> DataFrame:
    return quality.complexity_by_file(g.measurements(), g.symbols(), g.files())


FUNCTIONS = """functions as (select s.uid, s.name, f.path as file, max(v) filter (kind = 'cyclomatic_complexity') as complexity, max(v) filter (kind = 'parameter_count') as parameters, max(v) filter (kind = 'max_nesting_depth') as nesting
  from (select target_uid, kind, json_extract_string(value_json, '$.value')::double as v from measurements) m join symbols s on s.uid = m.target_uid left join files f on f.uid = s.file_uid group by 1, 2, 3)"""


@query(f"+ {FUNCTIONS} select * from functions")
def function_metrics_pivot(g):
    return _functions(g)


def _functions(g: Graph) -> DataFrame:
    return quality.function_metrics(g.measurements(), g.symbols(), g.files())


@query(f"""+ {FUNCTIONS} select regexp_extract(file, '^(.*)/[^/]*$', 1) as module, count(*) as functions, floor(avg(complexity) * 10 + 0.5) / 10 as avg_complexity, max(complexity) as max_complexity,
  floor(avg(nesting) * 10 + 0.5) / 10 as avg_nesting, max(nesting) as max_nesting from functions where file is not null group by 1""")
def module_metric_aggregates(g):
    return quality.module_metrics(_functions(g))


@query("select target_uid, kind, json_extract_string(value_json, '$.value')::double as value from measurements where kind = 'cyclomatic_complexity' order by value desc, target_uid limit 50")
def measurements_top(g):
    """A report of the 50 greatest."""
    return lookup.top_measurements(g.measurements(), "cyclomatic_complexity", 50)


@query(f"+ {CHURN} select * from churn")
def file_churn(g):
    return quality.churn(g.commits(), g.files())


def _hotspots(g: Graph, **kw) -> DataFrame:
    return quality.hotspots(quality.churn(g.commits(), g.files()), _complexity(g), **kw)


@query(f"+ {CHURN} select path, commit_count, lines_changed, sum_complexity, hotspot_score from hotspots")
def hotspots(g):
    return _hotspots(g)


@query(f"+ {CHURN} select path, commit_count, lines_changed, sum_complexity, hotspot_score from hotspots where not is_test")
def hotspots_filtered(g):
    return _hotspots(g, no_tests=True, no_vendored=True)


@query(f"+ {CHURN} select path, hotspot_score, case when max(hotspot_score) over () > 0 then floor(hotspot_score::double / max(hotspot_score) over () * 100 + 0.5) / 100 else 0 end as normalized_score from hotspots")
def hotspots_normalized(g):
    return quality.normalised(_hotspots(g))


@query(f"+ {CHURN} select h.path, hotspot_score, line_coverage, hotspot_score * (1 - line_coverage) as risk_score from hotspots h join coverage c on c.path = h.path")
def risk(g):
    return quality.risk(_hotspots(g), g.coverage())


def _report(g: Graph) -> DataFrame:
    """A coverage report in which every eleventh path isn't in the repository."""
    rows = g.coverage()
    return rows.withColumn("path", F.when(F.floor(F.col("line_coverage") * 100 + 0.5) % 11 == 0, F.concat(F.lit("build/"), "path")).otherwise(F.col("path")))


REPORT = "report as (select case when floor(line_coverage * 100 + 0.5) % 11 = 0 then 'build/' || path else path end as path, line_coverage from coverage)"


@query(f"+ {REPORT} select r.path, r.line_coverage, f.uid as file_uid from report r join files f on f.path = r.path")
def coverage_matched(g):
    return quality.match_coverage(_report(g), g.files()).filter("matched").select("path", "line_coverage", "file_uid")


@query(f"+ {REPORT} select path, line_coverage from report where path not in (select path from files)")
def coverage_unmatched(g):
    return quality.match_coverage(_report(g), g.files()).filter("not matched").select("path", "line_coverage")


HEALTH = f"""{CHURN}, {FUNCTIONS}, health as (select (select count(*) from files)::double as files, (select count(*) from symbols where file_uid is not null)::double as symbols, (select count(*) from calls)::double as calls,
  (select count(*) from module_imports a join module_imports b on a.src = b.dst and a.dst = b.src where a.src < a.dst)::double as mutual_imports, (select floor(avg(complexity) * 10 + 0.5) / 10 from functions where file is not null) as avg_complexity,
  (select max(complexity) from functions where file is not null) as max_complexity, (select count(*) from functions where file is not null)::double as functions, (select count(*) from hotspots where hotspot_score > 0)::double as hotspot_files)"""
UNPIVOT = "select metric, value from (select * from health) unpivot include nulls (value for metric in (files, symbols, calls, mutual_imports, avg_complexity, max_complexity, functions, hotspot_files))"


@query(staged=True)
def snapshot_trend(g):
    """Metrics of the snapshot and of the earlier one, with the direction of change."""

    def health(x: Graph) -> DataFrame:
        return quality.health(x.files(), x.symbols(), x.calls(), graph.mutual(x.module_imports()), _functions(x), _hotspots(x))

    return quality.trend(health(g), health(Staged(Graph(g.spark, g.dir, EARLIER))))


ORACLE_SQL["snapshot_trend"] = f"""with now_ as ({projected('+ ' + HEALTH + ' ' + UNPIVOT)}), then_ as ({projected('+ ' + HEALTH + ' ' + UNPIVOT, EARLIER)}),
  d as (select n.metric, n.value, t.value as parent_value, n.value - t.value as x, case when n.metric in ('mutual_imports', 'avg_complexity', 'max_complexity', 'hotspot_files') then -1 else 0 end as way from now_ n left join then_ t using (metric))
  select metric, value, parent_value, case when x >= 0 then floor(x * 10000 + 0.5) / 10000 else -floor(-x * 10000 + 0.5) / 10000 end as delta,
    case when value is null then 'no_data' when parent_value is null then 'new' when way = 0 or x = 0 then 'unchanged' when sign(x) = way then 'improved' else 'worsened' end as direction from d"""


# Policies and gate

FACTS = """facts as (select m.target_uid as target, m.kind, json_extract_string(value_json, '$.value')::double as value, regexp_extract(f.path, '^(.*)/[^/]*$', 1) as module, f.path as file, s.subtype as symbol_kind
  from measurements m join symbols s on s.uid = m.target_uid left join files f on f.uid = s.file_uid)"""
BASE = "baseline as (select target, kind, case when substr(target, 2)::bigint % 5 = 1 then value - 1 else value end as base from facts where substr(target, 2)::bigint % 5 <> 0)"
POLICY_SQL = f"""{FACTS}, {BASE}, rows_ as (
  select 'p-max' as policy_id, f.*, b.base as baseline_value, value > 45 as violates from facts f left join baseline b using (target, kind) where kind = 'cyclomatic_complexity'
  union all select 'p-min', f.*, b.base, value < 0 from facts f left join baseline b using (target, kind) where kind = 'parameter_count' and symbol_kind = 'CLASS'
  union all select 'p-new', f.*, b.base, b.base is null and value > 30 from facts f left join baseline b using (target, kind) where kind = 'cyclomatic_complexity' and (module = 'ASIA' or starts_with(module, 'ASIA/'))
  union all select 'p-worse', f.*, b.base, coalesce(b.base > 2 and value > b.base, false) from facts f left join baseline b using (target, kind) where kind = 'max_nesting_depth'
  union all select 'p-file', f.*, b.base, value > 4 from facts f left join baseline b using (target, kind) where kind = 'max_nesting_depth' and symbol_kind = 'FUNCTION' and regexp_matches(file, '^EUROPE/(?:.*/)?[^/]*\\.rs$')),
policies as (select * from (values ('p-max', 'absolute_max', 'fail'), ('p-min', 'absolute_min', 'advisory'), ('p-new', 'no_new', 'fail'), ('p-worse', 'no_worsened', 'fail'), ('p-file', 'absolute_max', 'fail'), ('p-none', 'absolute_max', 'fail')) t(policy_id, policy_kind, severity)),
assessed as (select p.policy_id, policy_kind, severity, case when count(r.target) = 0 then 'NOT_APPLICABLE' when count(*) filter (violates) > 0 then 'FAIL' else 'PASS' end as verdict, count(r.target) as measured, count(*) filter (violates) as violations
  from policies p left join rows_ r using (policy_id) group by 1, 2, 3)"""


def _facts(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Facts in scope of policies, and a baseline that lacks a fifth of them and differs in another."""
    s = g.symbols().join(g.files().select(F.col("uid").alias("file_uid"), F.col("path").alias("file")), "file_uid", "left")
    values_ = g.measurements().select(F.col("target_uid").alias("target"), "kind", F.get_json_object("value_json", "$.value").cast("double").alias("value"))
    facts = values_.join(s.select(F.col("uid").alias("target"), paths.dirname(F.col("file")).alias("module"), "file", F.col("subtype").alias("symbol_kind")).hint("merge"), "target")
    n = F.substring("target", 2, 20).cast("long") % 5
    return facts, values_.filter(n != 0).select("target", "kind", F.when(n == 1, F.col("value") - 1).otherwise(F.col("value")).alias("value"))


@query("""select 'p-max' as policy_id, 'absolute_max' as policy_kind, 'fail' as severity, case when count(*) = 0 then 'NOT_APPLICABLE' when count(*) filter (v > 45) > 0 then 'FAIL' else 'PASS' end as verdict, count(*) as measured, count(*) filter (v > 45) as violations
  from (select json_extract_string(value_json, '$.value')::double as v from measurements where kind = 'cyclomatic_complexity')""")
def single_policy_assessment(g):
    """One policy of an absolute bound over every symbol: no baseline and no scope, so no join."""
    facts = g.measurements().select(F.col("target_uid").alias("target"), "kind", F.get_json_object("value_json", "$.value").cast("double").alias("value"))
    return quality.assess(POLICIES[:1], facts, None)


@query(f"+ {POLICY_SQL} select * from assessed")
def quality_assessments(g):
    return quality.assess(POLICIES, *_facts(g))


@query(f"+ {POLICY_SQL} select policy_id, target, kind, value, baseline_value from rows_ where violates")
def policy_violations(g):
    return quality.policy_rows(POLICIES, *_facts(g)).filter("violates").drop("violates")


@query(f"+ {POLICY_SQL} select policy_id, count(*) as facts from rows_ group by 1")
def scope_matches(g):
    return quality.policy_rows(POLICIES, *_facts(g)).groupBy("policy_id").agg(F.count("*").alias("facts"))


def _policy_facts(g: Graph) -> DataFrame:
    """The last policy's assessment is missing here."""
    policies = g.spark.createDataFrame([(p["policy_id"], p["severity"]) for p in POLICIES], "policy_id string, severity string")
    return gate.policy_facts(policies, quality.assess(POLICIES, *_facts(g)).filter("policy_id <> 'p-none'"))


GATE_FACTS = "gate_facts as (select p.policy_id, p.severity, a.verdict, case when a.verdict is null then 'missing' else 'present' end as state from policies p left join (select * from assessed where policy_id <> 'p-none') a using (policy_id))"


@query(f"+ {POLICY_SQL}, {GATE_FACTS} select * from gate_facts")
def gate_policy_facts(g):
    return _policy_facts(g)


WAIVERS = f"active as (select * from waivers where is_active and (expires_at is null or expires_at > '{NOW}') qualify row_number() over (partition by req_id, version, obligation_id order by created_at desc, waiver_id) = 1)"


def _judged(g: Graph) -> DataFrame:
    s = g.symbols().join(g.files().select(F.col("uid").alias("file_uid"), "path"), "file_uid")
    complexity = g.measurements().filter("kind = 'cyclomatic_complexity'").select(F.col("target_uid").alias("uid"), F.get_json_object("value_json", "$.value").cast("double").alias("value")).join(s.select("uid", "path").hint("merge"), "uid")
    found = gate.evidence(table(g.spark, "obligations"), g.coverage().select("path", F.col("line_coverage").alias("value")), complexity.select("path", "value"), _hotspots(g).select("path", F.col("hotspot_score").alias("value")), _rules(g))
    return gate.verdicts(found, gate.active_waivers(table(g.spark, "waivers"), NOW))


JUDGED = f"""{CHURN}, {RULES}, {WAIVERS},
cplx as (select f.path, json_extract_string(value_json, '$.value')::double as value from measurements m join symbols s on s.uid = m.target_uid join files f on f.uid = s.file_uid where kind = 'cyclomatic_complexity'),
ev as (select o.req_id, o.obligation_id, count(*) as measured, avg(line_coverage) as value from obligations o join coverage c on o.target is null or c.path = o.target or starts_with(c.path, o.target || '/') where method = 'coverage_threshold' group by 1, 2
  union all select o.req_id, o.obligation_id, count(*), max(value) from obligations o join cplx c on o.target is null or c.path = o.target or starts_with(c.path, o.target || '/') where method = 'complexity_threshold' group by 1, 2
  union all select o.req_id, o.obligation_id, count(*), max(hotspot_score)::double from obligations o join hotspots c on o.target is null or c.path = o.target or starts_with(c.path, o.target || '/') where method = 'hotspot_threshold' group by 1, 2
  union all select o.req_id, o.obligation_id, count(*), sum(case when status = 'violated' then import_count else 0 end)::double from obligations o join violations c on c.source = o.target or starts_with(c.source, o.target || '/') where method = 'arch_violations' group by 1, 2
  union all select o.req_id, o.obligation_id, 1, (select count(*) filter (status = 'violated') from violations)::double from obligations o where method = 'module_violations'),
comp as (select o.*, coalesce(e.measured, 0) as measured, e.value, case when method not in ('arch_violations', 'coverage_threshold', 'complexity_threshold', 'hotspot_threshold', 'module_violations') then 'UNSUPPORTED'
    when (method like '%_threshold' and threshold is null) or (method in ('coverage_threshold', 'complexity_threshold', 'arch_violations') and target is null) or e.measured is null then 'MISSING_EVIDENCE'
    when case when method like '%_threshold' then case coalesce(operator, case when method = 'coverage_threshold' then '>=' else '<=' end) when '>=' then e.value >= threshold when '<=' then e.value <= threshold when '<' then e.value < threshold else false end else e.value = 0 end then 'PASS' else 'FAIL' end as computed
  from obligations o left join ev e using (req_id, obligation_id)),
judged_ as (select c.req_id, c.version, c.obligation_id, c.method, c.target, c.measured, floor(c.value * 10000 + 0.5) / 10000 as value, c.computed, case when w.waiver_id is not null and computed <> 'PASS' then 'WAIVED' else computed end as effective,
    case when computed <> 'PASS' then w.waiver_id end as waiver_id from comp c left join active w using (req_id, version, obligation_id))"""
GATE_LITERALS = f"{values('obligations')}, {values('waivers')}, {values('rules')}"


@query(f"+ {GATE_LITERALS}, {JUDGED} select * from judged_")
def gate_obligations(g):
    return _judged(g)


@query(f"""+ {GATE_LITERALS}, {JUDGED}, {POLICY_SQL}, {GATE_FACTS},
  a as (select count(*) as total, count(*) filter (effective = 'PASS') as pass, count(*) filter (effective = 'FAIL') as fail, count(*) filter (effective = 'WAIVED') as waived, count(*) filter (effective = 'MISSING_EVIDENCE') as missing_evidence, count(*) filter (effective = 'UNSUPPORTED') as unsupported from judged_),
  b as (select count(*) filter (verdict = 'FAIL' and severity = 'fail') as policy_fail, count(*) filter (state = 'missing') as policy_missing, count(*) filter (verdict = 'NOT_COMPARABLE') as policy_not_comparable from gate_facts),
  m as (select unnest(['default', 'strict', 'advisory']) as mode),
  o as (select mode, case when fail > 0 or policy_fail > 0 or (mode = 'strict' and missing_evidence + unsupported + policy_missing + policy_not_comparable > 0) then 'fail' when mode = 'default' and missing_evidence + unsupported + policy_missing + policy_not_comparable > 0 then 'incomplete' else 'pass' end as outcome, a.*, b.* from a, b, m)
  select *, case outcome when 'fail' then 1 when 'incomplete' then 2 else 0 end::bigint as exit_code from o""", staged=True)
def gate_outcome(g):
    return gate.outcome(_judged(g), _policy_facts(g))


# Resolution and classification

SIGNALS = dict(value_symbols=[f"fn{k}" for k in range(0, 50, 5)], class_symbols=["Cls1", "Cls2", "Cls3"], interface_symbols=["Iface"], dependencies=["lodash", "serde-json", "express"], aliases=["@app/*", "*"], runtime_modules=["fs", "path"], runtime_globals=["console", "fn7", "Cls7"])


def _signals(g: Graph) -> DataFrame:
    row = g.spark.createDataFrame([tuple(SIGNALS.values())], ", ".join(f"{k} array<string>" for k in SIGNALS))
    bound = table(g.spark, "bindings").agg(F.collect_list(F.struct("identifier", "specifier", "relative")).alias("bindings"))
    return row.crossJoin(F.broadcast(bound))  # one row each


def _classified(g: Graph) -> DataFrame:
    return resolve.classify(g.unresolved(), _signals(g))


CLASSIFIED = f"""{values('bindings')}, c0 as (select u.*, case when category in ('calls_function_ambiguous_or_missing', 'instantiates_class_not_found') then target_key when category = 'calls_obj_method_needs_type_info' then split_part(target_key, '.', 1) end as id from unresolved u),
c1 as (select c0.*, b.specifier as spec, b.relative, split_part(target_key, '::', 1) as base, case when category = 'calls_obj_method_needs_type_info' then 'receiver' else 'callee' end as role from c0 left join bindings b on b.identifier = c0.id),
c2 as (select *, case
  when category = 'calls_obj_method_needs_type_info' and id in ('app', 'router', 'server') then 'framework_boundary_candidate|express_route_registration'
  when category like 'calls_this_%' then 'internal_candidate|this_receiver_implies_internal'
  when category = 'imports_file_not_found' then case when target_key like '.%' then 'internal_candidate|relative_import_target_unresolved' when target_key in ('lodash/fp') or replace(base, '_', '-') in ('lodash', 'serde-json', 'express') then 'external_library_candidate|specifier_matches_package_dependency'
    when target_key in ('fs', 'path') then 'external_library_candidate|specifier_matches_runtime_module' when target_key like '@app/%' then 'internal_candidate|specifier_matches_project_alias' when target_key like '%::%' and regexp_matches(base, '^[a-z][a-z0-9_]*$') then 'internal_candidate|rust_crate_internal_module_heuristic' else 'unknown|no_supporting_signal' end
  when category = 'other' or id is null then 'unknown|no_supporting_signal'
  when (category like 'calls_%' and id in ({', '.join(f"'fn{k}'" for k in range(0, 50, 5))})) or (category = 'instantiates_class_not_found' and id in ('Cls1', 'Cls2', 'Cls3')) then 'internal_candidate|' || role || '_matches_same_file_symbol'
  when not relative and spec in ('fs', 'path') then 'external_library_candidate|specifier_matches_runtime_module'
  when not relative and spec in ('lodash', 'serde-json', 'express') then 'external_library_candidate|' || role || '_matches_external_import'
  when relative then 'internal_candidate|' || role || '_matches_internal_import' when spec like '@app/%' then 'internal_candidate|specifier_matches_project_alias'
  when id in ('console', 'fn7', 'Cls7') then 'external_library_candidate|' || role || '_matches_runtime_global' else 'unknown|no_supporting_signal' end as v from c1),
classified as (select edge_uid, source_uid, category, target_key, split_part(v, '|', 1) as classification, split_part(v, '|', 2) as basis from c2)"""


@query(f"+ {CLASSIFIED} select * from classified")
def classify_unresolved(g):
    return _classified(g)


@query(f"+ {CLASSIFIED} select classification, basis, count(*) as n from classified group by 1, 2")
def unresolved_by_classification(g):
    return _classified(g).groupBy("classification", "basis").agg(F.count("*").alias("n"))


@query("select category, count(*) as n from unresolved group by 1")
def unresolved_by_category(g):
    return g.unresolved().groupBy("category").agg(F.count("*").alias("n"))


@query(f"+ {CLASSIFIED} select classification, category, basis, edge_uid, target_key from classified where classification = 'unknown' order by category, basis, edge_uid limit 100")
def unresolved_samples(g):
    """A report of the first 100."""
    return _classified(g).filter("classification = 'unknown'").select("classification", "category", "basis", "edge_uid", "target_key").orderBy("category", "basis", "edge_uid").limit(100)


@query(f"""+ {CLASSIFIED}, b as (select c.edge_uid, case when category not like 'calls_%' then 'not_applicable' when basis = 'this_receiver_implies_internal' then 'this_bound' when basis like '%_external_import' then 'import_bound_external' when basis like '%_internal_import' or basis = 'specifier_matches_project_alias' then 'import_bound_internal'
    when basis like '%_same_file_symbol' then 'same_file_declared' when basis like '%_runtime_global' then 'runtime_global' when basis = 'specifier_matches_runtime_module' then 'runtime_module' else 'local_like' end as receiver_origin,
    case when category not like 'calls_%' then 'unknown_scope' when visibility = 'export' then 'exported_public' else 'internal_private' end as scope, category from classified c join symbols s on s.uid = c.source_uid)
  select receiver_origin, scope, case when category not like 'calls_%' then 'not_applicable' when receiver_origin in ('local_like', 'this_bound') then case when scope = 'exported_public' then 'medium' else 'low' end when receiver_origin = 'import_bound_internal' then 'medium' else 'low' end as blast_radius, count(*) as n from b group by all""")
def blast_radius(g):
    rows = _classified(g).join(g.symbols().select(F.col("uid").alias("source_uid"), "visibility"), "source_uid")
    return rows.select(resolve.blast_radius(F.col("category"), F.col("basis"), F.col("visibility")).alias("b")).select("b.*").groupBy("receiver_origin", "scope", "blast_radius").agg(F.count("*").alias("n"))


@query("""+ raw as (select c.src || '>' || c.dst as edge_uid, ['CALLS', 'INSTANTIATES', 'IMPLEMENTS'][(substr(c.dst, 2)::bigint % 3 + 1)::int] as type, case when substr(c.dst, 2)::bigint % 2 = 0 then s.name else 'obj.' || s.name end as target_key from calls c join symbols s on s.uid = c.dst),
  hit as (select r.edge_uid, case when r.target_key like 'obj.%' then 1 else 2 end as stage, count(*) as n, min(s.uid) as target from raw r join symbols s on s.name = case when r.target_key like 'obj.%' then substr(r.target_key, 5) else r.target_key end
    where (type = 'INSTANTIATES' and subtype = 'CLASS') or (type = 'IMPLEMENTS' and subtype = 'INTERFACE') or (type = 'CALLS' and subtype not in ('TYPE_ALIAS', 'INTERFACE')) group by 1, 2)
  select r.edge_uid, r.type, r.target_key, case when n = 1 then target end as target_uid, case when n = 1 then stage end::bigint as stage, coalesce(n, 0) as candidates from raw r left join hit h on h.edge_uid = r.edge_uid""")
def resolve_calls(g):
    """Calls known by name only, half of them through an object."""
    n = F.substring("dst", 2, 20).cast("long")
    kind = F.element_at(F.array(*(F.lit(x) for x in ("CALLS", "INSTANTIATES", "IMPLEMENTS"))), (n % 3 + 1).cast("int"))
    raw = g.calls().join(g.symbols().select(F.col("uid").alias("dst"), "name"), "dst").select(F.concat_ws(">", "src", "dst").alias("edge_uid"), kind.alias("type"), F.when(n % 2 == 0, F.col("name")).otherwise(F.concat(F.lit("obj."), "name")).alias("target_key"))
    return resolve.resolve_calls(raw, g.symbols())


@query("""select type, case when type = 'IMPORTS' then 'imports_file_not_found' when type = 'INSTANTIATES' then 'instantiates_class_not_found' when type <> 'CALLS' then 'other' when target_key like 'this.%' and target_key like '%.%.%' then 'calls_this_wildcard_method_needs_type_info'
  when target_key like 'this.%' then 'calls_this_method_needs_class_context' when target_key like '%.%' then 'calls_obj_method_needs_type_info' else 'calls_function_ambiguous_or_missing' end as category, count(*) as n
  from (select target_key, case category when 'imports_file_not_found' then 'IMPORTS' when 'instantiates_class_not_found' then 'INSTANTIATES' when 'other' then 'READS' else 'CALLS' end as type from unresolved) group by 1, 2""")
def categorize_unresolved(g):
    kind = F.when(F.col("category") == "imports_file_not_found", "IMPORTS").when(F.col("category") == "instantiates_class_not_found", "INSTANTIATES").when(F.col("category") == "other", "READS").otherwise("CALLS")
    rows = g.unresolved().select(kind.alias("type"), "target_key")
    return rows.groupBy("type", resolve.categorise(F.col("type"), F.col("target_key")).alias("category")).agg(F.count("*").alias("n"))


# Boundaries between processes


def _http(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Pages as interfaces: even ones provide, odd ones consume; numbers in paths are parameters."""
    n = F.col("page_id")
    path = F.regexp_extract("url", r"^[a-z]+://[^/]*(/[^?#]*)?", 1)
    method = F.element_at(F.array(F.lit("GET"), F.lit("post"), F.lit(None).cast("string")), (n % 3 + 1).cast("int"))
    rows = g.table("pages").select(F.concat(F.lit("W"), n.cast("string")).alias("uid"), method.alias("method"), F.regexp_replace(path, r"\d+", F.when(n % 2 == 0, ":id").otherwise("{id}")).alias("path"), (n % 2).alias("_side"), F.lit(0.9).alias("confidence"), path.alias("operation"), F.concat(F.lit("f"), (n % 50).cast("string")).alias("file"), (n % 10).alias("line"))
    return rows.filter("_side = 0").drop("_side"), rows.filter("_side = 1").drop("_side")


HTTP = r"""raw as (select page_id as n, 'W' || page_id as uid, ['GET', 'post', null][(page_id % 3 + 1)::int] as method, regexp_extract(url, '^[a-z]+://[^/]*(/[^?#]*)?', 1) as op from pages),
facts as (select uid, method, n % 2 as side, 0.9::double as confidence, op as operation, 'f' || n % 50 as file, n % 10 as line, regexp_replace(op, '\d+', case when n % 2 = 0 then ':id' else '{{id}}' end, 'g') as path from raw),
norm as (select *, case when path = '' then '/' else array_to_string(list_transform(string_split(path, '/'), lambda s: case when s like '{{%}}' or (s like ':%' and length(s) > 1) then '{{_}}' else s end), '/') end as np from facts),
conf as (select *, upper(coalesce(method, '*')) || ' ' || np as k, list_filter(string_split(np, '/'), lambda s: s <> '') as seg from norm),
sure as (select *, case when len(seg) <= 1 then confidence * 0.8::double when len(list_filter(seg, lambda s: s = '{{_}}')) = 0 then confidence else confidence * (1 - 0.1::double * len(list_filter(seg, lambda s: s = '{{_}}')) / len(seg)) end as c from conf),
links as (select p.uid as provider, c.uid as consumer, 'address_match' as basis, c.c as confidence from sure c join sure p on p.k = c.k where c.side = 1 and p.side = 0
  union all select p.uid, c.uid, 'heuristic', c.c * 0.7::double from sure c join sure p on p.np = c.np where c.side = 1 and p.side = 0 and c.method is null and c.k not in (select k from sure where side = 0))""".replace("{{", "{").replace("}}", "}")


@query(f"with {HTTP} select * from links", plain=True)
def http_boundary_links(g):
    return boundary.match_http(*_http(g))


@query(f"with {HTTP}, l as (select distinct operation, file, line from facts where uid in (select provider from links)) select uid, operation, file, line from facts f where side = 0 and not exists (select 1 from l where l.operation = f.operation and l.file = f.file and l.line = f.line)", plain=True)
def unmatched_providers(g):
    return boundary.unlinked(*_http(g), "provider").select("uid", "operation", "file", "line")


@query(f"with {HTTP}, l as (select distinct operation, file, line from facts where uid in (select consumer from links)) select uid, operation, file, line from facts f where side = 1 and not exists (select 1 from l where l.operation = f.operation and l.file = f.file and l.line = f.line)", plain=True)
def unmatched_consumers(g):
    return boundary.unlinked(*_http(g), "consumer").select("uid", "operation", "file", "line")


@query(f"with {HTTP} select case side when 0 then 'provider' else 'consumer' end as side, coalesce(method, '*') as kind, count(*) as n from facts group by 1, 2 union all select 'link', basis, count(*) from links group by 2", plain=True)
def boundary_summary(g):
    return boundary.summary(*_http(g))


@query(f"with {HTTP} select uid, np as path, upper(coalesce(method, '*')) || ' ' || np as key from norm", plain=True)
def http_path_normalize(g):
    p, c = _http(g)
    return p.unionByName(c).select("uid", paths.http_path(F.col("path")).alias("path"), paths.http_key(F.col("method"), F.col("path")).alias("key"))


# Trust and summaries

TRIGGERS = f"""{TRUST_STATS.lstrip('+ ')}, {PARENTS}, every as (select uid, path from modules union all select uid, path from regions), two as (select distinct a.src as a, a.dst as b from up a join up b on a.src = b.dst and a.dst = b.src where a.src < a.dst),
pp as (select case when starts_with(pb.path, pa.path || '/') then pa.path else pb.path end as ancestor from two join every pa on pa.uid = a join every pb on pb.uid = b where starts_with(pb.path, pa.path || '/') or starts_with(pa.path, pb.path || '/')),
per as (select ancestor, count(*) as n from pp group by 1),
trig as (select (select count(*) from files) as files, coalesce((select sum(n) from per), 0)::bigint as cycles, coalesce((select max(n) from per), 0) as most_cycles, (select count(*) from trust_stats where fan_in = 0 and fan_out = 0 and file_count >= 2) as suspicious, (select count(*) from entrypoints) as entrypoints)"""


def _triggers(g: Graph) -> DataFrame:
    return trust.downgrades(g.files(), graph.path_prefix_cycles(*_with_parents(g)), modules.trust_stats(g.modules(), g.files(), g.module_imports()), table(g.spark, "entrypoints"))


@query(f"+ {values('entrypoints')}, {TRIGGERS} select *, false as framework_heavy, most_cycles >= 3 or cycles >= 5 as registry_pattern, entrypoints = 0 as missing_entrypoints, suspicious >= 3 as alias_resolution from trig")
def trust_downgrades(g):
    return _triggers(g)


def _counts(g: Graph) -> DataFrame:
    rows = _classified(g)
    inner = F.col("category").startswith("calls_") & (F.col("classification") != "external_library_candidate")
    a = rows.agg(F.count(F.when(inner, 1)).alias("unresolved_internal_calls"), F.count(F.when(F.col("category") == "imports_file_not_found", 1)).alias("unresolved_imports"))
    return g.calls().agg(F.count("*").alias("resolved_calls")).crossJoin(F.broadcast(a))  # one row each


AXES = f"""{CLASSIFIED}, {TRIGGERS}, n as (select (select count(*) from calls) as ok, (select count(*) from classified where category like 'calls_%' and classification <> 'external_library_candidate') as bad, (select count(*) from classified where category = 'imports_file_not_found') as imp, most_cycles >= 3 or cycles >= 5 as reg, suspicious >= 3 as ali, entrypoints = 0 as mis from trig),
r as (select *, case when ok + bad = 0 then 1 else ok::double / (ok + bad) end as rate from n),
i as (select *, array_to_string(list_filter([case when ali then 'alias_resolution_suspicion' end, case when imp > 0 then 'unresolved_imports=' || imp end], lambda x: x is not null), ';') as iw, case when ok + bad = 0 then 'HIGH' when rate < 0.5 then 'LOW' when rate < 0.85 then 'MEDIUM' else 'HIGH' end as cl from r),
j as (select *, case when iw <> '' then 'LOW' when reg then 'MEDIUM' else 'HIGH' end as il, array_to_string(list_filter([case when mis then 'missing_entrypoint_declarations' end, case when reg then 'registry_pattern_suspicion' end], lambda x: x is not null), ';') as dw, array_to_string(list_filter([case when ali then 'alias_resolution_suspicion' end, case when reg then 'registry_pattern_suspicion' end], lambda x: x is not null), ';') as cw from i),
axes as (select 'import_graph' as axis, il as level, case when iw <> '' then iw when reg then 'registry_pattern_suspicion' else '' end as reasons from j
  union all select 'call_graph', cl, case when cl = 'LOW' then printf('call_resolution_rate=%.1f%%_below_50%%', rate * 100) when cl = 'MEDIUM' then printf('call_resolution_rate=%.1f%%_below_85%%', rate * 100) else '' end from j
  union all select 'dead_code', case when dw <> '' then 'LOW' when cl = 'LOW' then 'MEDIUM' else 'HIGH' end, case when dw <> '' then dw when cl = 'LOW' then 'call_graph_reliability_low' else '' end from j
  union all select 'change_impact', case when cw <> '' then 'LOW' else il end, case when cw <> '' then cw when il <> 'HIGH' then 'import_graph_reliability_' || lower(il) else '' end from j)"""


def _axes(g: Graph) -> DataFrame:
    return trust.axes(_triggers(g), _counts(g))


@query(f"+ {values('entrypoints')}, {AXES} select * from axes", staged=True)
def trust_axes(g):
    return _axes(g)


@query(f"{DEAD_SQL}, {AXES} select d.*, lower(a.level) as confidence from dead d, (select level from axes where axis = 'dead_code') a")
def dead_nodes_with_confidence(g):
    level = _axes(g).filter("axis = 'dead_code'").select(trust.dead_confidence(F.col("level")).alias("confidence"))
    return _dead(g).crossJoin(F.broadcast(level))  # one row


@query(f"+ {values('entrypoints')}, {AXES} select case when rate < 0.2 then 'low' when rate <= 0.5 then 'medium' else 'medium' end as confidence, floor(rate * 10000 + 0.5) / 10000 as rate from j")
def repo_confidence(g):
    """Enrichment hasn't run here."""
    row = _counts(g).withColumn("rate", F.when(F.col("resolved_calls") + F.col("unresolved_internal_calls") == 0, 1.0).otherwise(F.col("resolved_calls") / (F.col("resolved_calls") + F.col("unresolved_internal_calls"))))
    return row.select(trust.repo_confidence(F.col("rate"), F.lit(False), F.lit("not_run")).alias("confidence"), half_up(F.col("rate"), 4).alias("rate"))


@query(f"""+ {values('entrypoints')}, {AXES} select * from (values (1::bigint, 'SNAPSHOT_EXISTS', 'pass'), (3, 'STALE_FILES', 'pass'), (5, 'ENRICHMENT_STATE', 'fail'), (6, 'GATE_STATUS', 'incomplete')) t(ord, code, status)
  union all select 2, 'INDEX_NOT_EMPTY', case when (select count(*) from files) > 0 then 'pass' else 'incomplete' end union all select 4, 'CALL_GRAPH_RELIABILITY', case when level = 'LOW' then 'fail' else 'pass' end from axes where axis = 'call_graph'""")
def check_conditions(g):
    level = _axes(g).filter("axis = 'call_graph'").select(F.col("level").alias("call_graph"))
    state = g.files().agg(F.count("*").alias("files_total")).crossJoin(F.broadcast(level))  # one row each
    return trust.check_conditions(state.select(F.lit(True).alias("snapshot_exists"), "files_total", F.lit(0).alias("stale_files"), "call_graph", F.lit("not_run").alias("enrichment"), F.lit(None).cast("string").alias("gate")))


def _ranked(g: Graph) -> DataFrame:
    made = agent.module_signals(_stats(g)).unionByName(agent.counted("IMPORT_CYCLES", graph.mutual(g.module_imports()), 3)).unionByName(agent.counted("BOUNDARY_VIOLATIONS", _rules(g).filter("status = 'violated'"), 4)).unionByName(agent.counted("HIGH_COMPLEXITY", _functions(g).filter("complexity > 40"), 5)).unionByName(agent.counted("SNAPSHOT_INFO", g.files(), 6))
    return agent.ranked(made, agent.catalogue(g.spark)).select("rank", "code", "category", "severity", "n")


RANKED = f"""{values('rules')}, {RULES}, {MODULE_STATS.lstrip().lstrip('+')}, {FUNCTIONS},
made as (select 'MODULE_SUMMARY' as code, count(*) as n, 0 as ord, 1 as sev, 6 as cat, 0 as tier, 'informational' as category, 'low' as severity from module_stats
  union all select 'HIGH_FAN_OUT', count(*), 1, 1, 5, 0, 'structure', 'low' from module_stats where fan_out >= 20 union all select 'HIGH_INSTABILITY', count(*), 2, 1, 5, 1, 'structure', 'low' from module_stats where instability >= 0.7
  union all select 'IMPORT_CYCLES', count(*), 3, 2, 5, 0, 'structure', 'medium' from module_imports a join module_imports b on a.src = b.dst and a.dst = b.src where a.src < a.dst
  union all select 'BOUNDARY_VIOLATIONS', count(*), 4, 3, 3, 0, 'boundary', 'high' from violations where status = 'violated' union all select 'HIGH_COMPLEXITY', count(*), 5, 2, 5, 1, 'structure', 'medium' from functions where complexity > 40
  union all select 'SNAPSHOT_INFO', count(*), 6, 1, 6, 1, 'informational', 'low' from files),
ranked as (select row_number() over (order by sev desc, cat, tier, ord) as rank, code, category, severity, n from made where n > 0)"""


@query(f"+ {RANKED} select * from ranked")
def ranked_signals(g):
    return _ranked(g)


@query(f"+ {RANKED} select *, greatest((select count(*) from ranked) - 5, 0) as omitted from ranked where rank <= 5")
def budget_truncation(g):
    """A report within the small budget."""
    return agent.within(_ranked(g), "small")


# Discovery and ownership


@query(f"""+ {values('roots')}, anc as (select uid, path, '.' as root from files union all select uid, path, array_to_string(list_slice(string_split(path, '/'), 1, k), '/') from files, unnest(range(1, len(string_split(path, '/')))) t(k))
  select uid as file_uid, path, module_uid, root, kind from (select a.uid, a.path, r.*, row_number() over (partition by a.uid order by case when r.root = '.' then 0 else length(r.root) end desc, case r.kind when 'declared' then 0 when 'operational' then 1 else 2 end, module_uid) as n from anc a join roots r on r.root = a.root) where n = 1""")
def file_ownership_longest_prefix(g):
    return modules.assign_ownership(g.files(), table(g.spark, "roots"))


@query(f"""+ {values('evidence')}, per as (select file_uid, count(*) as n from symbols group by 1)
  select m.uid as module_uid, m.path, (select count(*) from files where module_uid = m.uid) as files, (select count(*) from files where module_uid = m.uid and is_test) as test_files, coalesce((select sum(n)::bigint from files f join per on per.file_uid = f.uid where f.module_uid = m.uid), 0) as symbols,
  (select count(*) from evidence e where e.module_uid = m.uid) as evidence, (select string_agg(distinct source, ',' order by source) from evidence e where e.module_uid = m.uid) as sources, (select source from evidence e where e.module_uid = m.uid order by confidence desc, source limit 1) as primary_source from modules m""")
def module_candidate_rollups(g):
    own = g.files().select(F.col("uid").alias("file_uid"), "module_uid")
    return modules.candidate_rollups(g.modules().select(F.col("uid").alias("module_uid"), "path"), table(g.spark, "evidence"), own, g.files(), g.symbols())


@query("""+ d as (select array_to_string(list_slice(string_split(path, '/'), 1, 2), '/') as directory, language, count(*) as n from files group by 1, 2)
  select directory, arg_min(language, (-n, language)) as language, sum(n)::bigint as files, floor(max(n)::double / sum(n) * 10000 + 0.5) / 10000 as share from d group by 1 having sum(n) >= 5 and max(n)::double / sum(n) >= 0.8""")
def directory_modules(g):
    return modules.directory_modules(g.files())


# Seams, from events


def _seams(g: Graph) -> DataFrame:
    n = F.col("event_id")
    return g.table("events").select(F.concat(F.lit("VAR_"), (n % 37).cast("string")).alias("name"), F.concat(F.lit("s"), (F.col("user_id") % 11).cast("string")).alias("surface"), F.element_at(F.array(*(F.lit(x) for x in ("required", "optional", "unknown"))), (n % 3 + 1).cast("int")).alias("access"), F.when(n % 4 == 0, F.concat(F.lit("d"), (n % 8).cast("string"))).alias("default_value"), (n % 5).alias("evidence"), (n % 100 / 100).alias("confidence"), n.alias("ord"), F.concat(F.lit("/data/"), (n % 23).cast("string")).alias("path"), F.col("event_type").alias("kind"), F.concat(F.lit("to"), (n % 6).cast("string")).alias("destination"), (n % 9 == 0).alias("dynamic"), F.concat(F.lit("f"), (n % 41).cast("string")).alias("file"))


SEAMS = """seams as (select 'VAR_' || event_id % 37 as name, 's' || user_id % 11 as surface, ['required', 'optional', 'unknown'][(event_id % 3 + 1)::int] as access, case when event_id % 4 = 0 then 'd' || event_id % 8 end as default_value, event_id % 5 as evidence, (event_id % 100) / 100.0::double as confidence, event_id as ord,
  '/data/' || event_id % 23 as path, event_type as kind, 'to' || event_id % 6 as destination, event_id % 9 = 0 as dynamic, 'f' || event_id % 41 as file from events)"""


@query(f"""with {SEAMS} select name, case min(case access when 'required' then 0 when 'optional' then 1 else 2 end) when 0 then 'required' when 1 then 'optional' else 'unknown' end as access, arg_min(default_value, ord) filter (default_value is not null) as default_value, count(distinct default_value) > 1 as conflicting,
  count(distinct surface) as surfaces, sum(evidence)::bigint as evidence, max(confidence) as confidence from seams group by 1""", plain=True)
def env_rollup(g):
    return seams.env_rollup(_seams(g))


@query(f"with {SEAMS} select path, kind, count(distinct surface) as surfaces, sum(evidence)::bigint as evidence, string_agg(distinct destination, ',' order by destination) as destinations, max(confidence) as confidence from seams where not dynamic group by 1, 2", plain=True)
def fs_rollup(g):
    return seams.fs_rollup(_seams(g))


@query(f"with {SEAMS} select kind, count(*) as n, count(distinct file) as files from seams where dynamic group by 1 union all select '*', count(*), count(distinct file) from seams where dynamic", plain=True)
def fs_dynamic_summary(g):
    return seams.fs_dynamic(_seams(g))


# Documents

NAMES = ("README.md", "MAP.md", "docs/x.md", "compose.yaml", "notes.txt", "CHANGELOG.md", "guide.md")


def _docs(g: Graph) -> DataFrame:
    name = F.element_at(F.array(*(F.lit(x) for x in NAMES)), (F.col("doc_id") % 7 + 1).cast("int"))
    rows = g.table("documents").select(F.concat_ws("/", F.coalesce("source", F.lit("none")), F.col("doc_id").cast("string"), name).alias("path"))
    return rows.withColumn("kind", paths.doc_kind(F.col("path"))).withColumn("generated", F.lower(paths.basename(F.col("path"))) == "map.md")


DOCS = f"""doc_paths as (select coalesce(source, 'none') || '/' || doc_id || '/' || {list(NAMES)}[(doc_id % 7 + 1)::int] as path, doc_id % 7 as k from documents),
doc_kinds as (select path, case k when 0 then 'readme' when 1 then 'map' when 2 then 'architecture' when 3 then 'config' when 4 then 'config' else 'architecture' end as kind, k = 1 as generated from doc_paths)"""


@query(f"with {DOCS} select * from doc_kinds", plain=True)
def doc_kind(g):
    return _docs(g)


@query(f"""with {DOCS}, foci as (select distinct coalesce(source, 'none') as focus from documents), d as (select *, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir, case kind when 'architecture' then 30 when 'readme' then 20 when 'map' then 10 else 5 end - case when generated then 5 else 0 end as own from doc_kinds)
  select focus, path, (250 + own)::bigint as priority from foci join d on starts_with(d.dir, focus || '/')""", plain=True)
def doc_relevance(g):
    focus = g.table("documents").select(F.coalesce("source", F.lit("none")).alias("focus")).distinct()
    return docs.relevance(_docs(g), focus)


# Refresh


def _versions(g: Graph) -> DataFrame:
    """A hash of each supplier's line items; every ninth file is a configuration file of its directory."""
    rows = g.lineitem().groupBy("l_suppkey").agg(F.md5(F.concat_ws(":", F.count("*").cast("string"), F.sum("l_linenumber").cast("string"))).alias("content_hash"))
    n = F.col("l_suppkey")
    own = F.concat(F.lit("S"), n.cast("string"))
    return rows.join(g.files().select("uid", "path"), own == F.col("uid")).select(F.col("uid").alias("file_uid"), F.when(n % 9 == 0, F.concat(paths.dirname(F.col("path")), F.lit("/pkg"), n.cast("string"), F.lit("/package.json"))).otherwise(F.concat(paths.dirname(F.col("path")), F.lit("/pkg"), (n - n % 9).cast("string"), F.lit("/"), paths.basename(F.col("path")))).alias("path"), F.when(n % 5 == 0, F.lit("same")).otherwise(F.col("content_hash")).alias("content_hash"))


def _plan(g: Graph) -> DataFrame:
    return incremental.invalidation(_versions(Graph(g.spark, g.dir, EARLIER)), _versions(g))


VERSIONS = """versions as (select 'S' || l_suppkey as file_uid, regexp_extract(f.path, '^(.*)/[^/]*$', 1) || case when l_suppkey % 9 = 0 then '/pkg' || l_suppkey || '/package.json' else '/pkg' || (l_suppkey - l_suppkey % 9) || '/' || regexp_extract(f.path, '([^/]*)$', 1) end as path,
  case when l_suppkey % 5 = 0 then 'same' else h end as content_hash from (select l_suppkey, md5(count(*) || ':' || sum(l_linenumber)) as h from li group by 1) v join files f on f.uid = 'S' || l_suppkey)"""
PLAN = f"""with c as ({projected('+ ' + VERSIONS + ' select * from versions')}), p as ({projected('+ ' + VERSIONS + ' select * from versions', EARLIER)}),
k as (select coalesce(c.file_uid, p.file_uid) as file_uid, coalesce(c.path, p.path) as path, case when c.file_uid is null then 'deleted' when p.file_uid is null then 'new' when c.content_hash = p.content_hash then 'unchanged' else 'changed' end as k from c full join p on p.file_uid = c.file_uid),
s as (select distinct regexp_extract(path, '^(.*)/[^/]*$', 1) as d from k where k = 'changed' and regexp_matches(path, '(^|/)package\\.json$')),
plan as (select file_uid, path, case when k = 'unchanged' and exists (select 1 from s where starts_with(k.path, s.d || '/')) then 'config_widened' else k end as disposition from k),
planned as (select *, case disposition when 'unchanged' then 'copy' when 'deleted' then 'delete' else 'extract' end as action from plan)"""


@query(PLAN + " select * from planned", plain=True)
def invalidation_plan(g):
    return _plan(g)


@query(PLAN + " select disposition, action, count(*) as files from planned group by 1, 2", plain=True)
def copy_forward_counts(g):
    return _plan(g).groupBy("disposition", "action").agg(F.count("*").alias("files"))


@query()
def copy_forward_nodes(g):
    """Symbols of unchanged files and their calls, under the new snapshot's uids."""
    nodes, edges = incremental.copy_forward(g.symbols().select("uid", "file_uid"), g.calls(), _plan(g), "child")
    a, b = nodes.agg(F.count("*").alias("nodes"), F.countDistinct("new_uid").alias("uids")), edges.agg(F.count("*").alias("edges"))
    return a.crossJoin(F.broadcast(b))  # one row each


TABLES = PROJECTION_SQL.format(where="").strip()
ORACLE_SQL["copy_forward_nodes"] = f"{PLAN}, {TABLES}, kept as (select uid from symbols where file_uid in (select file_uid from planned where action = 'copy')) select (select count(*) from kept) as nodes, (select count(*) from kept) as uids, (select count(*) from calls where src in (select uid from kept)) as edges"
ORACLE_SQL["change_impact"] = f"""{PLAN.replace('with c as', 'with recursive c as', 1)}, {TABLES}, seeds as (select distinct f.module_uid as node from planned p join files f on f.uid = p.file_uid where p.disposition = 'changed'),
  walk as (select node, 0::bigint as depth from seeds union select i.src, w.depth + 1 from walk w join module_imports i on i.dst = w.node where w.depth < 25) select m.path, min(depth) as depth from walk w join modules m on m.uid = w.node group by 1"""


# Events


def _events(g: Graph) -> DataFrame:
    return windows.timed(g.table("events"))


@query("select time_bucket(interval 1 hour, ts) as window_start, time_bucket(interval 1 hour, ts) + interval 1 hour as window_end, event_type, count(*) as n, max(value) as greatest from events group by 1, 2, 3", plain=True)
def events_tumbling(g):
    return windows.tumbling(_events(g))


@query("""with b as (select time_bucket(interval 30 minutes, ts) as s, * from events), w as (select s as window_start, event_type, value from b union all select s - interval 30 minutes, event_type, value from b)
  select window_start, window_start + interval 1 hour as window_end, event_type, count(*) as n, max(value) as greatest from w group by 1, 2, 3""", plain=True)
def events_sliding(g):
    return windows.sliding(_events(g))


@query("""with m as (select *, case when ts < lag(ts) over w + interval 30 minutes then 0 else 1 end as fresh from events window w as (partition by user_id order by ts)), s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from m)
  select user_id, count(*) as n, min(ts) as session_start, max(ts) + interval 30 minutes as session_end from s group by user_id, k""", plain=True)
def events_session(g):
    return windows.sessions(_events(g))


@query("select count(*) as events, count(distinct event_id) as ids from (select distinct on (event_id) event_id from events)", plain=True)
def events_dedup(g):
    return windows.deduplicated(_events(g)).agg(F.count("*").alias("events"), F.countDistinct("event_id").alias("ids"))


@query("select user_id, event_id, ts, event_type, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1", plain=True)
def events_latest_per_user(g):
    return windows.latest_per_user(_events(g))


# Explanations


EXPLAINED = """+ deg as (select src, count(*) as n from calls group by 1), seed as (select src as key from deg order by n desc, src limit 1),
items as (select 'callers' as section, src as item from calls where dst in (select key from seed) union select 'callees', dst from calls where src in (select key from seed)),
ranked as (select *, row_number() over (partition by section order by item) as rank, count(*) over (partition by section) as n from items)"""


@query(EXPLAINED + " select section, item, rank, greatest(n - 15, 0) as omitted from ranked where rank <= 15")
def explain_symbols(g):
    """Callers and callees of the symbol with most callees, at most 15 of each section."""
    seed = _seed(g)
    callers = lookup.neighbours(g.calls(), g.symbols(), g.files(), "callers").join(seed.toDF("key"), "key", "left_semi").select("neighbour")
    callees = lookup.neighbours(g.calls(), g.symbols(), g.files(), "callees").join(seed.toDF("key"), "key", "left_semi").select("neighbour")
    return agent.explain({"callers": callers, "callees": callees})
