"""Queries whose answer needs iteration over a graph: components, rings of any length, paths with steps, liveness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import graph
from ..sources.projection import Graph
from .catalogue import DEAD_SQL, ORACLE_SQL, SEED, _recursive, _seed, query
from .literals import table

# Steps: one for each line of an order. A step goes on to the order's next line; every third order closes a ring; a fifth
# of all customers have rings over all of their orders; in every fortieth order the first line also goes to the third.
STEPS = """
s as (select distinct o_custkey as c, l_orderkey as o, l_linenumber as l, 'N' || l_orderkey || '.' || l_linenumber as node from lineitem join orders on l_orderkey = o_orderkey),
p as (select *, lead(node) over (partition by o order by l) as next1, lead(node, 2) over (partition by o order by l) as next2, row_number() over (partition by o order by l) as k,
             first(node) over (partition by o order by l) as home, lead(node) over (partition by c order by o, l) as on_, first(node) over (partition by c order by o, l) as top from s),
steps as (select distinct src, dst from (
  select node as src, next1 as dst from p union all select node, on_ from p where next1 is null and c % 5 = 0 union all select node, home from p where next1 is null and o % 3 = 0
  union all select node, top from p where on_ is null and c % 5 = 0 union all select node, next2 from p where k = 1 and o % 40 = 0) where dst is not null and src <> dst)"""


def _steps(g: Graph) -> DataFrame:
    """Steps, an order's from the rows of the order; only what leads from order to order meets by customer. A step may
    stand twice."""
    lines = g.table("lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("l")).distinct().join(g.table("orders").select(F.col("o_orderkey").alias("o"), F.col("o_custkey").alias("c")), "o")
    lines = lines.groupBy("c", "o").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    name = lambda l: F.concat(F.lit("N"), F.col("o").cast("string"), F.lit("."), l.cast("string"))
    p = lines.select("c", "o", F.transform("ls", name).alias("n"))
    step = lambda src, dst: F.struct(src.alias("src"), dst.alias("dst"))
    at = lambda k: F.get("n", F.lit(k))
    last = F.element_at("n", -1)
    within = F.zip_with(F.slice("n", F.lit(1), F.size("n") - 1), F.slice("n", F.lit(2), F.size("n")), step)
    extra = F.array(F.when((F.col("o") % 3 == 0), step(last, at(0))), F.when((F.col("o") % 40 == 0), step(at(0), at(2))))
    customer = Window.partitionBy("c").orderBy("o")
    across = p.filter("c % 5 = 0").select(last.alias("src"), F.lead(at(0)).over(customer).alias("_on"), F.first(at(0)).over(customer).alias("_top")).select("src", F.coalesce("_on", "_top").alias("dst"))
    return p.select(F.explode(F.concat(within, F.array_compact(extra))).alias("s")).select("s.src", "s.dst").unionByName(across).filter("dst is not null and src <> dst")


REACH = f"{STEPS}, reach as (select src as a, dst as b from steps union select r.a, e.dst from reach r join steps e on e.src = r.b)"


@query()
def strongly_connected_components(g):
    """Each step on a ring, with the smallest step of its component."""
    return graph.strongly_connected(_steps(g))


ORACLE_SQL["strongly_connected_components"] = f"with recursive {REACH} select r.a as node, min(r.b) as component from reach r join reach t on t.a = r.b and t.b = r.a group by 1"

WALK = f"""{STEPS}, walk as (select src as start, dst as at, [src, dst] as p from steps where src < dst and src in (select dst from steps where dst < src)
    union all select w.start, e.dst, list_append(w.p, e.dst) from walk w join steps e on e.src = w.at where e.dst > w.start and not list_contains(w.p, e.dst)),
  rings as (select array_to_string(w.p, ',') as members, len(w.p) as length from walk w join steps e on e.src = w.at and e.dst = w.start)"""


@query()
def cycles_of_any_length(g):
    """All rings of steps, numbered in the order of their members."""
    return graph.numbered_rings(graph.rings(_steps(g)))


ORACLE_SQL["cycles_of_any_length"] = f"with recursive {WALK} select 'cycle-' || row_number() over (order by members) as cycle_id, members, length from rings"


@query()
def cycles_through_each_step(g):
    """Of every step on a ring: how many rings pass through it, and the shortest and longest of them."""
    rows = graph.rings(_steps(g)).select(F.explode("members").alias("node"), "length")
    return rows.groupBy("node").agg(F.count("*").alias("cycles"), F.min("length").alias("shortest"), F.max("length").alias("longest"))


ORACLE_SQL["cycles_through_each_step"] = f"with recursive {WALK} select node, count(*) as cycles, min(length) as shortest, max(length) as longest from (select unnest(string_split(members, ',')) as node, length from rings) group by 1"

# Calls between symbols, and references of ten kinds between them, eight of which keep their target alive.
KINDS = (*graph.ALIVE_BY, "READS", "DOCUMENTS")
REFERENCES = f"""refs as (select distinct 'P' || a as src, 'P' || b as dst, {list(KINDS)}[(a + b) % 10 + 1] as type
   from (select lag(l_partkey) over (partition by l_orderkey order by l_linenumber, l_partkey) as a, l_partkey as b, l_quantity as q from li) where a is not null and a <> b and q between 28 and 32),
  links as (select src, dst, 'CALLS' as type from calls union select src, dst, type from refs)"""


def _links(g: Graph) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    rows = g.lineitem().select(F.lag("l_partkey").over(order).alias("a"), F.col("l_partkey").alias("b"), "l_quantity").filter("a is not null and a <> b and l_quantity between 28 and 32")
    kind = F.element_at(F.array(*(F.lit(k) for k in KINDS)), ((F.col("a") + F.col("b")) % 10 + 1).cast("int"))
    refs = rows.select(F.concat(F.lit("P"), F.col("a").cast("string")).alias("src"), F.concat(F.lit("P"), F.col("b").cast("string")).alias("dst"), kind.alias("type"))
    return g.calls().withColumn("type", F.lit("CALLS")).unionByName(refs).distinct()


@query(f"{DEAD_SQL}, {REFERENCES} select * from dead where uid not in (select dst from links where type in {graph.ALIVE_BY})")
def dead_nodes_by_all_edges(g):
    """Symbols that no edge of any kind that keeps its target alive leads to."""
    return graph.dead_nodes(g.symbols(), _links(g), g.files(), table(g.spark, "entrypoints"), table(g.spark, "inferences"))


@query()
def shortest_path_steps(g):
    """Symbol, file, line and kind of edge at each step of the smallest shortest path to the largest key four steps away."""
    seed, links = graph.written(_seed(g)), graph.written(_links(g))
    goal = graph.levels(links, seed, 4, held=True).filter("depth = 4").agg(F.max("node")).first()[0]
    homes = g.files().select(F.col("uid").alias("file_uid"), F.col("path").alias("file"))
    nodes = g.symbols().join(homes, "file_uid", "left").select(F.col("uid").alias("node"), "name", "file", F.col("line_start").alias("line"))
    return graph.path_steps(links, nodes, seed.first()[0], goal or "", 8, held=True)


ORACLE_SQL["shortest_path_steps"] = _recursive(f"""+ {SEED}, {REFERENCES}, walk as (select node, 0::bigint as depth from seed union select l.dst, w.depth + 1 from walk w join links l on l.src = w.node where w.depth < 4),
  least as (select node, min(depth) as depth from walk group by 1), goal as (select max(node) as node from least where depth = 4),
  back as (select node, 4::bigint as depth from goal union select l.src, b.depth - 1 from back b join links l on l.dst = b.node join least on least.node = l.src and least.depth = b.depth - 1),
  paths as (select node as at, [node] as p from seed union all select b.node, list_append(x.p, b.node) from paths x join links l on l.src = x.at join back b on b.node = l.dst and b.depth = len(x.p)),
  best as (select min(p) as p from paths where len(p) = 5),
  steps as (select k - 1 as step, p[k] as node, case when k > 1 then p[k - 1] end as prior from best, unnest(range(1, 6)) t(k))
  select true as found, step, st.node, s.name, f.path as file, s.line_start::bigint as line, (select min(type) from links l where l.src = prior and l.dst = st.node) as edge_type
  from steps st left join symbols s on s.uid = st.node left join files f on f.uid = s.file_uid""")


@query("select false as found, null::bigint as step, null::varchar as node, null::varchar as name, null::varchar as file, null::bigint as line, null::varchar as edge_type from (select count(*) from calls where dst = 'none') where true")
def shortest_path_to_nowhere(g):
    """A goal that doesn't exist gives one row that says so."""
    nodes = g.symbols().select(F.col("uid").alias("node"), "name", F.lit(None).cast("string").alias("file"), F.col("line_start").alias("line"))
    return graph.path_steps(g.calls().withColumn("type", F.lit("CALLS")), nodes, _seed(g).first()[0], "none", 2)
