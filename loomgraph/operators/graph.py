"""Set differences, reachability and cycles."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import chain, product

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Kinds of edge whose target is alive.
ALIVE_BY = ("IMPORTS", "CALLS", "IMPLEMENTS", "INSTANTIATES", "ROUTES_TO", "REGISTERED_BY", "TESTED_BY", "COVERS")
#: Inferences that keep a symbol alive.
LIVENESS = ("framework_entrypoint", "spring_container_managed", "pytest_test", "pytest_fixture", "linux_system_managed")

#: A component's rings are found in one task if it has at most so many edges, and so many fewer choices than these.
HELD, CHOICES = 10_000, 16


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's, or a local one in local runs."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if found is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(found or f"file:///tmp/loomgraph-{uuid.uuid4().hex}")
    return context._jsc.sc().getCheckpointDir().get()


def _cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a loop's table."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The table, written once under the shared folder. Unlike a checkpoint it tells Spark its true size, and each reader
    scans only the columns that it needs."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over tasks by key, before work that is long for few bytes: the number follows the cluster, four times
    its cores and no less than its shuffle partitions."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), *keys)


def in_bounded_tasks(df: DataFrame, *keys: str, most: int = 2_000_000) -> DataFrame:
    """Rows dealt by key over as many tasks as hold ``most`` rows each on average, so the memory of one doesn't grow with
    the table. The rows are counted first."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-df.count() // most)), *keys)


def dead_nodes(symbols: DataFrame, calls: DataFrame, files: DataFrame, entrypoints: DataFrame | None = None, inferences: DataFrame | None = None, min_lines: int | None = None) -> DataFrame:
    """Symbols that nothing refers to, no declared entry point names and no liveness inference keeps.

    ``calls`` are edges src, dst; if they have a type, those of ``ALIVE_BY`` keep their target alive and no others.
    """
    if "type" in calls.columns:
        calls = calls.filter(F.col("type").isin(*ALIVE_BY))
    dead = symbols.join(calls.select(F.col("dst").alias("uid")), "uid", "left_anti")
    if entrypoints is not None:
        dead = dead.join(entrypoints.select(F.col("target_uid").alias("uid")), "uid", "left_anti")
    if inferences is not None:
        dead = dead.join(inferences.filter(F.col("kind").isin(*LIVENESS)).select(F.col("target_uid").alias("uid")), "uid", "left_anti")
    lines = (F.col("line_end") - F.col("line_start") + 1).alias("line_count")
    out = dead.join(files.select(F.col("uid").alias("file_uid"), F.col("path").alias("file"), "is_test"), "file_uid", "left").select("uid", "name", "subtype", "file", lines, F.coalesce("is_test", F.lit(False)).alias("is_test"))
    return out.filter(F.col("line_count") >= min_lines) if min_lines is not None else out


def mutual(edges: DataFrame) -> DataFrame:
    """a < b with an edge each way."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.join(back, ["src", "dst"], "left_semi").filter("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()


def path_prefix_cycles(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Mutual imports between a module and one above it: ancestor and descendant paths."""
    a, b = modules.select(F.col("uid").alias("a"), F.col("path").alias("_pa")), modules.select(F.col("uid").alias("b"), F.col("path").alias("_pb"))
    pairs = mutual(edges).join(a, "a").join(b, "b")
    above = F.col("_pb").startswith(F.concat("_pa", F.lit("/")))
    below = F.col("_pa").startswith(F.concat("_pb", F.lit("/")))
    return pairs.filter(above | below).select(F.when(above, F.col("_pa")).otherwise(F.col("_pb")).alias("ancestor"), F.when(above, F.col("_pb")).otherwise(F.col("_pa")).alias("descendant"))


def cycles(edges: DataFrame, max_len: int) -> DataFrame:
    """Simple cycles of up to ``max_len`` nodes, each once, from its smallest node: members (array), length.

    Paths only grow through nodes above their start, so each ring is found from its smallest member alone.
    """
    step = edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d"))
    paths = edges.filter("src < dst").select(F.array("src", "dst").alias("p"))
    found = None
    for length in range(2, max_len + 1):
        last = F.element_at("p", -1)
        closing = paths.join(step, (last == F.col("_s")) & (F.element_at("p", 1) == F.col("_d"))).select(F.col("p").alias("members"), F.lit(length).cast("long").alias("length"))
        found = closing if found is None else found.unionByName(closing)
        if length < max_len:
            paths = paths.join(step, last == F.col("_s")).filter((F.col("_d") > F.element_at("p", 1)) & ~F.array_contains("p", F.col("_d"))).select(F.concat("p", F.array("_d")).alias("p"))
    return found


def canonical_ring(members):
    """Rotate a ring so that its smallest member comes first."""
    at = F.array_position(members, F.array_min(members)).cast("int")
    return F.concat(F.slice(members, at, F.size(members)), F.slice(members, 1, at - 1))


def strongly_connected_core(edges: DataFrame) -> DataFrame:
    """Edges that can lie on a cycle: sources without incoming and targets without outgoing edges fall away in turn."""
    left, n = written(edges.select("src", "dst").distinct()), None
    while True:
        now = left.count()
        if now == n:
            return left
        n = now
        left = written(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))


def chains(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges without their pass-through nodes, and what those were: (src, dst, inner) and (node, src, dst).

    A node with one edge in and one out only passes a ring on, so it lies on a ring with both its neighbours or on none.
    Runs of them become one edge; ``inner`` has their nodes in order. A ring of such nodes alone keeps its smallest.
    """
    plain = written(edges.filter("src <> dst").select("src", "dst").distinct())
    out = plain.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("_out"), F.min("dst").alias("to")).filter("_out = 1")
    in_ = plain.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("_in"), F.min("src").alias("back")).filter("_in = 1")
    passing = written(out.join(in_, "node").select("node", "to", "back"))
    ended, closed = _ways(passing)
    order = lambda at: F.reverse(F.array_sort(F.collect_list(F.struct(at, "node"))))
    runs = ended.groupBy("last").agg(order("steps").alias("_run"), F.max_by("back", "steps").alias("src"), F.first("to").alias("dst")).select("src", "dst", F.col("_run.node").alias("inner"))
    rings_ = closed.groupBy("least").agg(order("at").alias("_run")).select(F.col("least").alias("src"), F.col("least").alias("dst"), F.expr("slice(_run.node, 2, size(_run) - 1)").alias("inner"))
    joined = written(runs.unionByName(rings_))
    inside = passing.select("node")
    direct = plain.join(inside.withColumnRenamed("node", "src"), "src", "left_anti").join(inside.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst", F.array().cast("array<string>").alias("inner"))
    return joined.unionByName(written(direct)), joined.select(F.explode("inner").alias("node"), "src", "dst")


def _ways(passing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where the ways of nodes with one way each (node, to, back) end, and the rings that they close.

    Ended: node, to (the first node on its way that isn't one of them), back, last (the one before it), steps. Closed:
    node, least (the smallest of its ring), at (steps to it, from 1).

    Pointers double, in as many rounds as the longest way has binary digits. A row is written until its way has ended or
    closed: it is closed when the stretch ahead of it and the next one have one smallest node, which then stands twice on
    its way, or when its pointer meets a closed row. Of the rows that have ended, later rounds read those of ways that
    still grew in the last one; all rows of a ring close in two rounds that follow each other.
    """
    here = passing.select(F.col("node").alias("to"), F.lit(True).alias("_on"))
    one = F.lit(1).cast("long")
    state = written(passing.join(here, "to", "left").select("node", "to", "back", F.when(F.col("_on").isNull(), F.col("node")).alias("last"), one.alias("steps"), F.col("to").alias("least"), one.alias("at"), F.lit(False).alias("closed")))
    done, asked = [], None
    while True:
        new = state.filter("last is not null")
        done.append(state.filter("last is not null or closed"))
        open_ = state.filter("last is null and not closed")
        if open_.isEmpty():
            break
        known = new if asked is None else asked.unionByName(new.select(*asked.columns))
        asked = written(known.join(new.select("last").distinct(), "last", "left_semi").select("node", "to", "last", "steps", "least", "at", "closed"))
        ahead = asked.unionByName(state.filter("last is null").select(*asked.columns)).select(F.col("node").alias("to"), *(F.col(c).alias(f"_{c}") for c in ("to", "last", "steps", "least", "at", "closed")))
        lower, same = F.col("_least") < F.col("least"), F.col("_least") == F.col("least")
        state = written(open_.join(ahead, "to").select("node", F.col("_to").alias("to"), "back", F.col("_last").alias("last"), (F.col("steps") + F.col("_steps")).alias("steps"), F.least("least", "_least").alias("least"), F.when(lower, F.col("steps") + F.col("_at")).otherwise(F.col("at")).alias("at"), (F.col("_last").isNull() & (same | F.col("_closed"))).alias("closed")))
    found = reduce(DataFrame.unionByName, done)
    return found.filter("last is not null").select("node", "to", "back", "last", "steps"), found.filter("closed").select("node", "least", "at")


def strongly_connected(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node on some ring; nodes on none have no row.

    Pass-through nodes go first (``chains``), then what can't lie on a ring. The rest is coloured: each node takes the
    first node that reaches it, in an order by hash; the nodes of a colour that reach the one it is named after are a
    component. Edges between colours lie on no ring and go, and so on until nothing is left; as the order has nothing to
    do with the edges, a row of components is cut at several places at once. Loops of one node don't count.
    """
    short, passed = chains(edges)
    return written(_components(short, passed))


def _components(short: DataFrame, passed: DataFrame) -> DataFrame:
    done = short.filter("src = dst").select(F.col("src").alias("node"), F.col("src").alias("component")).distinct()
    left = strongly_connected_core(short.filter("src <> dst"))
    while not left.isEmpty():
        nodes = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
        colours, seen = written(nodes.withColumn("colour", F.struct(F.xxhash64("node").alias("at"), "node"))), None
        while True:
            now = colours.agg(F.sum(F.xxhash64("node", "colour").cast("decimal(38,0)"))).first()[0]
            if now == seen:
                break
            seen = now
            sent = left.join(colours.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "colour")
            colours = written(colours.unionByName(sent).groupBy("node").agg(F.min("colour").alias("colour")))
        colours = colours.select("node", F.col("colour.node").alias("colour"))
        of = lambda c: colours.toDF(c, f"_{c}")
        left = written(left.join(of("src"), "src").join(of("dst"), "dst").filter("_src = _dst").select("src", "dst"))
        reached = levels(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")), colours.filter("node = colour"), None, held=True)
        found = written(colours.join(reached.select("node"), "node", "left_semi"))
        several = found.groupBy("colour").count().filter("count > 1").select("colour")
        done = written(done.unionByName(found.join(several, "colour", "left_semi").select("node", F.col("colour").alias("component"))))
        gone = found.select("node")
        left = strongly_connected_core(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))
    done = done.groupBy("node").agg(F.min("component").alias("component"))  # a loop's own node may be part of more
    ends = passed.join(done.toDF("src", "component"), "src").join(done.toDF("dst", "_c"), "dst").filter("component = _c").select("node", "component")
    whole = written(done.unionByName(ends))
    names = whole.groupBy("component").agg(F.min("node").alias("_name"))
    return whole.join(names, "component").select("node", F.col("_name").alias("component"))


def weak_components(edges: DataFrame) -> DataFrame:
    """node, label (the smallest node of its component, whichever way the edges lead) of every node with an edge.

    In a round each node, and the node it is labelled by, takes the smallest label beyond its edges, then the label of its
    label; labels are trees that hook onto each other, so the rounds grow with the logarithm of a component's size.
    """
    both = written(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    labels, seen = written(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("src"), F.min("dst")).alias("label"))), None
    while True:
        now = labels.agg(F.sum(F.xxhash64("node", "label").cast("decimal(38,0)"))).first()[0]
        if now == seen:
            return labels
        seen = now
        beyond = both.join(labels.toDF("src", "_own"), "src").join(labels.toDF("dst", "label"), "dst").groupBy("src", "_own").agg(F.min("label").alias("label"))
        offers = beyond.select(F.explode(F.array("src", "_own")).alias("node"), "label")
        hooked = written(labels.unionByName(offers).groupBy("node").agg(F.min("label").alias("label")))
        labels = written(hooked.join(hooked.toDF("label", "_next"), "label").select("node", F.least("label", "_next").alias("label")))


def rings_of(edges: list[tuple[str, str, list[str]]]) -> Iterator[list[str]]:
    """Members of every ring of two nodes or more in a few edges (src, dst, inner), each ring from the smallest of its ends
    on. Paths grow among the nodes that lie on a ring with their start and are above it, one at a time."""
    ways: dict[str, dict[str, list[list[str]]]] = {}
    for src, dst, inner in edges:
        ways.setdefault(src, {}).setdefault(dst, []).append(inner)
    back: dict[str, list[str]] = {}
    for src, found in ways.items():
        for dst in found:
            back.setdefault(dst, []).append(src)

    def reached(start: str, steps: dict) -> set[str]:
        seen, todo = {start}, [start]
        while todo:
            more = [n for n in steps.get(todo.pop(), ()) if n > start and n not in seen]
            seen.update(more)
            todo += more
        return seen

    for start in sorted(ways):
        among = reached(start, ways) & reached(start, back)
        path, on, todo = [start], {start}, [iter(ways[start])]
        while todo:
            node = next(todo[-1], None)
            if node is None:
                todo.pop()
                on.discard(path.pop())
            elif node == start:
                steps = list(zip(path, [*path[1:], start], strict=True))
                for inner in product(*(ways[x][y] for x, y in steps)):
                    yield [n for x, run in zip(path, inner, strict=True) for n in (x, *run)]
            elif node in among and node not in on:
                path.append(node)
                on.add(node)
                todo.append(iter(ways[node]))


def _rings_within(edges: DataFrame) -> DataFrame:
    """members of the rings of edges (label, src, dst, inner), for each label on its own, in one task; they leave it in batches."""

    def run(batches):
        held, label, out, size = [], None, [], 0
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        for own, *edge in chain(rows, [(None,)]):
            if own != label:
                for members in rings_of(held):
                    out.append(members)
                    size += len(members)
                    if size > 200_000:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string()))], ["members"])
                        out, size = [], 0
                held, label = [], own
            held.append(tuple(edge))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string()))], ["members"])

    return dealt(edges.select("label", "src", "dst", "inner"), "label").sortWithinPartitions("label").mapInArrow(run, "members array<string>")


def rings(edges: DataFrame) -> DataFrame:
    """Every simple cycle of two nodes or more, whatever its length: members (from the smallest, in order), length.

    Cycles lie within weakly connected components of the edges without pass-through nodes, and those of a component in
    which few choices are left (``CHOICES`` edges more than a tree has, ``HELD`` edges at most) are found in one task, of
    which there are at most 2 to that power. In larger ones paths grow over all tasks, within strongly connected
    components, in as many rounds as a ring has nodes with a choice; a ring is found from the smallest of these alone.
    There may be exponentially many; that is the question's nature and not this function's.
    """
    short, passed = chains(edges)
    core = strongly_connected_core(short.filter("src <> dst"))
    labels = weak_components(core)
    step = written(short.join(core, ["src", "dst"], "left_semi").join(labels.withColumnRenamed("node", "src"), "src").select("label", "src", "dst", "inner"))
    sizes = step.groupBy("label").agg(F.count("*").alias("_edges")).join(labels.groupBy("label").agg(F.count("*").alias("_nodes")), "label")
    large = written(sizes.filter((F.col("_edges") - F.col("_nodes") >= CHOICES) | (F.col("_edges") > HELD)).select("label"))
    loops = short.filter("src = dst").select(F.concat(F.array("src"), "inner").alias("members"))
    found = [loops, written(_rings_within(step.join(large, "label", "left_anti")))]
    if not large.isEmpty():
        found += _grown_rings(step.join(large, "label", "left_semi").select("src", "dst", "inner"), passed)
    out = reduce(DataFrame.unionByName, found)
    return out.select(canonical_ring(F.col("members")).alias("members"), F.size("members").cast("long").alias("length"))


def _grown_rings(short: DataFrame, passed: DataFrame) -> list[DataFrame]:
    """members of the rings of edges without loops, by length."""
    home = _components(short, passed)
    inner = short.join(home.toDF("src", "_a"), "src").join(home.toDF("dst", "_b"), "dst").filter("_a = _b").select("src", "dst", "inner")
    step = written(inner.select(F.col("src").alias("_s"), F.col("dst").alias("_d"), "inner"))
    found, paths = [], written(step.filter("_s < _d").select(F.array("_s", "_d").alias("p"), F.concat(F.array("_s"), "inner").alias("members")))
    while not paths.isEmpty():
        grown = written(paths.join(step, F.element_at("p", -1) == F.col("_s")).select("p", "_d", F.concat("members", F.array("_s"), "inner").alias("members")))
        found.append(grown.filter(F.element_at("p", 1) == F.col("_d")).select("members"))
        paths = written(grown.filter((F.col("_d") > F.element_at("p", 1)) & ~F.array_contains("p", F.col("_d"))).select(F.concat("p", F.array("_d")).alias("p"), "members"))
    return found


def numbered_rings(found: DataFrame) -> DataFrame:
    """cycle_id (cycle-1, ... in the order of members), members (joined by commas), length. Ranges of members are sorted
    and numbered each on its own."""
    rows = written(found.select(F.array_join("members", ",").alias("members"), "length"))
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    ranged = written(rows.repartitionByRange(n, "members").withColumn("_part", F.spark_partition_id()))
    sizes = dict(ranged.groupBy("_part").count().collect())  # as many rows as partitions
    before = [sum(k for q, k in sizes.items() if q < p) for p in range(max(sizes, default=0) + 1)]
    own = Window.partitionBy("_part").orderBy("members")
    at = F.row_number().over(own) + F.element_at(F.array(*(F.lit(b).cast("long") for b in before)), F.col("_part") + 1)
    return ranged.select(F.concat(F.lit("cycle-"), at.cast("string")).alias("cycle_id"), "members", "length")


def levels(edges: DataFrame, seeds: DataFrame, max_depth: int | None, held: bool = False) -> DataFrame:
    """node, depth: least number of edges from any seed (depth 0), breadth first.

    Each level is new nodes only, so rows stay within the number of nodes whatever the number of walks. Levels are cut
    from their lineage; the loop ends by itself where nothing new is found. Edges are made once for all levels: they are
    written first, unless they are ``held`` in files already.
    """
    step = edges.select(F.col("src").alias("node"), F.col("dst").alias("_next"))
    step = step if held else written(step)
    seen = frontier = written(seeds.select("node").distinct().withColumn("depth", F.lit(0).cast("long")))
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        fresh = frontier.join(step, "node").select(F.col("_next").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        frontier = written(fresh.withColumn("depth", F.lit(depth).cast("long")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def shortest_path(edges: DataFrame, start: str, goal: str, max_depth: int, held: bool = False) -> list[str] | None:
    """The nodes of a shortest path (of several, the smallest in order), or None if there is none within ``max_depth``.

    Both ends are searched, always from the smaller frontier, with one row for each node and level. From where they meet
    the levels are walked back, keeping the nodes that lie on a shortest path; only the path itself comes to the driver.
    ``held``: see ``levels``.
    """
    spark = edges.sparkSession
    edges = edges if held else written(edges.select("src", "dst"))
    ways = {1: edges.select(F.col("src").alias("node"), F.col("dst").alias("_next")), -1: edges.select(F.col("dst").alias("node"), F.col("src").alias("_next"))}
    layers = {way: [written(spark.createDataFrame([(end,)], "node string"))] for way, end in ((1, start), (-1, goal))}
    seen, sizes = {way: found[0] for way, found in layers.items()}, {1: 1, -1: 1}
    if start == goal:
        return [start]
    while len(layers[1]) + len(layers[-1]) - 2 < max_depth:
        way = 1 if sizes[1] <= sizes[-1] else -1
        fresh = layers[way][-1].join(ways[way], "node").select(F.col("_next").alias("node")).distinct().join(seen[way], "node", "left_anti")
        layers[way].append(written(fresh))
        sizes[way] = layers[way][-1].count()
        if not sizes[way]:
            return None
        seen[way] = seen[way].unionByName(layers[way][-1])
        meet = layers[1][-1].join(layers[-1][-1], "node", "left_semi")
        if not meet.isEmpty():
            break
    else:
        return None
    meet = written(meet)
    there, back = [meet], [meet]
    for kept, own, way in ((there, layers[1], -1), (back, layers[-1], 1)):
        for layer in reversed(own[:-1]):
            near = kept[-1].join(ways[way], "node").select(F.col("_next").alias("node")).distinct()
            kept.append(written(layer.join(near, "node", "left_semi")))
    path = [start]
    for layer in [*reversed(there[:-1]), *back[1:]]:  # each holds what can come next on a shortest path
        path.append(ways[1].filter(F.col("node") == path[-1]).select(F.col("_next").alias("node")).join(layer, "node", "left_semi").agg(F.min("node")).first()[0])
    return path


def path_steps(edges: DataFrame, nodes: DataFrame, start: str, goal: str, max_depth: int, held: bool = False) -> DataFrame:
    """found, step, node, name, file, line, edge_type of a shortest path; one row with found = false if there is none.

    ``edges``: src, dst, type; a step's type is that of the edge that leads to it, of several the smallest. ``nodes``:
    node, name, file, line. ``held``: see ``levels``.
    """
    edges = edges if held else written(edges)
    path = shortest_path(edges, start, goal, max_depth, held=True)
    if path is None:
        return edges.sparkSession.createDataFrame([(False,) + (None,) * 6], "found boolean, step long, node string, name string, file string, line long, edge_type string")
    steps = edges.sparkSession.createDataFrame([(i, n, path[i - 1] if i else None) for i, n in enumerate(path)], "step long, node string, _from string")  # max_depth + 1 rows at most
    types = edges.join(F.broadcast(steps.select(F.col("_from").alias("src"), F.col("node").alias("dst"))), ["src", "dst"], "left_semi").groupBy("src", "dst").agg(F.min("type").alias("edge_type"))
    told = nodes.join(F.broadcast(steps.select("node")), "node", "left_semi")
    out = steps.join(told, "node", "left").join(types.withColumnsRenamed({"src": "_from", "dst": "node"}), ["_from", "node"], "left")
    return out.select(F.lit(True).alias("found"), "step", "node", "name", "file", F.col("line").cast("long").alias("line"), "edge_type")


def reverse_impact(module_imports: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Modules that depend on the seeds, and at which distance; seeds themselves are distance 0."""
    back = module_imports.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return levels(back, seeds, max_depth)


def ancestor_modules(files: DataFrame) -> DataFrame:
    """Every directory above a file, once, with how many files lie below it."""
    from ..functions.paths import ancestors

    return files.select(F.explode(ancestors(F.col("path"))).alias("path"), "uid").groupBy("path").agg(F.countDistinct("uid").alias("files"))


def numbered(df: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """1-based numbers in a total order of a result that is small by meaning (signals, cycles)."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
