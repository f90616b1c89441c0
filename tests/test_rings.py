"""Components, rings and paths against plain recursion."""

from __future__ import annotations

import random

from helpers import rows
from loomgraph.operators import graph


def by_hand(edges):
    ways = {}
    for a, b in edges:
        if a != b:
            ways.setdefault(a, set()).add(b)
    rings, reach = [], {}

    def walk(start, path):
        for b in ways.get(path[-1], ()):
            if b == start:
                rings.append(path)
            elif b > start and b not in path:
                walk(start, [*path, b])

    for a in ways:
        walk(a, [a])
        seen, todo = set(), [a]
        while todo:
            for b in ways.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[a] = seen
    return sorted((r, len(r)) for r in rings), {a: min(b for b in reach[a] if a in reach.get(b, ())) for a in ways if a in reach[a]}


def test_rings_and_components(spark):
    """Random graphs, a ring with a chord and a tail, one of pass-through nodes alone, a row of rings, loops, repeats."""
    rnd = random.Random(1)
    edges = {(f"g{k}.{rnd.randrange(7)}", f"g{k}.{rnd.randrange(7)}") for k in range(4) for _ in range(13)}
    edges |= {(f"r{i}", f"r{(i + 1) % 12}") for i in range(12)} | {("r4", "x"), ("x", "r9"), ("r2", "tail"), ("tail", "tail2"), ("in", "r0")}
    edges |= {(f"p{i}", f"p{(i + 1) % 9}") for i in range(9)} | {("lone", "lone")}
    edges |= {(f"s{i}.{j}", f"s{i}.{(j + 1) % 2}") for i in range(4) for j in range(2)} | {(f"s{i}.0", f"s{i + 1}.1") for i in range(3)}
    found, components = by_hand(edges)
    df = spark.createDataFrame([*sorted(edges), ("p0", "p1"), (None, "p1")], "src string, dst string")
    assert {r.node: r.component for r in graph.strongly_connected(df).collect()} == components
    got = graph.rings(df)
    assert sorted((r.members, r.length) for r in got.collect()) == found and max(n for _, n in found) == 12
    named = graph.numbered_rings(got).collect()
    assert [r.cycle_id for r in sorted(named, key=lambda r: r.members)] == [f"cycle-{i + 1}" for i in range(len(found))]


def test_rings_of_small_components_need_no_rounds(spark, monkeypatch):
    """Each ring's length was a round of its own; parallel runs between two nodes are rings of their own, and few choices are one task's."""
    n = 40
    edges = [(f"a{i:02}", f"a{(i + 1) % n:02}") for i in range(n)] + [(f"a{i:02}", f"a{i - 2:02}") for i in range(2, n, 6)]
    edges += [("u", "v"), ("u", "w1"), ("w1", "v"), ("u", "w2"), ("w2", "w3"), ("w3", "v"), ("v", "u"), ("v", "x"), ("x", "u")]
    edges += [("a00", "t1"), ("t1", "t2"), ("t2", "t3"), ("t3", "t2")]
    found = by_hand(edges)[0]
    calls, write = [], graph.written
    monkeypatch.setattr(graph, "written", lambda df: calls.append(1) or write(df))
    df = spark.createDataFrame(edges, "src string, dst string")
    assert sorted((r.members, r.length) for r in graph.rings(df).collect()) == found
    assert len(calls) < 40
    monkeypatch.setattr(graph, "CHOICES", 3)
    assert sorted((r.members, r.length) for r in graph.rings(df).collect()) == found
    assert [r.members.split(",") for r in sorted(graph.numbered_rings(graph.rings(df)).collect(), key=lambda r: int(r.cycle_id[6:]))] == [m for m, _ in sorted(found, key=lambda f: ",".join(f[0]))]


def test_weak_components(spark):
    rnd = random.Random(3)
    order = rnd.sample(range(100, 200), 100)
    line = [(f"n{a}", f"n{b}")[:: rnd.choice((1, -1))] for a, b in zip(order, order[1:], strict=False) if order.index(a) % 30 != 29]
    want = {f"n{x}": "n" + str(min(order[k - k % 30 : k - k % 30 + 30])) for k, x in enumerate(order)}
    assert dict(graph.weak_components(spark.createDataFrame(line, "src string, dst string")).collect()) == want


def test_no_rings(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    assert graph.rings(df).count() == 0 and graph.strongly_connected(df.limit(0)).count() == 0


def test_path_steps_tell_edges_and_places(spark):
    edges = spark.createDataFrame([("a", "b", "CALLS"), ("a", "b", "IMPORTS"), ("a", "c", "CALLS"), ("c", "d", "CALLS"), ("b", "d", "IMPORTS"), ("d", "e", "CALLS"), ("e", "a", "CALLS")], "src string, dst string, type string")
    nodes = spark.createDataFrame([(n, n.upper(), f"{n}.py", i) for i, n in enumerate("abcde")], "node string, name string, file string, line long")
    got = graph.path_steps(edges, nodes, "a", "e", 5)
    assert rows(got) == rows(spark.createDataFrame([(True, 0, "a", "A", "a.py", 0, None), (True, 1, "b", "B", "b.py", 1, "CALLS"), (True, 2, "d", "D", "d.py", 3, "IMPORTS"), (True, 3, "e", "E", "e.py", 4, "CALLS")], got.schema))
    assert [r.found for r in graph.path_steps(edges, nodes, "a", "zz", 5).collect()] == [False]


def test_every_kind_of_edge_keeps_its_target(spark):
    symbols = spark.createDataFrame([(k, k, "FUNCTION", "f", 1, 2) for k in [*graph.ALIVE_BY, "READS", "none"]], "uid string, name string, subtype string, file_uid string, line_start long, line_end long")
    edges = spark.createDataFrame([("x", k, k) for k in [*graph.ALIVE_BY, "READS"]], "src string, dst string, type string")
    files = spark.createDataFrame([("f", "f.py", False)], "uid string, path string, is_test boolean")
    assert {r.uid for r in graph.dead_nodes(symbols, edges, files).collect()} == {"READS", "none"}


def test_edges_of_a_search_are_made_once(spark):
    """Levels, a path and its steps read what was written, however many rounds they take."""
    made = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}", "CALLS") for i in range(6)], "src string, dst string, type string").mapInArrow(told, "src string, dst string, type string")
    seeds = spark.createDataFrame([("n0",)], "node string")
    assert rows(graph.levels(edges, seeds, None)) == [(f"n{i}", i) for i in range(7)] and made.value == 6
    assert graph.shortest_path(edges.select("src", "dst"), "n0", "n6", 9) == [f"n{i}" for i in range(7)] and made.value == 12
    nodes = spark.createDataFrame([], "node string, name string, file string, line long")
    assert graph.path_steps(edges, nodes, "n0", "n6", 9).count() == 7 and made.value == 18


def test_ways_that_have_ended_are_not_carried_on(spark, monkeypatch):
    """Short rings and runs beside a long one: a row is written until its way is known, and not in every round."""
    sizes, write = [], graph.written

    def counted(df):
        out = write(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(graph, "written", counted)
    rings = [(f"r{k:02}.{i}", f"r{k:02}.{(i + 1) % 3}", f"r{k:02}.{(i + 2) % 3}") for k in range(60) for i in range(3)]
    runs = [(f"s{k:02}", "end", "start") for k in range(60)] + [(f"w{i:02}", f"w{i + 1:02}" if i < 39 else "end", f"w{i - 1:02}" if i else "start") for i in range(40)]
    ended, closed = graph._ways(spark.createDataFrame(rings + runs, "node string, to string, back string"))
    want = [(f"s{k:02}", "end", "start", f"s{k:02}", 1) for k in range(60)] + [(f"w{i:02}", "end", r[2], "w39", 40 - i) for i, r in enumerate(runs[60:])]
    assert rows(ended) == sorted(want, key=repr)
    assert rows(closed) == sorted([(n, n[:4] + "0", (3 - int(n[4])) if n[4] != "0" else 3) for n, _, _ in rings], key=repr)
    assert sum(sizes) < 4 * len(rings + runs) and sizes[-1] <= 40
