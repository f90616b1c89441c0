from __future__ import annotations

from pyspark.sql import functions as F

from helpers import rows
from loomgraph.functions import paths
from loomgraph.operators import reports, resolve


def test_changed_paths(spark):
    lines = spark.createDataFrame([("A\ta.ts",), ("M\tb/c.ts",), ("D\told.py",), ("R087\tx.c\ty.c",), ("",), ("M\tb/c.ts",)], "value string")
    assert rows(reports.changed_paths(lines)) == [("a.ts", "added"), ("b/c.ts", "modified"), ("old.py", "deleted"), ("y.c", "renamed")]


def test_front_matter(spark):
    docs = spark.createDataFrame([("a.md", "---\ntitle: 'One two'\nowner: team\n# no\n---\nbody: x"), ("b.md", "no: front"), ("c.md", None)], "path string, text string")
    assert rows(reports.front_matter(docs)) == [("a.md", "owner", "team"), ("a.md", "title", "One two")]


def test_clipped_keeps_whole_characters(spark):
    df = spark.createDataFrame([("é" * 10,), ("abc",), ("",), (None,)], "t string").select(reports.clipped(F.col("t"), 5).alias("c")).select("c.*")
    assert [tuple(r) for r in df.collect()] == [("éé" + reports.MARKER, True), ("abc", False), ("", False), (None, None)]


def test_identities_follow_content(spark):
    df = spark.createDataFrame([("x", "1", None), ("x", "1", None), ("x", "2", "z")], "b string, a string, c string")
    got = df.select(reports.canonical_json(["c", "b", "a"]).alias("j"), reports.surface_identity(["a", "b", "c"]).alias("k")).collect()
    assert got[0]["j"] == '{"a":"1","b":"x"}' and got[0]["k"] == got[1]["k"] != got[2]["k"] and len(got[0]["k"]) == 16


def test_stripped_comment_and_listing(spark):
    df = spark.createDataFrame([("/**\n * Adds.\n * @return sum\n */",), ("plain",)], "raw string")
    assert [r[0] for r in df.select(reports.stripped_comment(F.col("raw"))).collect()] == ["Adds.\n@return sum", "plain"]
    table = spark.createDataFrame([("abcdef", 1), (None, 22)], "a string, b int")
    assert [r[0] for r in reports.listing(table, ["a", "b"], [4, 3]).collect()] == ["abcd  1", "-     22"]


def test_iso_and_percent(spark):
    df = spark.sql("select timestamp '2024-02-03 04:05:06.789' as t, 1/3 as s")
    assert tuple(df.select(reports.iso(F.col("t")), reports.percent(F.col("s"))).first()) == ("2024-02-03T04:05:06Z", "33.3%")


def test_percent_rounds_the_double_and_ties_to_even(spark):
    """As C's printf does; Spark's own format gives 6.3, 15.0 and 18.8, 0.3."""
    pairs = [(1, 16), (299, 2000), (3, 16), (1, 400), (0, 3), (7, 7), (0, 0)] + [(k, n) for n in (16, 40, 80, 97, 2000) for k in range(0, n, 3)]
    df = spark.createDataFrame(pairs, "k long, n long").coalesce(1)
    got = [r[0] for r in df.select(reports.percent(F.col("k"), F.col("n"))).collect()]
    assert got[:4] == ["6.2%", "14.9%", "18.8%", "0.2%"]
    assert got == [f"{100.0 * k / n:.1f}%" if n else None for k, n in pairs]


def test_accesses_by_key_then_name(spark):
    edges = spark.createDataFrame([("e1", "K1"), ("e2", "users"), ("e3", "twice"), ("e4", "fn"), ("e5", None)], "edge_uid string, target_key string")
    nodes = spark.createDataFrame([("n1", "K1", "a", "TABLE"), ("n2", "K2", "users", "TABLE"), ("n3", "K3", "twice", "BLOB"), ("n4", "K4", "twice", "STATE"), ("n5", "K5", "fn", "SYMBOL")], "uid string, stable_key string, name string, kind string")
    got = {r["edge_uid"]: r["target_uid"] for r in resolve.resolve_accesses(edges, nodes).collect()}
    assert got == {"e1": "n1", "e2": "n2", "e3": None, "e4": None, "e5": None}


def test_calls_of_a_hot_name(spark):
    """A name of many symbols stays ambiguous; among the files that the source imports it may be one."""
    symbols = spark.createDataFrame([(f"s{k}", "get", "FUNCTION" if k else "INTERFACE", f"f{k}") for k in range(50)] + [("t", "only", "CLASS", "f1")], "uid string, name string, subtype string, file_uid string")
    edges = spark.createDataFrame([("e1", "CALLS", "get"), ("e2", "CALLS", "obj.only"), ("e3", "IMPLEMENTS", "get"), ("e4", "INSTANTIATES", "get"), ("e5", "CALLS", "get")], "edge_uid string, type string, target_key string")
    bindings = spark.createDataFrame([("e5", "f7"), ("e5", "f0"), ("e5", "f7")], "edge_uid string, file_uid string")
    got = {r["edge_uid"]: (r["target_uid"], r["stage"], r["candidates"]) for r in resolve.resolve_calls(edges, symbols, bindings).collect()}
    assert got == {"e1": (None, None, 49), "e2": ("t", 1, 1), "e3": ("s0", 2, 1), "e4": (None, None, 0), "e5": ("s7", 3, 49)}


def test_module_key(spark):
    df = spark.createDataFrame([("r", "a/b"), ("r", "")], "r string, p string")
    assert [x[0] for x in df.select(paths.module_key(F.col("r"), F.col("p"))).collect()] == ["r:a/b:MODULE", "r:.:MODULE"]
