"""Operators on literal rows: the small cases that SQL over the projection doesn't reach."""

from __future__ import annotations

from pyspark.sql import functions as F

from helpers import rows
from loomgraph.functions import numbers, paths
from loomgraph.operators import boundary, declarations, docs, gate, graph, incremental, lookup, modules, quality, resolve, seams, trust


def test_half_up(spark):
    got = spark.createDataFrame([(0.125,), (0.005,), (2.345,), (0.0,)], "x double").select(numbers.half_up(F.col("x")))
    assert [r[0] for r in got.collect()] == [0.13, 0.01, 2.35, 0.0]


def test_json_number(spark):
    got = spark.createDataFrame([('{"value": 3}',), ("4.5",), ("x",), (None,)], "v string").select(numbers.json_number(F.col("v")))
    assert [r[0] for r in got.collect()] == [3.0, 4.5, None, None]


def test_glob():
    import re

    assert re.match(paths.glob_regex("src/*.ts"), "src/a.ts") and not re.match(paths.glob_regex("src/*.ts"), "src/a/b.ts")
    assert re.match(paths.glob_regex("src/**/*.ts"), "src/a/b.ts") and re.match(paths.glob_regex("src/**/*.ts"), "src/b.ts")
    assert not re.match(paths.glob_regex("a.b"), "aXb")


def test_path_predicates(spark):
    df = spark.createDataFrame([("src/vendor/x.c",), ("src/vendored/x.c",), ("a/tests/b.py",), ("x.spec.ts",)], "p string")
    got = df.select(paths.is_vendored(F.col("p")), paths.is_test_path(F.col("p")), paths.language(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [(True, False, "c"), (False, False, "c"), (False, True, "python"), (False, True, "typescript")]


def test_resolution_stops_at_the_first_step_that_finds_anything(spark):
    symbols = spark.createDataFrame([("k1", "a.f", "f"), ("k2", "b.f", "f"), ("k3", "f", "g")], "uid string, qualified_name string, name string")
    asked = spark.createDataFrame([("f",), ("k1",), ("g",), ("zz",)], "query string")
    got = {r["query"]: (r["status"], r["keys"]) for r in lookup.resolve_symbols(asked, symbols).collect()}
    assert got == {"f": ("found", "k3"), "k1": ("found", "k1"), "g": ("found", "k3"), "zz": ("not_found", "")}


def test_cycles_are_counted_once(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "a"), ("c", "d")], "src string, dst string")
    assert rows(graph.cycles(edges, 3)) == [(["a", "b", "c"], 3), (["a", "b"], 2)]
    assert rows(graph.strongly_connected_core(edges)) == [("a", "b"), ("b", "a"), ("b", "c"), ("c", "a")]


def test_canonical_ring(spark):
    got = spark.createDataFrame([(["c", "a", "b"],)], "m array<string>").select(graph.canonical_ring(F.col("m"))).first()[0]
    assert got == ["a", "b", "c"]


def test_levels_and_paths(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert rows(graph.levels(edges, seeds, None)) == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert graph.shortest_path(edges, "a", "d", 5) == ["a", "b", "d"]
    assert graph.shortest_path(edges, "a", "zz", 5) is None
    assert graph.shortest_path(edges, "a", "d", 1) is None
    assert graph.shortest_path(edges, "a", "a", 3) == ["a"]


def test_ownership_prefers_length_then_kind(spark):
    files = spark.createDataFrame([("f1", "a/b/c.ts"), ("f2", "x.ts")], "uid string, path string")
    roots = spark.createDataFrame([(".", "m0", "declared"), ("a", "m1", "declared"), ("a/b", "m2", "inferred"), ("a/b", "m3", "operational")], "root string, module_uid string, kind string")
    assert rows(modules.assign_ownership(files, roots)) == [("f1", "a/b/c.ts", "m3", "a/b", "operational"), ("f2", "x.ts", "m0", ".", "declared")]


def test_diagnostics_test_the_source_first(spark):
    imports = spark.createDataFrame([("a", "b"), ("x", "y"), ("a", "y"), ("a", "c")], "src string, dst string")
    own = spark.createDataFrame([("a", "m1"), ("b", "m1"), ("c", "m2")], "file_uid string, module_uid string")
    assert tuple(modules.dependency_diagnostics(imports, own).first()) == (4, 1, 1, 1, 1)


def test_discovery_merges_roots(spark):
    found = spark.createDataFrame([("./a/", "inferred", 0.5, None, 1), ("a", "declared", 0.4, "first", 2), ("a", "operational", 0.9, "second", 3)], "root string, kind string, confidence double, name string, ord int")
    assert rows(modules.discover(found)) == [("a", "declared", 0.9, "first", 3)]


def test_churn_counts_a_commit_once_for_each_file(spark):
    commits = spark.createDataFrame([(1, "f", 2, 1), (1, "f", 3, 0), (2, "f", 1, 1)], "commit long, file_uid string, added long, deleted long")
    assert rows(quality.churn(commits)) == [("f", 2, 8)]


def test_policies_without_baseline_and_scope(spark):
    facts = spark.createDataFrame([("t", "k", 5.0, "m", None, "CLASS")], "target string, kind string, value double, module string, file string, symbol_kind string")
    policies = [dict(policy_id="a", policy_kind="no_new", measurement_kind="k", threshold=1), dict(policy_id="b", policy_kind="absolute_max", measurement_kind="k", threshold=5), dict(policy_id="c", policy_kind="absolute_max", measurement_kind="k", threshold=1, scope=[("file", "*.ts")])]
    assert rows(quality.assess(policies, facts, None).select("policy_id", "verdict")) == [("a", "NOT_COMPARABLE"), ("b", "PASS"), ("c", "NOT_APPLICABLE")]


def test_policy_validation(spark):
    bad = spark.createDataFrame([("", 0, "nonsense", "absolute_max", float("nan")), ("p", 1, "line_coverage", "no_new", 1.0), ("q", 1, "line_coverage", "absolute_min", 0.5)], "policy_id string, version int, measurement_kind string, policy_kind string, threshold double")
    got = {r["policy_id"]: r["errors"] for r in quality.validation_errors(bad).collect()}
    assert got == {"": ["empty_policy_id", "bad_version", "unknown_kind", "bad_threshold"], "p": ["comparative_coverage"], "q": []}


def test_call_resolution_needs_a_unique_candidate(spark):
    symbols = spark.createDataFrame([("s1", "f", "FUNCTION", "a"), ("s2", "f", "FUNCTION", "b"), ("s3", "g", "INTERFACE", "a"), ("s4", "g", "FUNCTION", "b")], "uid string, name string, subtype string, file_uid string")
    edges = spark.createDataFrame([("e1", "CALLS", "f"), ("e2", "CALLS", "x.g"), ("e3", "IMPLEMENTS", "g"), ("e4", "CALLS", "none")], "edge_uid string, type string, target_key string")
    bound = spark.createDataFrame([("e1", "b")], "edge_uid string, file_uid string")
    got = {r["edge_uid"]: (r["target_uid"], r["stage"]) for r in resolve.resolve_calls(edges, symbols, bound).collect()}
    assert got == {"e1": ("s2", 3), "e2": ("s4", 1), "e3": ("s3", 2), "e4": (None, None)}


def test_includes(spark):
    files = spark.createDataFrame([("a/x.h",), ("include/x.h",), ("include/y.h",), ("src/y.h",)], "path string")
    edges = spark.createDataFrame([("1", "a/m.c", "x.h", True), ("2", "a/m.c", "y.h", True), ("3", "a/m.c", "x.h", False), ("4", "a/m.c", "z.h", False)], "edge_uid string, source_path string, include string, quoted boolean")
    got = {r["edge_uid"]: (r["target"], r["status"]) for r in resolve.resolve_includes(edges, files).collect()}
    assert got == {"1": ("a/x.h", "resolved"), "2": (None, "ambiguous"), "3": ("include/x.h", "resolved"), "4": (None, "unresolved")}


def test_liveness_and_promotion(spark):
    symbols = spark.createDataFrame([("c", "CLASS", ["org.x.Service"]), ("m", "METHOD", ["Bean"]), ("i", "INTERFACE", ["Service"]), ("n", "CLASS", [])], "uid string, subtype string, annotations array<string>")
    assert rows(resolve.container_managed(symbols).select("uid", "annotation")) == [("c", "Service"), ("m", "Bean")]
    known = spark.createDataFrame([("k", "T", "CLASS", None), ("m1", "run", "METHOD", "k"), ("d1", "D", "CLASS", None), ("d2", "D", "CLASS", None)], "uid string, name string, subtype string, parent_uid string")
    asked = spark.createDataFrame([("e1", "s", "T", "run"), ("e2", "s", "D", "run"), ("e3", "s", "T", "stop"), ("e4", "s", None, "run")], "edge_uid string, source_uid string, receiver_type string, method string")
    assert rows(resolve.promote_edges(asked, known).select("edge_uid", "target_uid", "skip")) == [("e1", "m1", None), ("e2", None, "class_ambiguous"), ("e3", None, "method_not_found"), ("e4", None, "no_receiver_type")]


def test_handlers(spark):
    bindings = spark.createDataFrame([("f1", "aws-lambda"), ("f2", "@aws-lambda-powertools/logger"), ("f3", "left-pad")], "file_uid string, specifier string")
    symbols = spark.createDataFrame([("a", "handler", "export", "FUNCTION", "f1"), ("b", "handler", "private", "FUNCTION", "f1"), ("c", "handler", "export", "CLASS", "f2"), ("d", "handler", "export", "CONSTANT", "f2"), ("e", "handler", "export", "FUNCTION", "f3")], "uid string, name string, visibility string, subtype string, file_uid string")
    assert [r[0] for r in rows(resolve.handler_entrypoints(bindings, symbols))] == ["a", "d"]


def test_http_confidence(spark):
    df = spark.createDataFrame([("/a/b/{x}", 0.9), ("/a", 0.9), ("/a/b", 0.9)], "p string, c double")
    got = [round(r[0], 6) for r in df.select(paths.http_confidence(F.col("c"), F.col("p"))).collect()]
    assert got == [0.87, 0.72, 0.9]


def test_unlinked_and_counts_without_making_links(spark):
    """By keys alone, equal to what the links give; a key that all share has a product of links."""
    methods, paths_ = ["GET", "post", None, "*"], ["/a/{x}", "/a/:y", "/b", "", "/c/d"]
    made = lambda n, letter, k: spark.createDataFrame([(f"{letter}{i}", methods[i * k % 4], paths_[i * i % (k + 2)], f"op{i % 5}", f"f{i % 3}", i % 2, 0.9) for i in range(n)], "uid string, method string, path string, operation string, file string, line int, confidence double")
    for p, c in ((made(40, "p", 1), made(30, "c", 3)), (made(9, "p", 3), made(50, "c", 1)), (made(0, "p", 1), made(5, "c", 3))):
        links = boundary.match_http(p, c)
        assert rows(boundary.unlinked(p, c, "provider")) == rows(boundary.unmatched(p, links, "provider"))
        assert rows(boundary.unlinked(p, c, "consumer")) == rows(boundary.unmatched(c, links, "consumer"))
        assert rows(boundary.linked(p, c, "provider").select("uid")) == rows(links.select("provider").distinct())
        assert rows(boundary.linked(p, c, "consumer").select("uid")) == rows(links.select("consumer").distinct())
        assert rows(boundary.summary(p, c)) == rows(boundary.summary(p, c, links))


def test_boundary_matching_falls_back_only_without_a_method(spark):
    p = spark.createDataFrame([("p1", "GET", "/a/:id"), ("p2", None, "/b/c")], "uid string, method string, path string")
    c = spark.createDataFrame([("c1", "get", "/a/{x}", 1.0), ("c2", None, "/a/{y}", 1.0), ("c3", "POST", "/a/{y}", 1.0), ("c4", None, "/b/c", 1.0)], "uid string, method string, path string, confidence double")
    got = rows(boundary.match_http(p, c).select("provider", "consumer", "basis"))
    assert got == [("p1", "c1", "address_match"), ("p1", "c2", "heuristic"), ("p2", "c4", "address_match")]


def test_waivers_never_hide_a_pass(spark):
    obligations = spark.createDataFrame([("r", 1, "o", "module_violations", None, None, None, 1, 0.0), ("r", 1, "p", "module_violations", None, None, None, 1, 2.0)], "req_id string, version int, obligation_id string, method string, target string, threshold double, operator string, measured long, value double")
    waivers = spark.createDataFrame([("r", 1, "o", "w"), ("r", 1, "p", "w")], "req_id string, version int, obligation_id string, waiver_id string")
    assert rows(gate.verdicts(obligations, waivers).select("obligation_id", "effective")) == [("o", "PASS"), ("p", "WAIVED")]


def test_check_conditions_stop_without_a_snapshot(spark):
    state = spark.createDataFrame([(False, 1, 0, "HIGH", "ran", "pass")], "snapshot_exists boolean, files_total long, stale_files long, call_graph string, enrichment string, gate string")
    conditions = trust.check_conditions(state)
    assert rows(conditions) == [(1, "SNAPSHOT_EXISTS", "incomplete")]
    assert trust.reduce_verdict(conditions).first()[0] == "incomplete"


def test_invalidation_widens_below_changed_configs(spark):
    kind = "file_uid string, path string, content_hash string"
    parent = spark.createDataFrame([("1", "a/package.json", "x"), ("2", "a/b/c.ts", "y"), ("3", "d.ts", "z"), ("4", "gone.ts", "z")], kind)
    now = spark.createDataFrame([("1", "a/package.json", "X"), ("2", "a/b/c.ts", "y"), ("3", "d.ts", "z"), ("5", "new.ts", "z")], kind)
    got = {r["file_uid"]: (r["disposition"], r["action"]) for r in incremental.invalidation(parent, now).collect()}
    assert got == {"1": ("changed", "extract"), "2": ("config_widened", "extract"), "3": ("unchanged", "copy"), "4": ("deleted", "delete"), "5": ("new", "extract")}


def test_deletion_and_upsert(spark):
    nodes = spark.createDataFrame([("n1", "f1"), ("n2", "f2")], "uid string, file_uid string")
    edges = spark.createDataFrame([("n1", "n2"), ("n2", "n2")], "src string, dst string")
    left, kept = incremental.delete_files(nodes, edges, spark.createDataFrame([("f1",)], "file_uid string"))
    assert rows(left.select("uid")) == [("n2",)] and rows(kept) == [("n2", "n2")]
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string")
    assert rows(incremental.upsert(old, new, ["k"])) == [(1, "a"), (2, "B"), (3, "c")]


def test_declarations(spark):
    kind = "declaration_uid string, kind string, target string, supersedes_uid string, is_active boolean"
    stored = spark.createDataFrame([("a", "k", "t", None, True), ("b", "k", "t", None, False)], kind)
    new = spark.createDataFrame([("c", "k", "t", "a", True), ("d", "k", "t", "b", True)], kind)
    assert [(r[0], r[4]) for r in rows(declarations.supersede(stored, new))] == [("a", False), ("b", False), ("c", True)]
    assert declarations.insert(stored, stored.union(new)).count() == 4
    assert rows(declarations.deactivate(stored, stored.select("declaration_uid")).filter("is_active")) == []


def test_chains_of_any_length_without_rings_and_strays(spark):
    links = [("d0", None), *((f"d{i}", f"d{i - 1}") for i in range(1, 130)), ("r1", "r2"), ("r2", "r1"), ("tail", "r1"), ("stray", "gone"), ("after", "stray"), ("alone", None)]
    got = rows(declarations.chains(spark.createDataFrame(links, "declaration_uid string, supersedes_uid string")))
    assert got == sorted([("alone", "alone", 0), *((f"d{i}", "d0", i) for i in range(130))], key=repr)
    assert rows(declarations.chains(spark.createDataFrame([], "declaration_uid string, supersedes_uid string"))) == []


def test_obligations_keep_ids(spark):
    kind = "obligation_id string, obligation string, method string, target string, threshold double, operator string"
    prior = spark.createDataFrame([("id1", "cover", "coverage_threshold", "a", 0.5, ">=")], kind)
    new = spark.createDataFrame([(None, "cover", "coverage_threshold", "a", 0.5, ">="), (None, "cover", "coverage_threshold", "a", 0.6, ">=")], kind)
    got = {r["threshold"]: r["obligation_id"] for r in declarations.inherit_obligations(prior, new).collect()}
    assert got[0.5] == "id1" and got[0.6] not in (None, "id1")


def test_seams(spark):
    env = spark.createDataFrame([("A", "s1", "optional", None, 1, 0.5, 1), ("A", "s2", "required", "x", 2, 0.9, 2), ("A", "s2", "unknown", "y", 1, 0.1, 3)], "name string, surface string, access string, default_value string, evidence long, confidence double, ord long")
    assert rows(seams.env_rollup(env)) == [("A", "required", "x", True, 2, 4, 0.9)]


def test_keyword_rules(spark):
    df = spark.createDataFrame([("p", "this replaces that\nFoo replaces Foo\nuse _x instead\nuse abc instead", "own-mod", False)], "path string, text string, subject string, generated boolean")
    assert rows(docs.keyword_facts(df).select("line", "subject", "object")) == [(3, "own-mod", "_x")]


def test_lines_outside_fences(spark):
    """A repeated path is two documents; a fence that isn't closed fences the rest."""
    texts = [("p", "a\n```\nb\n ~~~x\nc\n | d |\n~~~\ne", 1), ("p", "f\n\n```", 2), ("q", None, 3), ("r", "", 4)]
    got = rows(docs.lines(spark.createDataFrame(texts, "path string, text string, extra int")).select("path", "extra", "line", "text"))
    assert got == [("p", 1, 1, "a"), ("p", 1, 5, "c"), ("p", 2, 1, "f"), ("p", 2, 2, ""), ("r", 4, 1, "")]
    assert rows(docs.lines(spark.createDataFrame(texts, "path string, text string, extra int"), "[ce]").select("line", "text")) == [(5, "c")]


def test_relevance_tiers(spark):
    df = spark.createDataFrame([("a/b/README.md", "readme", False), ("a/b/c/x.md", "architecture", False), ("a/y.md", "architecture", True), ("README.md", "readme", False), ("z/q.md", "readme", False)], "path string, kind string, generated boolean")
    got = {r["path"]: r["priority"] for r in docs.relevance(df, spark.createDataFrame([("a/b",)], "focus string")).collect()}
    assert got == {"a/b/README.md": 320, "a/b/c/x.md": 280, "a/y.md": 225, "README.md": 220}
