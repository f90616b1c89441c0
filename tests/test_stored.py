"""Stored tables on literal rows."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from helpers import rows
from loomgraph.operators import stored

DECLARED = "declaration_uid string, kind string, target_stable_key string, value_json string, is_active boolean"


def test_resources(spark):
    nodes = spark.createDataFrame([("k1", "FS_PATH", None), ("k2", "STATE", "CACHE"), ("k3", "STATE", None), ("k4", "SYMBOL", "CLASS")], "stable_key string, kind string, subtype string")
    asked = spark.createDataFrame([(k,) for k in ("k1", "k2", "k3", "k4", "k5")], "key string")
    assert [(r[0], r[1]) for r in rows(stored.resolve_resources(asked, nodes))] == [("k1", "found"), ("k2", "found"), ("k3", "not_a_resource"), ("k4", "not_a_resource"), ("k5", "not_found")]


def test_declarations_as_json(spark):
    discovered = {"selectorDomain": "discovered_module", "source": {"canonicalRootPath": "a"}, "forbids": {"canonicalRootPath": "b"}}
    data = [("d1", "boundary", "r:a/b:MODULE", json.dumps({"forbids": "c", "reason": "x"}), True), ("d2", "boundary", "r:a:FILE", json.dumps({"forbids": "c"}), True), ("d3", "boundary", "r:z:MODULE", "nonsense", True), ("d4", "boundary", "r:a:MODULE", json.dumps({"forbids": "c"}), False), ("d5", "boundary", "m", json.dumps(discovered), True), ("d6", "boundary", "m", json.dumps({"selectorDomain": "other"}), True)]
    data += [("q1", "requirement", None, json.dumps({"req_id": "R", "version": 2, "verification": [{"obligation": "o", "method": "m", "threshold": 0.5}, {"obligation_id": "x", "method": "n"}]}), True), ("q2", "requirement", None, "{}", True)]
    df = spark.createDataFrame(data, DECLARED)
    assert rows(stored.boundary_declarations(df)) == [("d1", "a/b", "c", "x")]
    good, bad = stored.selector_boundaries(df)
    assert rows(good.select("declaration_uid", "source", "target")) == [("d5", "a", "b")] and rows(bad.select("declaration_uid")) == [("d6",)]
    found = stored.requirements(df)
    assert rows(found.select("req_id", "version", "method", "threshold")) == [("R", 2, "m", 0.5), ("R", 2, "n", None)]
    ids = [r[0] for r in stored.with_obligation_ids(found).orderBy("method").select("obligation_id").collect()]
    assert ids[0].startswith("obl-") and ids[1] == "x"
    assert rows(stored.unreadable(df, "requirement", ("req_id",)).select("declaration_uid")) == [("q2",)]


def test_targets_of_documents(spark):
    nodes = spark.createDataFrame([("r:a:FILE", "FILE", "a"), ("r:a:MODULE", "MODULE", "mod"), ("r:b:MODULE", "MODULE", "bee"), ("r:c:MODULE", "MODULE", "bee")], "stable_key string, kind string, name string")
    asked = spark.createDataFrame([("r:a:FILE",), ("a",), ("b",), ("mod",), ("bee",), ("no",)], "query string")
    got = {r["query"]: (r["status"], r["keys"]) for r in stored.docs_target(asked, nodes).collect()}
    assert got == {"r:a:FILE": ("found", ["r:a:FILE"]), "a": ("ambiguous", ["r:a:FILE", "r:a:MODULE"]), "b": ("found", ["r:b:MODULE"]), "mod": ("found", ["r:a:MODULE"]), "bee": ("ambiguous", ["r:b:MODULE", "r:c:MODULE"]), "no": ("not_found", [])}


def test_orders(spark):
    df = spark.createDataFrame([("a2", "p", "b", "PASS"), ("a1", "p", None, "FAIL"), ("a3", "o", "z", "PASS")], "assessment_uid string, policy_uid string, baseline_snapshot_uid string, computed_verdict string")
    assert [r["assessment_uid"] for r in stored.assessments(df).collect()] == ["a3", "a1", "a2"]
    assert [r["assessment_uid"] for r in stored.assessments(df, "FAIL").collect()] == ["a1"]
    scored = spark.createDataFrame([("t1", "h", '{"normalized_score": 0.5}'), ("t2", "h", '{"normalized_score": 0.9}'), ("t3", "x", "{}")], "target_stable_key string, kind string, value_json string")
    assert [r["target_stable_key"] for r in stored.inferences(scored, "h").collect()] == ["t2", "t1"]
    assert [tuple(r) for r in stored.counts(df, "computed_verdict").collect()] == [("PASS", 2), ("FAIL", 1)]
    assert stored.facts(df, policy_uid="p", computed_verdict=None).count() == 2


def test_versions_and_topology(spark):
    m = spark.createDataFrame([("a", "package_name", '{"value": "x"}'), ("a", "package_version", '{"value": "1.2"}'), ("b", "other", "1")], "target_stable_key string, kind string, value_json string")
    assert rows(stored.domain_versions(m)) == [("a", "x", "1.2")]
    ev = spark.createDataFrame([("s", "p", "config_file", 0.5), ("s", "p", "package_root", 0.9), ("s", "q", "main_export", 0.8)], "project_surface_uid string, source_path string, evidence_kind string, confidence double")
    roots, entries = stored.topology(ev)
    assert rows(roots) == [("s", "p", "package_root", 0.9)] and rows(entries) == [("s", "q", "main_export", 0.8)]


def test_diagnostics(spark):
    u = spark.createDataFrame([("x",), ("x",), ("y",)], "category string")
    got = stored.diagnostics(u, spark.range(10)).first()
    assert (got["edges_total"], got["unresolved_total"], got["unresolved_breakdown"]) == (10, 3, {"x": 2, "y": 1})


def test_liveness(spark):
    fn = spark.createDataFrame([("a", "test_x", "t/test_a.py", []), ("b", "test_x", "t/a.py", []), ("c", "db", "t/a.py", ["@pytest.fixture(scope='x')"]), ("d", "TestBig", "a_test.py", [])], "uid string, name string, path string, decorators array<string>")
    assert rows(stored.pytest_items(fn)) == [("a", "pytest_test"), ("c", "pytest_fixture"), ("d", "pytest_test")]
    src = spark.createDataFrame([("k.c", "module_init(start);\nEXPORT_SYMBOL_GPL(api);")], "path string, text string")
    sym = spark.createDataFrame([("s1", "start", "k.c"), ("s2", "api", "k.c"), ("s3", "api", "z.c")], "uid string, name string, path string")
    assert rows(stored.linux_managed(src, sym).select("uid", "pattern")) == [("s1", "module_init"), ("s2", "EXPORT_SYMBOL_GPL")]


def test_baselines_and_facts(spark):
    snaps = spark.createDataFrame([("s", "r", "ready"), ("b", "r", "ready"), ("o", "q", "ready"), ("f", "r", "failed")], "snapshot_uid string, repo_uid string, status string")
    assert [stored.checked_baseline(snaps, "s", b) for b in (None, "b", "o", "f", "no")] == [None, None, "baseline_of_other_repo", "baseline_not_ready", "baseline_not_found"]
    uid = spark.createDataFrame([("s", "p", None), ("s", "p", "b")], "s string, p string, b string").select(stored.assessment_uid(F.col("s"), F.col("p"), F.col("b")))
    assert [r[0] for r in uid.collect()] == ["s-qpa-p", "s-qpa-p-vs-b"]
    m = spark.createDataFrame([("t", "k", '{"value": 4}'), ("u", "k", "bad"), ("t", "z", "1")], "target_stable_key string, kind string, value_json string")
    nodes = spark.createDataFrame([("t", "CLASS", "f")], "stable_key string, subtype string, file_uid string")
    got = stored.measured_facts(m, nodes, spark.createDataFrame([("f", "a/b.ts")], "file_uid string, path string"), ("k",))
    assert rows(got.select("target", "value", "file", "module", "symbol_kind")) == [("t", 4.0, "a/b.ts", "a", "CLASS"), ("u", None, None, None, None)]
