"""Assessment runs with their store, scopes against a plain loop, and the impact of a diff."""

from __future__ import annotations

import json
import random
import re

import pytest
from helpers import rows

from loomgraph.functions.paths import glob_regex
from loomgraph.operators import assessment, impact, trust
from loomgraph.sources.versioned import VersionedStore

POLICY = "policy_uid string, policy_kind string, measurement_kind string, threshold double, scope_clauses array<struct<clause_kind:string,selector:string>>"
FACT = "target string, kind string, value double, module string, file string, symbol_kind string"


def test_scopes_equal_a_plain_loop(spark):
    rng = random.Random(3)
    dirs = ["a", "a/b", "a/b/c", "a/bc", "z.x", "", None]
    facts = []
    for i in range(120):
        d = rng.choice(dirs)
        file = None if d is None else f"{d}/{rng.choice(['x.rs', 'y1.ts', '(q)+.rs'])}".lstrip("/")
        facts.append((f"t{i}", rng.choice(["m1", "m2"]), rng.choice([None, 1.0, 5.0, 9.0]), d, file, rng.choice(["CLASS", "FUNCTION", None])))
    clauses = [("module", "a"), ("module", "a/"), ("module", "a/b"), ("module", "nowhere"), ("file", "a/**/*.rs"), ("file", "**/y?.ts"), ("file", "*/(q)+.rs"), ("file", "a/b/x.rs"), ("file", "**"), ("symbol_kind", "CLASS"), ("other", "a")]
    policies = [(f"p{i}", "absolute_max", rng.choice(["m1", "m2", "m3"]), 4.0, rng.choice([None, [], rng.sample(clauses, 1), rng.sample(clauses, 2), rng.sample(clauses, 3)])) for i in range(80)]

    def holds(clause, fact):
        kind, selector = clause
        module, file, symbol = fact[3:]
        if kind == "module":
            return module is not None and (module == selector or module.startswith(selector.rstrip("/") + "/"))
        if kind == "file":
            return file is not None and re.search(glob_regex(selector), file) is not None
        return kind == "symbol_kind" and symbol == selector

    want = sorted((p[0], f[0]) for p in policies for f in facts if p[2] == f[1] and all(holds(c, f) for c in p[4] or []))
    got = assessment.in_scope(spark.createDataFrame(policies, POLICY), spark.createDataFrame(facts, FACT)).select("policy_uid", "target")
    assert rows(got) == want


def test_verdicts_by_kind_and_baseline(spark):
    facts = spark.createDataFrame([("old_ok", "k", 3.0, "m", "m/f", None), ("old_bad", "k", 9.0, "m", "m/f", None), ("new", "k", 7.0, "m", "m/f", None), ("better", "k", 6.0, "m", "m/f", None)], FACT)
    base = spark.createDataFrame([("old_ok", "k", 2.0), ("old_bad", "k", 8.0), ("old_bad", "k", 1.0), ("better", "k", 8.0)], "target string, kind string, value double")
    policies = spark.createDataFrame([(k, k, "k", 5.0, None) for k in ("absolute_max", "absolute_min", "no_new", "no_worsened")] + [("none", "no_new", "other", 5.0, None)], POLICY)
    made = lambda b: {r["policy_uid"]: r for r in assessment.assessments(policies, assessment.evaluated(policies, facts, b), "s", "b" if b is not None else None).collect()}
    got = {k: (r["computed_verdict"], r["measured"], r["violations_count"], r["new_violations"], r["worsened_violations"]) for k, r in made(base).items()}
    assert got == {"absolute_max": ("FAIL", 4, 3, None, None), "absolute_min": ("FAIL", 4, 1, None, None), "no_new": ("FAIL", 1, 1, 1, 0), "no_worsened": ("FAIL", 2, 1, 0, 1), "none": ("NOT_APPLICABLE", 0, 0, 0, 0)}
    alone = made(None)
    assert {k: r["computed_verdict"] for k, r in alone.items()} == {"absolute_max": "FAIL", "absolute_min": "FAIL", "no_new": "NOT_COMPARABLE", "no_worsened": "NOT_COMPARABLE", "none": "NOT_COMPARABLE"}
    assert alone["no_new"]["assessment_uid"] == "s-qpa-no_new" and alone["no_new"]["measured"] == 0


def test_run_stores_all_or_nothing(spark, tmp_path):
    store = VersionedStore(spark, f"file://{tmp_path}/store")

    def add(**tables):
        t = store.begin()
        for table, (kind, data) in tables.items():
            t.append(table, spark.createDataFrame(data, kind))
        t.commit()

    def declared(uid, repo="r", **payload):
        return (uid, repo, "quality_policy", json.dumps({"policy_id": uid, "version": 1, "measurement_kind": "function_length", "policy_kind": "absolute_max", "threshold": 5.0, "severity": "fail"} | payload), True)

    shape = "declaration_uid string, repo_uid string, kind string, value_json string, is_active boolean"
    add(
        snapshots=("snapshot_uid string, repo_uid string, kind string, status string", [("s", "r", "full", "ready"), ("b", "r", "full", "ready"), ("x", "q", "full", "ready"), ("u", "r", "full", "building")]),
        measurements=("measurement_uid string, snapshot_uid string, repo_uid string, target_stable_key string, kind string, value_json string", [(f"{s}{k}", s, "r", k, "function_length", f'{{"value":{v}}}') for s, k, v in (("s", "f", 9), ("s", "g", 2), ("b", "f", 7))]),
    )
    assert assessment.run(store, "r", "s", None, "now") == {"pass": 0, "fail": 0, "not_applicable": 0, "not_comparable": 0, "total": 0, "baseline_required": 0}
    add(declarations=(shape, [declared("P1"), declared("P2", policy_kind="no_worsened"), declared("other", repo="q", version=0)]))
    before = store.state().version
    for baseline, error in ((None, "baseline_required by 1"), ("gone", "baseline_not_found"), ("x", "baseline_of_other_repo"), ("u", "baseline_not_ready")):
        with pytest.raises(assessment.Refused, match=error):
            assessment.run(store, "r", "s", baseline, "now")
    assert store.state().version == before
    for _ in range(2):  # a second run takes the place of the first
        assert assessment.run(store, "r", "s", "b", "now")["fail"] == 2
    assert rows(store.read("quality_assessments").select("assessment_uid", "measured", "violations_count", "created_at")) == [("s-qpa-P1", 2, 1, "now"), ("s-qpa-P2-vs-b", 1, 1, "now")]
    assert rows(store.read("quality_assessment_violations").select("assessment_uid", "target", "value", "baseline")) == [("s-qpa-P1", "f", 9.0, None), ("s-qpa-P2-vs-b", "f", 9.0, 7.0)]
    add(declarations=(shape, [declared("P0", threshold=None)]))
    with pytest.raises(assessment.Refused, match="invalid_policy P0: bad_threshold"):
        assessment.run(store, "r", "s", "b", "now")


def test_impact_of_a_diff(spark):
    files = spark.createDataFrame([("a/x", "A"), ("b/y", "B"), ("loose", None)], "path string, module_uid string")
    modules = spark.createDataFrame([("A", "a"), ("B", "b"), ("C", "c"), ("D", "d"), ("E", "e")], "uid string, path string")
    imports = spark.createDataFrame([("C", "B"), ("D", "C"), ("B", "D"), ("A", "E")], "src string, dst string")
    changed = impact.changed_files(spark.createDataFrame([("b/y",), ("b/y",), ("loose",), ("gone",), (None,)], "path string"), files, modules)
    assert rows(changed) == [("b/y", True, "b", None), ("gone", False, None, "not_in_snapshot"), ("loose", True, None, "no_owning_module")]
    found = impact.impacted_modules(changed, modules, imports)
    assert rows(found) == [("b", 0, "seed"), ("c", 1, "reverse_import"), ("d", 2, "reverse_import")]
    assert rows(impact.impacted_modules(changed, modules, imports, 1)) == [("b", 0, "seed"), ("c", 1, "reverse_import")]
    assert rows(impact.counts(changed, found)) == [(3, 2, 1, 1, 3, 2)]
    none = changed.filter("path = 'gone'")
    assert rows(impact.counts(none, impact.impacted_modules(none, modules, imports))) == [(1, 0, 1, 0, 0, 0)]
    assert impact.diff_arguments("staged") == ["diff", "--cached", "--name-status"] and impact.diff_arguments("since_ref", ref="v1")[-1] == "v1"
    with pytest.raises(ValueError, match="basis"):
        impact.diff_arguments("against_snapshot")


def test_trust_report(spark):
    triggers = spark.createDataFrame([(False, True, False, False)], "framework_heavy boolean, registry_pattern boolean, missing_entrypoints boolean, alias_resolution boolean")
    seen = [("calls_obj_method_needs_type_info", "unknown", "medium")] * 3 + [("calls_function_ambiguous_or_missing", "external_library_candidate", "low")] * 2 + [("strange", "unknown", "not_applicable")] * 2
    stats = spark.createDataFrame([("a", 0, 0, 2), ("b", 1, 0, 1), (".", 0, 0, 9)], "module string, fan_in long, fan_out long, file_count long")
    made = lambda rows_: trust.report(triggers, trust.tallied(spark.createDataFrame(rows_, "category string, classification string, blast_radius string")), spark.createDataFrame([(1,)], "resolved_calls long"), stats).collect()
    got = {}
    for r in sorted(made(seen), key=lambda r: (r["section"], r["rank"] or 0, r["name"] or "")):
        got.setdefault(r["section"], []).append((r["name"], r["detail"], r["value"]))
    assert [v for _, _, v in got["summary"]] == [1, 7, 5, 2, 0, 3, 0.25]
    assert got["categories"] == [("calls_obj_method_needs_type_info", "CALLS obj.method (needs type info)", 3), ("calls_function_ambiguous_or_missing", "CALLS function (ambiguous or missing)", 2), ("strange", "strange", 2)]
    assert got["classifications"] == [("unknown", None, 5), ("external_library_candidate", None, 2)]
    assert got["blast_radius"] == [("low", None, 0), ("medium", None, 3), ("high", None, 0)]
    assert got["modules"] == [(".", None, 9), ("a", "alias_resolution_candidate", 2), ("b", None, 1)]
    assert got["reliability"] == [("import_graph", "MEDIUM: registry_pattern_suspicion", None), ("call_graph", "LOW: call_resolution_rate=25.0%_below_50%", None), ("change_impact", "LOW: registry_pattern_suspicion", None)]
    assert [d.split(".")[0] for _, d, _ in got["caveats"]] == ["Call-graph reliability is LOW on this repo", "Import-graph reliability is MEDIUM", "Change-impact reliability is LOW", "Cycle payloads currently emit leaf module names only; full stable keys are not in the user-facing `graph cycles` output"]
    empty = {(r["section"], r["name"]): r["value"] for r in made([])}
    assert empty["summary", "call_resolution_rate"] == 1 and empty["blast_radius", "low"] == 0


def test_run_stores_no_row_for_each_policy_and_fact(spark, tmp_path):
    """Forty facts of two values and thirty policies of one rule: two classes, not 600 violations; readers still see all."""
    store, facts = VersionedStore(spark, f"file://{tmp_path}/store"), [(f"f{i}", 9.0 if i % 2 else 2.0) for i in range(40)]
    payload = json.dumps({"policy_id": "p", "version": 1, "measurement_kind": "function_length", "policy_kind": "absolute_max", "threshold": 5.0, "severity": "fail"})
    t = store.begin()
    t.append("snapshots", spark.createDataFrame([("s", "r", "full", "ready")], "snapshot_uid string, repo_uid string, kind string, status string"))
    t.append("measurements", spark.createDataFrame([(k, "s", "r", k, "function_length", f'{{"value":{v}}}') for k, v in facts], "measurement_uid string, snapshot_uid string, repo_uid string, target_stable_key string, kind string, value_json string"))
    t.append("declarations", spark.createDataFrame([(f"P{i}", "r", "quality_policy", payload, True) for i in range(30)], "declaration_uid string, repo_uid string, kind string, value_json string, is_active boolean"))
    t.commit()
    for _ in range(2):
        assert assessment.run(store, "r", "s", None, "now")["fail"] == 30
    assert (store.read("quality_violating_classes").count(), store.read("quality_class_members").count()) == (30, 20)
    want = sorted((f"s-qpa-P{i}", k, v, 5.0, None) for i in range(30) for k, v in facts if v > 5)
    seen = lambda: rows(store.read("quality_assessment_violations").select("assessment_uid", "target", "value", "threshold", "baseline"))
    assert seen() == want
    for table in ("quality_assessment_violations", "quality_class_members"):
        store.compact(table)
    assert seen() == want
    with pytest.raises(ValueError, match="in parts"):
        store.begin().delete("quality_assessment_violations", spark.createDataFrame([("f1",)], "target string"))
    t = store.begin()
    t.delete_where("quality_assessment_violations", snapshot_uid="s")
    t.commit()
    assert seen() == []
