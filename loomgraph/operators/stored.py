"""Questions to stored tables: declarations as JSON, assessments, facts, versions and counts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import json_number
from ..functions.paths import module_of_key

RESOURCE_KINDS = ("FS_PATH", "DB_RESOURCE", "BLOB")


def is_resource(kind, subtype):
    """A node that stands for a resource: file, database, blob, or state that is a cache."""
    return F.coalesce(kind.isin(*RESOURCE_KINDS) | ((kind == "STATE") & (subtype == "CACHE")), F.lit(False))


def resolve_resources(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """key, status (found, not_a_resource, not_found), kind."""
    found = requests.select("key").distinct().join(nodes.select(F.col("stable_key").alias("key"), "kind", "subtype"), "key", "left")
    status = F.when(F.col("kind").isNull(), "not_found").when(is_resource(F.col("kind"), F.col("subtype")), "found").otherwise("not_a_resource")
    return found.select("key", status.alias("status"), "kind")


def stale_files(versions: DataFrame, files: DataFrame) -> DataFrame:
    return versions.filter("parse_status = 'stale'").join(files.select("file_uid", "path"), "file_uid").select("snapshot_uid", "file_uid", "path")


def inferences(rows: DataFrame, kind: str) -> DataFrame:
    """Inferences of a kind, by their normalised score, greatest first."""
    score = F.get_json_object("value_json", "$.normalized_score").try_cast("double")
    return rows.filter(F.col("kind") == kind).withColumn("normalized_score", score).orderBy(F.desc("normalized_score"), "target_stable_key")


def assessments(rows: DataFrame, verdict: str | None = None) -> DataFrame:
    """Assessments in order of policy and baseline, those without one first."""
    rows = rows.filter(F.col("computed_verdict") == verdict) if verdict else rows
    return rows.orderBy("policy_uid", F.asc_nulls_first("baseline_snapshot_uid"), "assessment_uid")


def active(declarations: DataFrame, kind: str) -> DataFrame:
    return declarations.filter((F.col("kind") == kind) & F.col("is_active"))


def boundary_declarations(declarations: DataFrame) -> DataFrame:
    """declaration_uid, source, target, reason; rows whose key or JSON doesn't say them are left out."""
    rows = active(declarations, "boundary").select("declaration_uid", module_of_key(F.col("target_stable_key")).alias("source"), F.get_json_object("value_json", "$.forbids").alias("target"), F.get_json_object("value_json", "$.reason").alias("reason"))
    return rows.filter((F.col("source") != "") & F.col("target").isNotNull())


def selector_boundaries(declarations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boundaries between discovered modules (declaration_uid, source, target, reason), and those that can't be read.

    A missing selector domain or ``directory_module`` is another kind of boundary and neither.
    """
    kind = "selectorDomain string, source struct<canonicalRootPath:string>, forbids struct<canonicalRootPath:string>, reason string"
    rows = active(declarations, "boundary").withColumn("_v", F.from_json("value_json", kind))
    domain = F.col("_v.selectorDomain")
    rows = rows.filter(domain.isNotNull() & (domain != "directory_module"))
    good = (domain == "discovered_module") & F.col("_v.source.canonicalRootPath").isNotNull() & F.col("_v.forbids.canonicalRootPath").isNotNull()
    return rows.filter(good).select("declaration_uid", F.col("_v.source.canonicalRootPath").alias("source"), F.col("_v.forbids.canonicalRootPath").alias("target"), F.col("_v.reason").alias("reason")), rows.filter(~F.coalesce(good, F.lit(False))).select("declaration_uid", "value_json")


OBLIGATION = "obligation_id string, obligation string, method string, target string, threshold double, operator string"


def requirements(declarations: DataFrame) -> DataFrame:
    """One row for each obligation of an active requirement."""
    value = F.from_json("value_json", f"req_id string, version int, verification array<struct<{OBLIGATION.replace(' string', ':string').replace(' double', ':double')}>>")
    return active(declarations, "requirement").select("declaration_uid", value.alias("v")).select("declaration_uid", "v.req_id", "v.version", F.explode("v.verification").alias("o")).select("declaration_uid", "req_id", "version", "o.*")


def unreadable(declarations: DataFrame, kind: str, needed: tuple[str, ...]) -> DataFrame:
    """Active declarations of a kind whose JSON lacks a needed field; a contract that forbids them tests for none."""
    missing = F.lit(False)
    for field in needed:
        missing = missing | F.get_json_object("value_json", f"$.{field}").isNull()
    return active(declarations, kind).filter(missing).select("declaration_uid", "value_json")


def policies(declarations: DataFrame) -> DataFrame:
    value = F.from_json("value_json", "policy_id string, version int, policy_kind string, measurement_kind string, threshold double, severity string, scope_clauses array<struct<clause_kind:string,selector:string>>")
    return active(declarations, "quality_policy").select("declaration_uid", value.alias("v")).select("declaration_uid", "v.*")


def with_obligation_ids(obligations: DataFrame) -> DataFrame:
    """Obligations without an id get one from their content, the same each time."""
    made = F.concat(F.lit("obl-"), F.substring(F.sha2(F.concat_ws("|", "req_id", "obligation", "method", "target", F.col("threshold").cast("string"), "operator"), 256), 1, 12))
    return obligations.withColumn("obligation_id", F.coalesce("obligation_id", made))


def facts(rows: DataFrame, **filters: str | None) -> DataFrame:
    """Rows by optional equality filters, for boundary facts, status mappings, markers and fates alike."""
    for column, wanted in filters.items():
        rows = rows.filter(F.col(column) == wanted) if wanted is not None else rows
    return rows


def semantic_facts(rows: DataFrame, kind: str | None = None) -> DataFrame:
    rows = facts(rows, fact_kind=kind)
    return rows.orderBy(F.desc("confidence"), "source_file") if kind else rows.orderBy("source_file", "line_start")


def counts(rows: DataFrame, column: str) -> DataFrame:
    """Rows for each value, most first: edges by type, evidence by surface, facts by kind."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def domain_versions(measurements: DataFrame) -> DataFrame:
    """target, package_name, package_version where measurements say them."""
    value = F.coalesce(F.get_json_object("value_json", "$.value"), F.get_json_object("value_json", "$.name"), F.col("value_json"))
    wide = measurements.filter(F.col("kind").isin("package_name", "package_version")).groupBy("target_stable_key")
    return wide.agg(F.max(F.when(F.col("kind") == "package_name", value)).alias("package_name"), F.max(F.when(F.col("kind") == "package_version", value)).alias("package_version"))


def obligation_report(judged: DataFrame) -> DataFrame:
    """req_id, effective, n: obligations of each requirement by effective verdict."""
    return judged.groupBy("req_id", "effective").agg(F.count("*").alias("n"))


def docs_target(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """query, status, step, keys: by key, then path (its file or module), then a module's name."""
    path = F.regexp_extract("stable_key", r"^[^:]*:(.*):(?:FILE|MODULE)$", 1)
    forms = [(F.col("stable_key"), 1, None), (path, 2, "kind in ('FILE', 'MODULE')"), (F.col("name"), 3, "kind = 'MODULE'")]
    hits = None
    for key, step, test in forms:
        part = (nodes.filter(test) if test else nodes).select(key.alias("query"), F.lit(step).alias("_step"), F.col("stable_key").alias("_key")).filter("query <> ''").distinct()
        hits = part if hits is None else hits.unionByName(part)
    per = requests.select("query").distinct().join(hits, "query", "left").groupBy("query", "_step").agg(F.count("_key").alias("_n"), F.array_sort(F.collect_set("_key")).alias("_keys"))
    best = per.groupBy("query").agg(F.min(F.struct(F.coalesce("_step", F.lit(9)).alias("step"), "_n", "_keys")).alias("b"))
    n = F.col("b._n")
    return best.select("query", F.when(n == 0, "not_found").when(n == 1, "found").otherwise("ambiguous").alias("status"), F.when(n > 0, F.col("b.step")).alias("step"), F.col("b._keys").alias("keys"))


def topology(evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Config roots and entry points of surfaces, from their evidence; a path counts once for each surface."""
    roots = evidence.filter(F.col("evidence_kind").isin("config_file", "workspace_root", "package_root")).select("project_surface_uid", F.col("source_path").alias("path"), F.col("evidence_kind").alias("kind"), "confidence")
    entries = evidence.filter(F.col("evidence_kind").isin("binary_entrypoint", "main_export", "container_command")).select("project_surface_uid", F.col("source_path").alias("path"), F.col("evidence_kind").alias("kind"), "confidence")
    once = lambda df: df.groupBy("project_surface_uid", "path").agg(F.max_by("kind", "confidence").alias("kind"), F.max("confidence").alias("confidence"))
    return once(roots), once(entries)


def diagnostics(unresolved: DataFrame, edges_total: DataFrame) -> DataFrame:
    """One row: edges, unresolved ones, and a map of their categories."""
    per = unresolved.groupBy("category").agg(F.count("*").alias("n"))
    one = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("unresolved_total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("unresolved_breakdown"))
    return edges_total.agg(F.count("*").alias("edges_total")).crossJoin(F.broadcast(one))  # one row each


# Liveness from text


def pytest_items(functions: DataFrame) -> DataFrame:
    """uid, kind of tests and fixtures. ``functions``: uid, name, path, decorators (array)."""
    in_test = F.regexp_extract("path", r"([^/]*)$", 1).rlike(r"^(test_.*|.*_test|conftest)\.py$")
    fixture = F.exists("decorators", lambda d: d.rlike(r"^@?pytest\.fixture\b|^@?fixture\b"))
    kind = F.when(fixture, "pytest_fixture").when(in_test & (F.col("name").startswith("test_") | F.col("name").rlike("^Test[A-Z]")), "pytest_test")
    return functions.select("uid", kind.alias("kind")).filter("kind is not null")


_LINUX = re.compile(r"\b(module_init|module_exit|subsys_initcall|core_initcall|device_initcall|late_initcall|EXPORT_SYMBOL(?:_GPL)?|SYSCALL_DEFINE\d|DEFINE_\w+_ATTRIBUTE)\s*\(\s*(\w+)")


def linux_managed(sources: DataFrame, symbols: DataFrame) -> DataFrame:
    """uid, pattern of symbols that the kernel's macros register. ``sources``: path, text; ``symbols``: uid, name, path."""
    macro = F.regexp_extract_all("text", F.lit(_LINUX.pattern), F.lit(1))
    name = F.regexp_extract_all("text", F.lit(_LINUX.pattern), F.lit(2))
    found = sources.select("path", F.explode(F.arrays_zip(macro.alias("pattern"), name.alias("name"))).alias("m")).select("path", "m.pattern", "m.name").distinct()
    return symbols.join(found, ["path", "name"]).select("uid", "pattern", F.lit("linux_system_managed").alias("kind"))


# Assessment run


def checked_baseline(snapshots: DataFrame, snapshot: str, baseline: str | None) -> str | None:
    """The error of comparing with a baseline, or None: it must exist, be of the same repository, and be ready."""
    if baseline is None:
        return None
    found = {r["snapshot_uid"]: r for r in snapshots.filter(F.col("snapshot_uid").isin(snapshot, baseline)).select("snapshot_uid", "repo_uid", "status").collect()}  # two rows at most
    if baseline not in found:
        return "baseline_not_found"
    if snapshot in found and found[baseline]["repo_uid"] != found[snapshot]["repo_uid"]:
        return "baseline_of_other_repo"
    return None if found[baseline]["status"] == "ready" else "baseline_not_ready"


def assessment_uid(snapshot, policy, baseline):
    return F.concat(snapshot, F.lit("-qpa-"), policy, F.when(baseline.isNotNull(), F.concat(F.lit("-vs-"), baseline)).otherwise(""))


def measured_facts(measurements: DataFrame, nodes: DataFrame, files: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Measurements (of some kinds, if given) with what policies' scopes ask of them; a value that is no number has none."""
    rows = (measurements if kinds is None else measurements.filter(F.col("kind").isin(*kinds))).select(F.col("target_stable_key").alias("target"), F.col("kind"), json_number(F.col("value_json")).alias("value"))
    named = nodes.select(F.col("stable_key").alias("target"), F.col("subtype").alias("symbol_kind"), "file_uid").join(files.select("file_uid", F.col("path").alias("file")), "file_uid", "left")
    return rows.join(named, "target", "left").withColumn("module", F.regexp_extract("file", r"^(.*)/[^/]*$", 1)).drop("file_uid")
