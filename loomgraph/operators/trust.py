"""How far a snapshot's facts can be trusted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _reasons(*pairs: tuple[Column, Column | str]) -> Column:
    return F.array_compact(F.array(*(F.when(test, F.lit(r) if isinstance(r, str) else r) for test, r in pairs)))


def downgrades(files: DataFrame, cycles: DataFrame, stats: DataFrame, entrypoints: DataFrame) -> DataFrame:
    """One row of triggers. ``cycles``: ancestor, descendant; ``stats``: module, fan_in, fan_out, file_count."""
    path = F.col("path")
    app = F.when(path.startswith("app/"), F.substring(path, 5, 1 << 20)).when(path.contains("/app/"), F.expr("substring(path, locate('/app/', path) + 5)"))
    router = app.rlike(r"/(page|layout)\.[tj]sx$") | app.rlike(r"/route\.[tj]s$")
    react = path.endswith(".tsx") | path.endswith(".jsx")
    a = files.agg(F.count("*").alias("files"), F.coalesce(F.bool_or(F.coalesce(router, F.lit(False))), F.lit(False)).alias("router"), F.count(F.when(react, 1)).alias("react"))
    by = cycles.groupBy("ancestor").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0)).alias("most_cycles"), F.coalesce(F.sum("n"), F.lit(0)).alias("cycles"))
    lone = stats.filter("fan_in = 0 and fan_out = 0 and file_count >= 2 and module <> '.'").agg(F.count("*").alias("suspicious"))
    declared = entrypoints.agg(F.count("*").alias("entrypoints"))
    row = a.crossJoin(F.broadcast(by)).crossJoin(F.broadcast(lone)).crossJoin(F.broadcast(declared))  # one row each
    heavy = F.col("router") | ((F.col("files") > 0) & (F.col("react") >= 0.2 * F.col("files")))
    return row.select("files", "cycles", "most_cycles", "suspicious", "entrypoints", heavy.alias("framework_heavy"), ((F.col("most_cycles") >= 3) | (F.col("cycles") >= 5)).alias("registry_pattern"), (F.col("entrypoints") == 0).alias("missing_entrypoints"), (F.col("suspicious") >= 3).alias("alias_resolution"))


def axes(triggers: DataFrame, counts: DataFrame) -> DataFrame:
    """axis, level, reasons. ``counts``: resolved_calls, unresolved_internal_calls, unresolved_imports; one row each."""
    row = triggers.crossJoin(F.broadcast(counts))
    alias_, registry = F.col("alias_resolution"), F.col("registry_pattern")
    total = F.col("resolved_calls") + F.col("unresolved_internal_calls")
    rate = F.when(total == 0, 1.0).otherwise(F.col("resolved_calls") / total)
    percent = F.format_string("%.1f", rate * 100)
    imports = _reasons((alias_, "alias_resolution_suspicion"), (F.col("unresolved_imports") > 0, F.concat(F.lit("unresolved_imports="), F.col("unresolved_imports").cast("string"))))
    import_level = F.when(F.size(imports) > 0, "LOW").when(registry, "MEDIUM").otherwise("HIGH")
    import_why = F.when(F.size(imports) > 0, imports).when(registry, F.array(F.lit("registry_pattern_suspicion"))).otherwise(F.array().cast("array<string>"))
    call_level = F.when(total == 0, "HIGH").when(rate < 0.5, "LOW").when(rate < 0.85, "MEDIUM").otherwise("HIGH")
    call_why = _reasons(((total > 0) & (rate < 0.5), F.concat(F.lit("call_resolution_rate="), percent, F.lit("%_below_50%"))), ((total > 0) & (rate >= 0.5) & (rate < 0.85), F.concat(F.lit("call_resolution_rate="), percent, F.lit("%_below_85%"))))
    dead = _reasons((F.col("missing_entrypoints"), "missing_entrypoint_declarations"), (registry, "registry_pattern_suspicion"), (F.col("framework_heavy"), "framework_heavy_suspicion"))
    dead_level = F.when(F.size(dead) > 0, "LOW").when(call_level == "LOW", "MEDIUM").otherwise("HIGH")
    dead_why = F.when(F.size(dead) > 0, dead).when(call_level == "LOW", F.array(F.lit("call_graph_reliability_low"))).otherwise(F.array().cast("array<string>"))
    impact = _reasons((alias_, "alias_resolution_suspicion"), (registry, "registry_pattern_suspicion"))
    impact_level = F.when(F.size(impact) > 0, "LOW").otherwise(import_level)
    impact_why = F.when(F.size(impact) > 0, impact).when(import_level != "HIGH", F.array(F.concat(F.lit("import_graph_reliability_"), F.lower(import_level)))).otherwise(F.array().cast("array<string>"))
    each = [("import_graph", import_level, import_why), ("call_graph", call_level, call_why), ("dead_code", dead_level, dead_why), ("change_impact", impact_level, impact_why)]
    axis = F.explode(F.array(*(F.struct(F.lit(n).alias("axis"), level.alias("level"), F.array_join(why, ";").alias("reasons")) for n, level, why in each)))
    return row.select(axis.alias("a")).select("a.*")


def repo_confidence(rate: Column, stale: Column, enrichment: Column) -> Column:
    return F.when(rate < 0.20, "low").when((rate <= 0.50) | stale | (enrichment == "not_run"), "medium").otherwise("high")


def dead_confidence(level: Column) -> Column:
    """Confidence of dead-symbol results, from the level of the dead-code axis."""
    return F.lower(level)


def check_conditions(state: DataFrame) -> DataFrame:
    """Six conditions from one row of state, in order; only the first if there is no snapshot.

    ``state``: snapshot_exists, files_total, stale_files, call_graph, enrichment, gate (null: not available).
    """
    status = [
        ("SNAPSHOT_EXISTS", F.when(F.col("snapshot_exists"), "pass").otherwise("incomplete")),
        ("INDEX_NOT_EMPTY", F.when(F.col("files_total") > 0, "pass").otherwise("incomplete")),
        ("STALE_FILES", F.when(F.col("stale_files") == 0, "pass").otherwise("fail")),
        ("CALL_GRAPH_RELIABILITY", F.when(F.col("call_graph").isin("HIGH", "MEDIUM"), "pass").when(F.col("call_graph") == "LOW", "fail").otherwise("incomplete")),
        ("ENRICHMENT_STATE", F.when(F.col("enrichment").isin("ran", "not_applicable"), "pass").when(F.col("enrichment") == "not_run", "fail").otherwise("incomplete")),
        ("GATE_STATUS", F.when(F.col("gate").isin("pass", "not_configured"), "pass").when(F.col("gate") == "fail", "fail").otherwise("incomplete")),
    ]
    rows = state.select("snapshot_exists", F.posexplode(F.array(*(F.struct(F.lit(c).alias("code"), s.alias("status")) for c, s in status))).alias("ord", "c"))
    return rows.filter(F.col("snapshot_exists") | (F.col("ord") == 0)).select((F.col("ord") + 1).cast("long").alias("ord"), "c.*")


def reduce_verdict(conditions: DataFrame) -> DataFrame:
    """incomplete before fail before pass."""
    has = lambda s: F.coalesce(F.bool_or(F.col("status") == s), F.lit(False))
    return conditions.agg(F.when(has("incomplete"), "incomplete").when(has("fail"), "fail").otherwise("pass").alias("verdict"))


# What a reader is shown for a category; others are shown by name.
LABELS = {
    "imports_file_not_found": "IMPORTS (file not found)",
    "imports_ambiguous_match": "IMPORTS (ambiguous match)",
    "instantiates_class_not_found": "INSTANTIATES (class not found)",
    "implements_interface_not_found": "IMPLEMENTS (interface not found)",
    "calls_this_wildcard_method_needs_type_info": "CALLS this.*.method (needs type info)",
    "calls_this_method_needs_class_context": "CALLS this.method (needs class context)",
    "calls_obj_method_needs_type_info": "CALLS obj.method (needs type info)",
    "calls_function_ambiguous_or_missing": "CALLS function (ambiguous or missing)",
    "other": "OTHER (unclassified)",
}
# What a reader is warned of, and where a level of an axis stands in it.
CAVEATS = (
    ("call_graph", "Call-graph reliability is {} on this repo. Do not use callers/callees for safety-critical decisions without verification."),
    ("import_graph", "Import-graph reliability is {}. Module fan-in/fan-out and change-impact propagation may undercount relationships."),
    ("change_impact", "Change-impact reliability is {}. Impacted-module sets may be incomplete on this repo."),
)
CYCLES_CAVEAT = "Cycle payloads currently emit leaf module names only; full stable keys are not in the user-facing `graph cycles` output."


def tallied(classified: DataFrame) -> DataFrame:
    """category, classification, blast_radius, n of all unresolved references: one pass, and as many rows as there are kinds."""
    return classified.groupBy("category", "classification", "blast_radius").agg(F.count("*").alias("n"))


def report(triggers: DataFrame, tally: DataFrame, resolved_calls: DataFrame, stats: DataFrame) -> DataFrame:
    """section, rank, name, detail, value: a snapshot's trust report as rows, each section in its order (modules, which may be many, have no rank and go by name).

    ``triggers``: from ``downgrades``; ``tally``: from ``tallied``; ``resolved_calls``: one row; ``stats``: module,
    fan_in, fan_out, file_count. Sections: summary, reliability, downgrades, categories, classifications, blast_radius (of
    calls classified unknown), modules, caveats. Dead code is judged, but isn't part of what is reported.
    """
    n, call = F.col("n"), F.col("category").startswith("calls_")
    total = lambda test: F.coalesce(F.sum(F.when(test, n)), F.lit(0)).cast("long")
    outside = call & (F.col("classification") == "external_library_candidate")
    sums = tally.agg(total(F.lit(True)).alias("unresolved_total"), total(call).alias("unresolved_calls"), total(outside).alias("unresolved_calls_external"), total(F.col("category").startswith("imports_")).alias("unresolved_imports"))
    counts = resolved_calls.crossJoin(F.broadcast(sums)).withColumn("unresolved_internal_calls", F.col("unresolved_calls") - F.col("unresolved_calls_external"))  # one row each
    both = F.col("resolved_calls") + F.col("unresolved_internal_calls")
    figures = {c: F.col(c) for c in ("resolved_calls", "unresolved_total", "unresolved_calls", "unresolved_calls_external", "unresolved_imports")} | {"unresolved_calls_internal_like": F.col("unresolved_internal_calls"), "call_resolution_rate": F.when(both == 0, 1.0).otherwise(F.col("resolved_calls") / both)}

    def listed(df: DataFrame, section: str, values: dict[str, Column]) -> DataFrame:
        """One row's columns below each other, in the order given."""
        each = F.array(*(F.struct(F.lit(i).cast("long").alias("rank"), F.lit(k).alias("name"), v.cast("double").alias("value")) for i, (k, v) in enumerate(values.items(), 1)))
        return df.select(F.explode(each).alias("r")).select(F.lit(section).alias("section"), "r.rank", "r.name", F.lit(None).cast("string").alias("detail"), "r.value")

    def ranked(df: DataFrame, section: str, key: str, detail: Column) -> DataFrame:
        """Kinds by their sums, greatest first, then by name; kinds are few."""
        kinds = df.groupBy(F.col(key).alias("name")).agg(F.sum("n").alias("value"))
        order = F.row_number().over(Window.orderBy(F.desc("value"), "name")).cast("long")
        return kinds.select(F.lit(section).alias("section"), order.alias("rank"), "name", detail.alias("detail"), F.col("value").cast("double").alias("value"))

    labels = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    levels = axes(triggers, counts.select("resolved_calls", "unresolved_internal_calls", "unresolved_imports")).filter("axis <> 'dead_code'")
    place = F.when(F.col("axis") == "import_graph", 1).when(F.col("axis") == "call_graph", 2).otherwise(3).cast("long")
    reliability = levels.select(F.lit("reliability").alias("section"), place.alias("rank"), F.col("axis").alias("name"), F.concat_ws(": ", "level", F.nullif(F.col("reasons"), F.lit(""))).alias("detail"), F.lit(None).cast("double").alias("value"))
    flags = {"framework_heavy_suspicion": "framework_heavy", "registry_pattern_suspicion": "registry_pattern", "missing_entrypoint_declarations": "missing_entrypoints", "alias_resolution_suspicion": "alias_resolution"}
    unknown = tally.filter(call & (F.col("classification") == "unknown")).agg(*(total(F.col("blast_radius") == x).alias(x) for x in ("low", "medium", "high")))
    lone = (F.col("fan_in") == 0) & (F.col("fan_out") == 0) & (F.col("file_count") >= 2) & ~F.col("module").isin(".", "")
    modules = stats.select(F.lit("modules").alias("section"), F.lit(None).cast("long").alias("rank"), F.col("module").alias("name"), F.when(lone, "alias_resolution_candidate").alias("detail"), F.col("file_count").cast("double").alias("value"))
    warned = F.array_compact(F.array(*(F.when((F.col("axis") == axis) & (F.col("level") != "HIGH"), F.struct(F.lit(i).cast("long").alias("rank"), F.format_string(text.replace("{}", "%s"), "level").alias("text"))) for i, (axis, text) in enumerate(CAVEATS, 1))))
    last = triggers.select(F.lit(len(CAVEATS) + 1).cast("long").alias("rank"), F.lit(CYCLES_CAVEAT).alias("text"))
    caveats = levels.select(F.explode(warned).alias("c")).select("c.*").unionByName(last).select(F.lit("caveats").alias("section"), F.row_number().over(Window.orderBy("rank")).cast("long").alias("rank"), F.lit(None).cast("string").alias("name"), F.col("text").alias("detail"), F.lit(None).cast("double").alias("value"))
    parts = [
        listed(counts, "summary", figures), reliability, listed(triggers, "downgrades", {k: F.col(c) for k, c in flags.items()}), ranked(tally, "categories", "category", F.coalesce(F.try_element_at(labels, F.col("name")), F.col("name"))),
        ranked(tally, "classifications", "classification", F.lit(None).cast("string")), listed(unknown, "blast_radius", {x: F.col(x) for x in ("low", "medium", "high")}), modules, caveats,
    ]
    return reduce(DataFrame.unionByName, parts)
