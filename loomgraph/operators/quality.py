"""Measurements, churn, hotspots, risk, policies and trends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up, json_number
from ..functions.paths import dirname, glob_regex, is_vendored
from .graph import in_bounded_tasks


def complexity_by_file(measurements: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    value = F.get_json_object("value_json", "$.value").cast("double").cast("long")
    rows = measurements.filter("kind = 'cyclomatic_complexity'").select(F.col("target_uid").alias("uid"), value.alias("_v"))
    return rows.join(symbols.select("uid", "file_uid").hint("merge"), "uid").groupBy("file_uid").agg(F.sum("_v").alias("sum_complexity")).join(files.select(F.col("uid").alias("file_uid"), "path"), "file_uid").select("path", "sum_complexity")


def function_metrics(measurements: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """One row per function: the three metrics side by side."""
    value = json_number(F.col("value_json"))
    names = {"cyclomatic_complexity": "complexity", "parameter_count": "parameters", "max_nesting_depth": "nesting"}
    wide = measurements.groupBy(F.col("target_uid").alias("uid")).agg(*(F.max(F.when(F.col("kind") == k, value)).alias(n) for k, n in names.items()))
    return wide.join(symbols.select("uid", "name", "file_uid"), "uid").join(files.select(F.col("uid").alias("file_uid"), F.col("path").alias("file")), "file_uid", "left").select("uid", "name", "file", *names.values())


def module_metrics(functions: DataFrame) -> DataFrame:
    """Per directory of the functions' files: how many, mean (1 decimal) and greatest of complexity and nesting."""
    rows = functions.filter("file is not null").withColumn("module", dirname(F.col("file")))
    return rows.groupBy("module").agg(F.count("*").alias("functions"), half_up(F.avg("complexity"), 1).alias("avg_complexity"), F.max("complexity").alias("max_complexity"), half_up(F.avg("nesting"), 1).alias("avg_nesting"), F.max("nesting").alias("max_nesting"))


def churn(commits: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Commits and changed lines of each file. A commit that lists a file twice counts once, with all its lines.

    Nearly every row is a pair of its own, so pairs are dealt before they are counted, over tasks of bounded rows.
    """
    lines = commits.select("commit", "file_uid", (F.col("added") + F.col("deleted")).alias("_n"))
    by_commit = in_bounded_tasks(lines, "commit", "file_uid").groupBy("commit", "file_uid").agg(F.sum("_n").alias("_n"))
    rows = by_commit.groupBy("file_uid").agg(F.count("*").alias("commit_count"), F.sum("_n").alias("lines_changed"))
    return rows if files is None else rows.join(files.select(F.col("uid").alias("file_uid"), "path", "is_test"), "file_uid").select("path", "is_test", "commit_count", "lines_changed")


def hotspots(churned: DataFrame, complexity: DataFrame, no_tests: bool = False, no_vendored: bool = False) -> DataFrame:
    """Changed lines times summed complexity, for files that have both."""
    rows = churned.join(complexity, "path")
    if no_tests:
        rows = rows.filter(~F.col("is_test"))
    if no_vendored:
        rows = rows.filter(~is_vendored(F.col("path")))
    return rows.select("path", "commit_count", "lines_changed", "sum_complexity", (F.col("lines_changed") * F.col("sum_complexity")).alias("hotspot_score"))


def normalised(scored: DataFrame) -> DataFrame:
    """Score over the greatest score, 2 decimals."""
    most = scored.agg(F.max("hotspot_score").alias("_most"))
    return scored.crossJoin(F.broadcast(most)).select("path", "hotspot_score", F.when(F.col("_most") > 0, half_up(F.col("hotspot_score") / F.col("_most"))).otherwise(0.0).alias("normalized_score"))  # one row


def risk(scored: DataFrame, coverage: DataFrame) -> DataFrame:
    return scored.join(coverage, "path").select("path", "hotspot_score", "line_coverage", (F.col("hotspot_score") * (1 - F.col("line_coverage"))).alias("risk_score"))


def match_coverage(report: DataFrame, files: DataFrame) -> DataFrame:
    """Report rows (path, line_coverage) with the file they match exactly, or none."""
    return report.join(files.select("path", F.col("uid").alias("file_uid")), "path", "left").withColumn("matched", F.col("file_uid").isNotNull())


# Policies


def scope_condition(clauses: list[tuple[str, str]]):
    """AND of clauses over columns module, file and symbol_kind; metadata that is missing is out of scope."""
    out = F.lit(True)
    for kind, selector in clauses:
        if kind == "module":
            part = (F.col("module") == selector) | F.col("module").startswith(selector.rstrip("/") + "/")
        elif kind == "file":
            part = F.col("file").rlike(glob_regex(selector))
        elif kind == "symbol_kind":
            part = F.col("symbol_kind") == selector
        else:
            part = F.lit(False)
        out = out & F.coalesce(part, F.lit(False))
    return out


def policy_rows(policies: list[dict], facts: DataFrame, baseline: DataFrame | None) -> DataFrame:
    """Every fact in scope of a policy, with whether it violates it.

    Policies are few and typed; facts and the baseline are joined once for all of them, sorted, since a baseline's few
    bytes in a file are very many in a table of hashes. ``facts``: target, kind, value,
    module, file, symbol_kind; ``baseline``: target, kind, value.
    """
    rows = facts if baseline is None else facts.join(baseline.select("target", "kind", F.col("value").alias("_base")).hint("merge"), ["target", "kind"], "left")
    base = F.lit(None).cast("double") if baseline is None else F.col("_base")
    found = []
    for p in policies:
        limit = float(p["threshold"])
        bad = {
            "absolute_max": F.col("value") > limit, "absolute_min": F.col("value") < limit,
            "no_new": base.isNull() & (F.col("value") > limit), "no_worsened": base.isNotNull() & (base > limit) & (F.col("value") > base),
        }[p["policy_kind"]]
        hit = (F.col("kind") == p["measurement_kind"]) & scope_condition(p.get("scope", []))
        found.append(F.when(hit, F.struct(F.lit(p["policy_id"]).alias("policy_id"), F.coalesce(bad, F.lit(False)).alias("violates"))))
    each = F.explode(F.array_compact(F.array(*found)))
    return rows.select("target", "kind", "value", base.alias("baseline_value"), each.alias("_p")).select("_p.*", "target", "kind", "value", "baseline_value")


def assess(policies: list[dict], facts: DataFrame, baseline: DataFrame | None) -> DataFrame:
    """One verdict for each policy: NOT_COMPARABLE without a baseline, NOT_APPLICABLE for an empty scope, else PASS or FAIL."""
    spark = facts.sparkSession
    table = spark.createDataFrame([(p["policy_id"], p["policy_kind"], p.get("severity", "fail")) for p in policies], "policy_id string, policy_kind string, severity string")
    counted = policy_rows(policies, facts, baseline).groupBy("policy_id").agg(F.count("*").alias("measured"), F.count(F.when(F.col("violates"), 1)).alias("violations"))
    lone = F.col("policy_kind").isin("no_new", "no_worsened") & F.lit(baseline is None)
    verdict = F.when(lone, "NOT_COMPARABLE").when(F.coalesce("measured", F.lit(0)) == 0, "NOT_APPLICABLE").when(F.col("violations") > 0, "FAIL").otherwise("PASS")
    count = lambda c: F.when(lone, 0).otherwise(F.coalesce(c, F.lit(0))).alias(c)
    return F.broadcast(table).join(counted, "policy_id", "left").select("policy_id", "policy_kind", "severity", verdict.alias("verdict"), count("measured"), count("violations"))


def validation_errors(policies: DataFrame, kinds: tuple = ("cyclomatic_complexity", "cognitive_complexity", "function_length", "parameter_count", "max_nesting_depth", "line_coverage")) -> DataFrame:
    """All that is wrong with policy payloads (policy_id, version, measurement_kind, policy_kind, threshold), by name."""
    comparative = F.col("policy_kind").isin("no_new", "no_worsened")
    tests = [("empty_policy_id", F.trim(F.coalesce("policy_id", F.lit(""))) == ""), ("bad_version", F.coalesce("version", F.lit(0)) <= 0), ("unknown_kind", ~F.coalesce(F.col("measurement_kind").isin(*kinds), F.lit(False))), ("bad_threshold", F.coalesce(F.isnan("threshold") | F.abs("threshold").eqNullSafe(float("inf")), F.lit(True)) | F.col("threshold").isNull()), ("comparative_coverage", comparative & (F.col("measurement_kind") == "line_coverage"))]
    return policies.withColumn("errors", F.array_compact(F.array(*(F.when(test, name) for name, test in tests))))


# Trends

#: Which way is better: 1 higher, -1 lower, 0 neither.
DIRECTION = {"files": 0, "symbols": 0, "calls": 0, "mutual_imports": -1, "avg_complexity": -1, "max_complexity": -1, "functions": 0, "hotspot_files": -1}


def trend(now: DataFrame, parent: DataFrame | None) -> DataFrame:
    """metric, value, parent_value, delta (4 decimals) and direction of tables of metric and value."""
    rows = now.join(parent.withColumnRenamed("value", "parent_value"), "metric", "left") if parent is not None else now.withColumn("parent_value", F.lit(None).cast("double"))
    delta = F.col("value") - F.col("parent_value")
    way = F.element_at(F.create_map(*(F.lit(x) for kv in DIRECTION.items() for x in kv)), F.col("metric"))
    direction = F.when(F.col("value").isNull(), "no_data").when(F.col("parent_value").isNull(), "new").when((way == 0) | (delta == 0), "unchanged").when(F.signum(delta) == way, "improved").otherwise("worsened")
    rounded = F.when(delta >= 0, half_up(delta, 4)).otherwise(-half_up(-delta, 4))
    return rows.select("metric", "value", "parent_value", rounded.alias("delta"), direction.alias("direction"))


def health(files: DataFrame, symbols: DataFrame, calls: DataFrame, mutual_imports: DataFrame, functions: DataFrame, scored: DataFrame) -> DataFrame:
    """metric, value of a snapshot: each part is aggregated once, and their rows stand below each other."""
    of = lambda df, **metrics: df.agg(*(v.cast("double").alias(k) for k, v in metrics.items())).select(F.explode(F.create_map(*(x for k in metrics for x in (F.lit(k), F.col(k))))).alias("metric", "value"))
    rows = F.count("*")
    parts = [
        of(files, files=rows), of(symbols.filter("file_uid is not null"), symbols=rows), of(calls, calls=rows), of(mutual_imports, mutual_imports=rows),
        of(functions.filter("file is not null"), avg_complexity=half_up(F.avg("complexity"), 1), max_complexity=F.max("complexity"), functions=rows), of(scored.filter("hotspot_score > 0"), hotspot_files=rows),
    ]
    return reduce(DataFrame.unionByName, parts)


def best_by(df: DataFrame, key: str, order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")
