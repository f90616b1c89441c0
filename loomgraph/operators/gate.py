"""Requirements, obligations, waivers and the gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import compared, half_up
from ..functions.paths import ancestors


def active_waivers(waivers: DataFrame, now: str) -> DataFrame:
    """Active, not yet expired (by text), the newest for each requirement, version and obligation."""
    order = Window.partitionBy("req_id", "version", "obligation_id").orderBy(F.desc("created_at"), "waiver_id")
    alive = waivers.filter(F.col("is_active") & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))
    return alive.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def evidence(obligations: DataFrame, coverage: DataFrame, complexity: DataFrame, hotspots: DataFrame, violations: DataFrame) -> DataFrame:
    """Add measured (rows found) and value by method. Inputs: path, value; ``violations``: source, status.

    Obligations are few human declarations. A row meets those of its own path and of each directory above it, and
    those without a target, by equality, so no obligation is held against all rows.
    """
    few = obligations.select("req_id", "obligation_id", "method", F.coalesce("target", F.lit("")).alias("_key"))
    met = lambda df, column: df.withColumn("_key", F.explode(F.concat(F.array(F.lit("")), ancestors(F.col(column)), F.array(F.col(column)))))

    def one(df: DataFrame, method: str, how: Column) -> DataFrame:
        return met(df, "path").join(few.filter(F.col("method") == method), "_key").groupBy("req_id", "obligation_id").agg(F.count("*").alias("measured"), how.alias("value"))

    placed = met(violations, "source").join(few.filter("method = 'arch_violations' and _key <> ''"), "_key")
    arch = placed.groupBy("req_id", "obligation_id").agg(F.count("*").alias("measured"), F.sum(F.when(F.col("status") == "violated", F.col("import_count")).otherwise(0)).cast("double").alias("value"))
    count = violations.agg(F.count(F.when(F.col("status") == "violated", 1)).cast("double").alias("value"))
    module = few.filter("method = 'module_violations'").crossJoin(F.broadcast(count)).select("req_id", "obligation_id", F.lit(1).cast("long").alias("measured"), "value")
    found = one(coverage, "coverage_threshold", F.avg("value")).unionByName(one(complexity, "complexity_threshold", F.max("value").cast("double"))).unionByName(one(hotspots, "hotspot_threshold", F.max("value").cast("double"))).unionByName(arch).unionByName(module)
    return obligations.join(found, ["req_id", "obligation_id"], "left").withColumn("measured", F.coalesce("measured", F.lit(0)))


def verdicts(with_evidence: DataFrame, waivers: DataFrame) -> DataFrame:
    """computed and effective verdict of each obligation. A waiver never turns a PASS into WAIVED."""
    method, limit = F.col("method"), F.col("threshold")
    known = ("arch_violations", "coverage_threshold", "complexity_threshold", "hotspot_threshold", "module_violations")
    bound = method.isin("coverage_threshold", "complexity_threshold", "hotspot_threshold")
    short = (bound & limit.isNull()) | (method.isin("coverage_threshold", "complexity_threshold", "arch_violations") & F.col("target").isNull())
    op = F.coalesce("operator", F.when(method == "coverage_threshold", ">=").otherwise("<="))
    good = F.when(bound, compared(F.col("value"), op, limit)).otherwise(F.col("value") == 0)
    computed = F.when(~method.isin(*known), "UNSUPPORTED").when(short | (F.col("measured") == 0), "MISSING_EVIDENCE").when(good, "PASS").otherwise("FAIL")
    rows = with_evidence.withColumn("computed", computed).join(F.broadcast(waivers.select("req_id", "version", "obligation_id", "waiver_id")), ["req_id", "version", "obligation_id"], "left")
    waived = F.col("waiver_id").isNotNull() & (F.col("computed") != "PASS")
    value = F.when(F.col("value") >= 0, half_up(F.col("value"), 4))
    return rows.select("req_id", "version", "obligation_id", "method", "target", F.col("measured").cast("long").alias("measured"), value.alias("value"), "computed", F.when(waived, "WAIVED").otherwise(F.col("computed")).alias("effective"), F.when(waived, F.col("waiver_id")).alias("waiver_id"))


def policy_facts(policies: DataFrame, assessments: DataFrame) -> DataFrame:
    """One row per active policy: its assessment, or that it is missing."""
    found = assessments.select("policy_id", "verdict")
    return policies.join(found, "policy_id", "left").withColumn("state", F.when(F.col("verdict").isNull(), "missing").otherwise("present"))


def outcome(judged: DataFrame, facts: DataFrame) -> DataFrame:
    """mode, outcome, exit_code and counts for the three modes."""
    n = lambda c, v: F.count(F.when(F.col(c) == v, 1))
    a = judged.agg(F.count("*").alias("total"), *(n("effective", v).alias(v.lower()) for v in ("PASS", "FAIL", "WAIVED", "MISSING_EVIDENCE", "UNSUPPORTED")))
    b = facts.agg(F.count(F.when((F.col("verdict") == "FAIL") & (F.col("severity") == "fail"), 1)).alias("policy_fail"), n("state", "missing").alias("policy_missing"), n("verdict", "NOT_COMPARABLE").alias("policy_not_comparable"))
    rows = a.crossJoin(F.broadcast(b)).withColumn("mode", F.explode(F.array(F.lit("default"), F.lit("strict"), F.lit("advisory"))))
    failed = (F.col("fail") > 0) | (F.col("policy_fail") > 0)
    open_ = (F.col("missing_evidence") + F.col("unsupported") + F.col("policy_missing") + F.col("policy_not_comparable")) > 0
    result = F.when(failed | ((F.col("mode") == "strict") & open_), "fail").when((F.col("mode") == "default") & open_, "incomplete").otherwise("pass")
    code = F.when(result == "fail", 1).when(result == "incomplete", 2).otherwise(0)
    return rows.select("mode", result.alias("outcome"), code.cast("long").alias("exit_code"), "total", "pass", "fail", "waived", "missing_evidence", "unsupported", "policy_fail", "policy_missing", "policy_not_comparable")
