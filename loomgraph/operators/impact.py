"""What a change touches: from a diff to files, their modules, and all modules that import these."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph

# What a reader of the result must know.
CAVEATS = (
    "Propagation uses reverse MODULE IMPORTS only.",
    "Call edges (CALLS) are NOT included in this slice.",
    "Dynamic and runtime dispatch edges are NOT modeled.",
    "Registry/framework liveness (plugin registration, render maps) is NOT modeled; impact may be under-reported on such codebases.",
    "Impact is computed over the current indexed snapshot's module graph; changes to import edges in the working tree since indexing are not reflected.",
)


def diff_arguments(scope: str, basis_commit: str | None = None, ref: str | None = None) -> list[str]:
    """Arguments of ``git`` whose output ``reports.changed_paths`` reads, for a scope: against_snapshot, staged, since_ref."""
    asked = {"against_snapshot": basis_commit, "since_ref": ref}
    if scope == "staged":
        return ["diff", "--cached", "--name-status"]
    if scope not in asked:
        raise ValueError(f"unknown scope {scope!r}")
    if not asked[scope]:
        raise ValueError("the snapshot has no basis commit" if scope == "against_snapshot" else "since_ref needs a ref")
    return ["diff", "--name-status", asked[scope]]


def changed_files(changes: DataFrame, files: DataFrame, modules: DataFrame) -> DataFrame:
    """path, matched, owning_module, unmatched_reason of each changed path once.

    ``changes``: path; ``files``: path, module_uid (null: no module owns it); ``modules``: uid, path.
    """
    known = files.select("path", "module_uid", F.lit(True).alias("_known"))
    rows = changes.select("path").filter("path is not null").distinct().join(known, "path", "left").join(modules.select(F.col("uid").alias("module_uid"), F.col("path").alias("owning_module")), "module_uid", "left")
    why = F.when(F.col("_known").isNull(), "not_in_snapshot").when(F.col("owning_module").isNull(), "no_owning_module")
    return rows.select("path", F.col("_known").isNotNull().alias("matched"), "owning_module", why.alias("unmatched_reason"))


def impacted_modules(changed: DataFrame, modules: DataFrame, module_imports: DataFrame, max_depth: int | None = None) -> DataFrame:
    """module, distance, reason (seed, reverse_import). ``changed``: from ``changed_files``; no bound by default."""
    named = modules.select(F.col("uid").alias("node"), F.col("path").alias("module"))
    seeds = changed.filter("owning_module is not null").select(F.col("owning_module").alias("module")).distinct().join(named, "module").select("node")
    found = graph.reverse_impact(module_imports, seeds, max_depth).join(named, "node")
    return found.select("module", F.col("depth").alias("distance"), F.when(F.col("depth") == 0, "seed").otherwise("reverse_import").alias("reason"))


def counts(changed: DataFrame, impacted: DataFrame) -> DataFrame:
    """One row of counts."""
    a = changed.agg(F.count("*").alias("changed_files"), F.count(F.when(F.col("matched"), 1)).alias("changed_files_matched"), F.count(F.when(~F.col("matched"), 1)).alias("changed_files_unmatched"))
    b = impacted.agg(F.count(F.when(F.col("reason") == "seed", 1)).alias("seed_modules"), F.count("*").alias("impacted_modules"), F.coalesce(F.max("distance"), F.lit(0)).cast("long").alias("max_distance"))
    return a.crossJoin(F.broadcast(b))  # one row each
