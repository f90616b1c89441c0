"""Refresh between snapshots: what to extract again, what to copy, what to delete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors, basename, dirname

# Files whose change widens to what lies beside and below them.
CONFIGS = ("package.json", "pnpm-workspace.yaml", "tsconfig.json", "Cargo.toml", "build.gradle", "settings.gradle", "pyproject.toml", "compile_commands.json")


def invalidation(parent: DataFrame, current: DataFrame) -> DataFrame:
    """file_uid, path, disposition, action. Both tables: file_uid, path, content_hash.

    An unchanged file below a changed configuration file's directory is extracted again. That is a join of ancestor
    directories with the directories of changed configurations.
    """
    p = parent.select("file_uid", F.col("path").alias("_pp"), F.col("content_hash").alias("_ph"))
    c = current.select("file_uid", F.col("path").alias("_cp"), F.col("content_hash").alias("_ch"))
    kind = F.when(F.col("_cp").isNull(), "deleted").when(F.col("_pp").isNull(), "new").when(F.col("_ph") == F.col("_ch"), "unchanged").otherwise("changed")
    rows = p.join(c, "file_uid", "full_outer").select("file_uid", F.coalesce("_cp", "_pp").alias("path"), kind.alias("_k"))
    scopes = rows.filter((F.col("_k") == "changed") & basename(F.col("path")).isin(*CONFIGS)).select(dirname(F.col("path")).alias("_scope")).distinct()
    places = rows.filter("_k = 'unchanged'").select("file_uid", F.explode(F.concat(F.array(F.lit("")), ancestors(F.col("path")))).alias("_scope"))
    wide = places.join(scopes, "_scope", "left_semi").select("file_uid").distinct().withColumn("_w", F.lit(True))
    rows = rows.join(wide, "file_uid", "left").withColumn("disposition", F.when(F.col("_w"), "config_widened").otherwise(F.col("_k")))
    action = F.when(F.col("disposition") == "unchanged", "copy").when(F.col("disposition") == "deleted", "delete").otherwise("extract")
    return rows.select("file_uid", "path", "disposition", action.alias("action"))


def copy_forward(nodes: DataFrame, edges: DataFrame, plan: DataFrame, snapshot: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of unchanged files under uids of the new snapshot; edges go with their source's file.

    The new uid is a digest of snapshot and old uid, so a lost task makes the same one again. ``nodes``: uid, file_uid;
    ``edges``: src, dst. Targets keep their old uid where their own file isn't copied.
    """
    kept = plan.filter("action = 'copy'").select("file_uid")
    fresh = lambda c: F.substring(F.sha2(F.concat_ws("|", F.lit(snapshot), c), 256), 1, 32)
    own = nodes.join(kept, "file_uid", "left_semi").withColumn("new_uid", fresh(F.col("uid")))
    ids = own.select("uid", "new_uid")
    moved = edges.join(ids.toDF("src", "_s"), "src").join(ids.toDF("dst", "_d"), "dst", "left")
    return own, moved.select(F.col("_s").alias("src"), F.coalesce("_d", "dst").alias("dst"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key isn't in the new ones, and the new ones."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def delete_files(nodes: DataFrame, edges: DataFrame, file_uids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Take away the nodes of files, and every edge that touches one of them."""
    gone = nodes.join(file_uids, "file_uid", "left_semi").select("uid")
    return nodes.join(file_uids, "file_uid", "left_anti"), edges.join(gone.withColumnRenamed("uid", "src"), "src", "left_anti").join(gone.withColumnRenamed("uid", "dst"), "dst", "left_anti")
