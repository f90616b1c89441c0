"""Modules: coupling, dependencies, boundaries, roll-ups, discovery and ownership."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import half_up, ratio
from ..functions.paths import ancestors


def module_stats(modules: DataFrame, files: DataFrame, symbols: DataFrame, module_imports: DataFrame) -> DataFrame:
    """Coupling and abstractness of each module that owns a file; distance comes from unrounded values."""
    fan_in = module_imports.groupBy(F.col("dst").alias("uid")).agg(F.countDistinct("src").alias("fan_in"))
    fan_out = module_imports.groupBy(F.col("src").alias("uid")).agg(F.countDistinct("dst").alias("fan_out"))
    owned = files.groupBy(F.col("module_uid").alias("uid")).agg(F.count("*").alias("file_count"))
    count = lambda *kinds: F.count(F.when(F.col("subtype").isin(*kinds), 1))
    kinds = symbols.join(files.select(F.col("uid").alias("file_uid"), F.col("module_uid")), "file_uid").groupBy(F.col("module_uid").alias("uid")).agg(F.count(F.when(F.col("visibility") == "export", 1)).alias("symbol_count"), count("INTERFACE", "TYPE_ALIAS").alias("_abstract"), count("INTERFACE", "TYPE_ALIAS", "CLASS", "ENUM").alias("_types"))
    rows = modules.select("uid", F.col("path").alias("module")).join(owned, "uid").join(fan_in, "uid", "left").join(fan_out, "uid", "left").join(kinds, "uid", "left").na.fill(0)
    instability, abstractness = ratio(F.col("fan_out"), F.col("fan_in") + F.col("fan_out")), ratio(F.col("_abstract"), F.col("_types"))
    return rows.select("module", "fan_in", "fan_out", half_up(instability).alias("instability"), half_up(abstractness).alias("abstractness"), half_up(F.abs(abstractness + instability - 1)).alias("distance_from_main_sequence"), "file_count", "symbol_count")


def trust_stats(modules: DataFrame, files: DataFrame, module_imports: DataFrame) -> DataFrame:
    """Fan-in, fan-out and file count of every module, also of those without files."""
    fan_in = module_imports.groupBy(F.col("dst").alias("uid")).agg(F.countDistinct("src").alias("fan_in"))
    fan_out = module_imports.groupBy(F.col("src").alias("uid")).agg(F.countDistinct("dst").alias("fan_out"))
    owned = files.groupBy(F.col("module_uid").alias("uid")).agg(F.count("*").alias("file_count"))
    return modules.filter("path is not null").select("uid", F.col("path").alias("module")).join(fan_in, "uid", "left").join(fan_out, "uid", "left").join(owned, "uid", "left").na.fill(0).select("module", "fan_in", "fan_out", "file_count")


def dependency_edges(file_imports: DataFrame, files: DataFrame, modules: DataFrame) -> DataFrame:
    """Imports across modules: how many, and from how many files."""
    a = files.select(F.col("uid").alias("src"), F.col("module_uid").alias("_a"))
    b = files.select(F.col("uid").alias("dst"), F.col("module_uid").alias("_b"))
    pairs = file_imports.join(a, "src").join(b, "dst").filter("_a <> _b").groupBy("_a", "_b").agg(F.count("*").alias("import_count"), F.countDistinct("src").alias("source_file_count"))
    names = modules.select("uid", "path")
    return pairs.join(names.toDF("_a", "source"), "_a").join(names.toDF("_b", "target"), "_b").select(F.col("_a").alias("source_uid"), "source", F.col("_b").alias("target_uid"), "target", "import_count", "source_file_count")


def dependency_diagnostics(file_imports: DataFrame, ownership: DataFrame) -> DataFrame:
    """One row of counts; an import without source owner counts there alone. ``ownership``: file_uid, module_uid."""
    a = ownership.select(F.col("file_uid").alias("src"), F.col("module_uid").alias("_a"))
    b = ownership.select(F.col("file_uid").alias("dst"), F.col("module_uid").alias("_b"))
    kind = F.when(F.col("_a").isNull(), "source_unowned").when(F.col("_b").isNull(), "target_unowned").when(F.col("_a") == F.col("_b"), "intra").otherwise("cross")
    rows = file_imports.join(a, "src", "left").join(b, "dst", "left").select(kind.alias("k"))
    return rows.agg(F.count("*").alias("imports_total"), *(F.count(F.when(F.col("k") == k, 1)).alias(k) for k in ("source_unowned", "target_unowned", "intra", "cross")))


def weighted_neighbours(edges: DataFrame) -> DataFrame:
    """Both directions of each module's dependencies with their weight and rank."""
    out = edges.select(F.col("source").alias("module"), F.lit("outbound").alias("direction"), F.col("target").alias("neighbour"), F.col("target_uid").alias("_u"), "import_count")
    back = edges.select(F.col("target").alias("module"), F.lit("inbound").alias("direction"), F.col("source").alias("neighbour"), F.col("source_uid").alias("_u"), "import_count")
    order = Window.partitionBy("module", "direction").orderBy(F.desc("import_count"), "_u")
    return out.unionByName(back).withColumn("rank", F.row_number().over(order).cast("long")).drop("_u")


def boundary_rules(rules: DataFrame, edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Each rule (source, target, reason): stale side if a module is gone, else violated or kept, with import counts."""
    names = modules.select("path")
    a, b = names.select(F.col("path").alias("source"), F.lit(True).alias("_a")), names.select(F.col("path").alias("target"), F.lit(True).alias("_b"))
    found = rules.join(a, "source", "left").join(b, "target", "left").join(edges.select("source", "target", "import_count", "source_file_count"), ["source", "target"], "left")
    stale = F.when(F.col("_a").isNull() & F.col("_b").isNull(), "both").when(F.col("_a").isNull(), "source").when(F.col("_b").isNull(), "target")
    return found.select("source", "target", "reason", stale.alias("stale"), F.when(stale.isNotNull(), "stale").when(F.col("import_count").isNotNull(), "violated").otherwise("kept").alias("status"), F.coalesce("import_count", F.lit(0)).alias("import_count"), F.coalesce("source_file_count", F.lit(0)).alias("source_file_count"))


def module_rollups(modules: DataFrame, files: DataFrame, edges: DataFrame, violations: DataFrame, dead: DataFrame) -> DataFrame:
    """One row per module: files, dependencies both ways, violations by source, dead symbols. ``dead``: file, is_test."""
    owned = files.groupBy(F.col("module_uid").alias("uid")).agg(F.count("*").alias("files"), F.count(F.when(F.col("is_test"), 1)).alias("test_files"))
    out = edges.groupBy(F.col("source").alias("module")).agg(F.count("*").alias("outbound_modules"), F.sum("import_count").alias("outbound_imports"))
    back = edges.groupBy(F.col("target").alias("module")).agg(F.count("*").alias("inbound_modules"), F.sum("import_count").alias("inbound_imports"))
    bad = violations.filter("status = 'violated'").groupBy(F.col("source").alias("module")).agg(F.count("*").alias("violations"))
    home = files.select(F.col("path").alias("file"), F.col("module_uid").alias("uid"))
    gone = dead.join(home, "file").groupBy("uid").agg(F.count(F.when(~F.col("is_test"), 1)).alias("dead_symbols"), F.count(F.when(F.col("is_test"), 1)).alias("dead_test_symbols"))
    return modules.select("uid", F.col("path").alias("module")).join(owned, "uid", "left").join(gone, "uid", "left").join(out, "module", "left").join(back, "module", "left").join(bad, "module", "left").na.fill(0).drop("uid")


def assign_ownership(files: DataFrame, roots: DataFrame) -> DataFrame:
    """The longest root that holds a file owns it; of equal ones declared before operational before inferred.

    A root is equal to an ancestor of the file (or to ``.``), so this is an equality join on ancestors and not a prefix
    search. ``roots``: root, module_uid, kind.
    """
    rank = F.when(F.col("kind") == "declared", 0).when(F.col("kind") == "operational", 1).otherwise(2)
    places = files.select(F.col("uid").alias("file_uid"), "path", F.explode(F.concat(F.array(F.lit(".")), ancestors(F.col("path")))).alias("root"))
    length = F.when(F.col("root") == ".", 0).otherwise(F.length("root"))
    order = F.struct((-length).alias("l"), rank.alias("r"), F.col("module_uid").alias("m"))
    return places.join(roots, "root").groupBy("file_uid", "path").agg(F.min_by(F.struct("module_uid", "root", "kind"), order).alias("_o")).select("file_uid", "path", "_o.*")


def candidate_rollups(candidates: DataFrame, evidence: DataFrame, ownership: DataFrame, files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Counts per candidate, its sources joined in order, and the source of most confidence (ties by name)."""
    per_file = symbols.groupBy("file_uid").agg(F.count("*").alias("_n"))
    owned = ownership.join(files.select(F.col("uid").alias("file_uid"), "is_test"), "file_uid").join(per_file, "file_uid", "left").groupBy("module_uid").agg(F.count("*").alias("files"), F.count(F.when(F.col("is_test"), 1)).alias("test_files"), F.sum(F.coalesce("_n", F.lit(0))).alias("symbols"))
    seen = evidence.groupBy("module_uid").agg(F.count("*").alias("evidence"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"), F.min_by("source", F.struct((-F.col("confidence")).alias("c"), "source")).alias("primary_source"))
    return candidates.join(owned, "module_uid", "left").join(seen, "module_uid", "left").na.fill(0, ["files", "test_files", "symbols", "evidence"])


def discover(roots: DataFrame) -> DataFrame:
    """Merge discovered roots by path: kind by precedence, greatest confidence, first name in order of ``ord``."""
    rank = F.when(F.col("kind") == "declared", 0).when(F.col("kind") == "operational", 1).otherwise(2)
    path = F.when(F.regexp_replace("root", "^\\./|/+$", "") == "", ".").otherwise(F.regexp_replace("root", "^\\./|/+$", ""))
    return roots.groupBy(path.alias("root")).agg(F.min_by("kind", rank).alias("kind"), F.max("confidence").alias("confidence"), F.min_by("name", F.when(F.col("name").isNotNull(), F.col("ord"))).alias("name"), F.count("*").alias("evidence"))


def directory_modules(files: DataFrame, depth: int = 2, least_files: int = 5, share: float = 0.8) -> DataFrame:
    """Directories of a depth with enough files of which one language has a large enough share."""
    parts = F.split("path", "/")
    rows = files.filter(F.size(parts) > depth).select(F.array_join(F.slice(parts, 1, depth), "/").alias("directory"), "language")
    langs = rows.groupBy("directory", "language").agg(F.count("*").alias("_n"))
    tops = langs.groupBy("directory").agg(F.sum("_n").alias("files"), F.max("_n").alias("_top"), F.min_by("language", F.struct((-F.col("_n")).alias("n"), "language")).alias("language"))
    return tops.filter((F.col("files") >= least_files) & (F.col("_top") / F.col("files") >= share)).select("directory", "language", "files", half_up(F.col("_top") / F.col("files"), 4).alias("share"))


def promote_surfaces(surfaces: DataFrame, roots: DataFrame, least: float = 0.70, cap: float = 0.85, kinds: tuple = ("cli", "backend_service", "web_app", "worker")) -> DataFrame:
    """Roots of well-supported surfaces that no module has yet become operational modules."""
    return surfaces.filter(F.col("kind").isin(*kinds) & (F.col("confidence") >= least)).groupBy("root").agg(F.least(F.max("confidence"), F.lit(cap)).alias("confidence"), F.count("*").alias("surfaces")).join(roots.select("root").distinct(), "root", "left_anti")
