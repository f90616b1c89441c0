"""Lookups and one-hop joins over nodes and edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import under


def resolve_symbols(requests: DataFrame, symbols: DataFrame) -> DataFrame:
    """Name resolution for a table of ``query`` strings: key, then qualified name, then name; the first step that finds
    anything decides, and more than one match there is ambiguous.

    Returns query, status (found, ambiguous, not_found), step, n, keys (sorted, joined by commas).
    """
    steps = None
    for at, column in enumerate(("uid", "qualified_name", "name"), 1):
        found = symbols.filter(F.col(column).isNotNull()).select(F.col(column).alias("query"), F.col("uid").alias("_key"), F.lit(at).alias("_step"))
        steps = found if steps is None else steps.unionByName(found)
    asked = requests.select("query").distinct()
    hits = asked.join(steps, "query", "left").groupBy("query", "_step").agg(F.array_join(F.array_sort(F.collect_list("_key")), ",").alias("_keys"), F.count("_key").alias("_n"))
    first = hits.groupBy("query").agg(F.min(F.struct("_step", "_n", "_keys")).alias("_h"))
    n = F.col("_h._n")
    return first.select("query", F.when(n == 0, "not_found").when(n == 1, "found").otherwise("ambiguous").alias("status"), F.col("_h._step").cast("long").alias("step"), n.alias("n"), F.col("_h._keys").alias("keys"))


def neighbours(edges: DataFrame, symbols: DataFrame, files: DataFrame, side: str) -> DataFrame:
    """One row for each edge: the key asked about, and the symbol at the other end with its file.

    ``side`` is ``callers`` (the key is the target) or ``callees``.
    """
    key, other = ("dst", "src") if side == "callers" else ("src", "dst")
    ends = symbols.select(F.col("uid").alias("_u"), "name", "qualified_name", "subtype", "file_uid", "line_start")
    return edges.join(ends, F.col(other) == F.col("_u")).join(files.select(F.col("uid").alias("_f"), F.col("path").alias("file")), F.col("file_uid") == F.col("_f"), "left").select(F.col(key).alias("key"), F.col(other).alias("neighbour"), "name", "qualified_name", "subtype", "file", "line_start")


def with_modules(found: DataFrame, symbols: DataFrame, files: DataFrame, modules: DataFrame) -> DataFrame:
    """Add the owning module of each neighbour."""
    home = symbols.select(F.col("uid").alias("neighbour"), "file_uid").join(files.select(F.col("uid").alias("file_uid"), "module_uid"), "file_uid", "left").join(modules.select(F.col("uid").alias("module_uid"), F.col("path").alias("module")), "module_uid", "left")
    return found.join(home.select("neighbour", "module"), "neighbour", "left")


def imports_of(file_imports: DataFrame, files: DataFrame) -> DataFrame:
    """The files each file imports, by path, with depth 1."""
    a = files.select(F.col("uid").alias("src"), F.col("path").alias("file"))
    b = files.select(F.col("uid").alias("dst"), F.col("path").alias("target"), "language")
    return file_imports.join(a, "src").join(b, "dst").select("file", "target", "language", F.lit(1).cast("long").alias("depth"))


def accessors(accesses: DataFrame, symbols: DataFrame, files: DataFrame, kind: str) -> DataFrame:
    """Symbols that read (READS) or write (WRITES) each resource."""
    found = accesses.filter(F.col("type") == kind).join(symbols.select(F.col("uid").alias("src"), "name", "file_uid"), "src")
    return found.join(files.select(F.col("uid").alias("file_uid"), F.col("path").alias("file")), "file_uid", "left").select("resource", F.col("src").alias("symbol"), "name", "file")


def imports_between(file_imports: DataFrame, files: DataFrame, rules: DataFrame) -> DataFrame:
    """Imports from below ``source`` to below ``target`` for each rule.

    A path is below each of its ancestor directories, so the prefix test is an equality join on ancestors, and rules may
    be many.
    """
    from ..functions.paths import ancestors

    a = files.select(F.col("uid").alias("src"), F.col("path").alias("source_file"), F.explode(ancestors(F.col("path"))).alias("source"))
    b = files.select(F.col("uid").alias("dst"), F.col("path").alias("target_file"))
    wanted = rules.select(F.regexp_replace("source", "/+$", "").alias("source"), F.regexp_replace("target", "/+$", "").alias("target")).distinct()
    return file_imports.join(a.join(wanted, "source"), "src").join(b, "dst").filter(F.col("target_file").startswith(F.concat("target", F.lit("/")))).select("source", "target", "source_file", "target_file")


def path_focus(requests: DataFrame, files: DataFrame, modules: DataFrame) -> DataFrame:
    """For each ``path``: is it a file, has it files below, the file's and the module's key."""
    from ..functions.paths import ancestors

    exact = files.select("path", F.col("uid").alias("file_key"))
    below = files.select(F.explode(ancestors(F.col("path"))).alias("path")).distinct().withColumn("_below", F.lit(True))
    mods = modules.select("path", F.col("uid").alias("module_key"))
    out = requests.select("path").distinct().join(exact, "path", "left").join(below, "path", "left").join(mods, "path", "left")
    return out.select("path", F.col("file_key").isNotNull().alias("is_file"), F.coalesce("_below", F.lit(False)).alias("has_files_below"), "file_key", "module_key")


def path_summary(files: DataFrame, symbols: DataFrame, prefixes: Sequence[str] | None = None) -> DataFrame:
    """Files, symbols and languages below each directory (or the given ones)."""
    from ..functions.paths import ancestors

    counts = symbols.groupBy("file_uid").agg(F.count("*").alias("_n"))
    rows = files.join(counts, F.col("uid") == F.col("file_uid"), "left").select(F.explode(ancestors(F.col("path"))).alias("path"), "uid", "language", F.coalesce("_n", F.lit(0)).alias("_n"))
    if prefixes is not None:
        rows = rows.filter(F.col("path").isin(*prefixes))
    return rows.groupBy("path").agg(F.countDistinct("uid").alias("files"), F.sum("_n").alias("symbols"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"))


def files_with_counts(files: DataFrame, symbols: DataFrame) -> DataFrame:
    counts = symbols.groupBy("file_uid").agg(F.count("*").alias("symbols"))
    return files.join(counts, F.col("uid") == F.col("file_uid"), "left").select("path", "language", F.coalesce("symbols", F.lit(0)).alias("symbols"))


def top_measurements(measurements: DataFrame, kind: str, limit: int) -> DataFrame:
    """The largest values of a kind, ties by target."""
    value = F.get_json_object("value_json", "$.value").cast("double")
    return measurements.filter(F.col("kind") == kind).select("target_uid", "kind", value.alias("value")).orderBy(F.desc("value"), "target_uid").limit(limit)


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """The first row of each key in an order that must be total."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")


def in_path(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    return rows.filter(under(F.col(column), F.lit(prefix)))
