"""Reads and writes of resources, from calls to known library functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File functions of one runtime's standard library, by module and direction.
FS_MODULES = ("fs", "node:fs", "fs/promises", "node:fs/promises")
FS_READS, FS_WRITES = ("readFile", "readFileSync"), ("writeFile", "writeFileSync", "appendFile", "appendFileSync")
# What a resource kind is as a node, and how its key is made.
KINDS = {"fs": "FS_PATH", "db": "DB_RESOURCE", "cache": "STATE", "blob": "BLOB"}


def bindings(spark: SparkSession) -> DataFrame:
    """language, module, symbol, resource_kind, driver, direction (read, write, read_write)."""
    rows = [("typescript", m, s, "fs", "node-fs", d) for m in FS_MODULES for names, d in ((FS_READS, "read"), (FS_WRITES, "write")) for s in names if not ("promises" in m and s.endswith("Sync"))]
    return spark.createDataFrame(rows, "language string, module string, symbol string, resource_kind string, driver string, direction string")


def resource_key(repo, kind, driver, name):
    """The stable key of a resource; files have no driver in theirs."""
    node = F.element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), kind)
    return F.when(kind == "fs", F.concat_ws(":", repo, kind, name, node)).otherwise(F.concat_ws(":", repo, kind, driver, name, node))


def matched(callsites: DataFrame, imports: DataFrame, table: DataFrame) -> DataFrame:
    """Call sites whose file imports the module that the callee comes from, and whose function is bound.

    ``callsites``: edge_uid, source_uid, file_uid, language, module, symbol, logical_name, literal; ``imports``:
    file_uid, module. The table of bindings is fixed and small.
    """
    known = imports.select("file_uid", "module").distinct()
    return callsites.filter("module is not null").join(known, ["file_uid", "module"], "left_semi").join(F.broadcast(table), ["language", "module", "symbol"])


def emitted(found: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """Resource nodes (key, kind, name), each once, and edges (source_uid, target_key, type, resolution).

    A call that reads and writes gives an edge of each kind. Names from literals are static, others inferred. Names that
    are empty or hold the key's separator are left out.
    """
    good = found.filter((F.length(F.coalesce("logical_name", F.lit(""))) > 0) & ~F.col("logical_name").contains("\n"))
    rows = good.withColumn("key", resource_key(F.lit(repo), F.col("resource_kind"), F.col("driver"), F.col("logical_name")))
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv)), F.col("resource_kind"))
    nodes = rows.select("key", kind.alias("kind"), F.col("logical_name").alias("name")).dropDuplicates(["key"])
    types = F.when(F.col("direction") == "read", F.array(F.lit("READS"))).when(F.col("direction") == "write", F.array(F.lit("WRITES"))).otherwise(F.array(F.lit("READS"), F.lit("WRITES")))
    edges = rows.select("source_uid", F.col("key").alias("target_key"), F.explode(types).alias("type"), F.when(F.col("literal"), "static").otherwise("inferred").alias("resolution"))
    return nodes, edges
