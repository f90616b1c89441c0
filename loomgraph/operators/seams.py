"""Environment and file-system dependencies rolled up over surfaces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import dealt

#: Equal rows of a result that are made together, in one task.
COPIES = 4096


def env_rollup(rows: DataFrame) -> DataFrame:
    """Per variable: the strongest access, first default in order of ``ord``, whether defaults differ, support.

    ``rows``: name, surface, access (required, optional, unknown), default_value, evidence, confidence, ord.
    """
    rank = F.when(F.col("access") == "required", 0).when(F.col("access") == "optional", 1).otherwise(2)
    return rows.groupBy("name").agg(F.min_by("access", rank).alias("access"), F.min_by("default_value", F.when(F.col("default_value").isNotNull(), F.col("ord"))).alias("default_value"), (F.countDistinct("default_value") > 1).alias("conflicting"), F.countDistinct("surface").alias("surfaces"), F.sum("evidence").alias("evidence"), F.max("confidence").alias("confidence"))


def fs_rollup(rows: DataFrame) -> DataFrame:
    """Per path and kind: surfaces, evidence, sorted destinations, confidence. Dynamic paths aren't rows of it.

    ``rows``: path, kind, surface, destination, evidence, confidence, dynamic.
    """
    return rows.filter("not dynamic").groupBy("path", "kind").agg(F.countDistinct("surface").alias("surfaces"), F.sum("evidence").alias("evidence"), F.array_join(F.array_sort(F.collect_set("destination")), ",").alias("destinations"), F.max("confidence").alias("confidence"))


def fs_dynamic(rows: DataFrame) -> DataFrame:
    """kind, evidence rows and distinct files of dynamic paths, and all of them together (kind ``*``)."""
    dynamic = rows.filter("dynamic")
    per = dynamic.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))
    return per.unionByName(dynamic.agg(F.count("*").alias("n"), F.countDistinct("file").alias("files")).select(F.lit("*").alias("kind"), "n", "files"))


def link(accesses: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Accesses joined to every surface of their file; those of no surface keep a null surface.

    The result has a row for each pair, far more than the accesses. Equal accesses meet the surfaces once, with their
    number; the pairs are dealt over tasks without a key, as a file may hold most of them, in parts of ``COPIES`` rows
    that only the last step writes out. So what is shuffled grows with the surfaces and not with the result, and equal
    rows stand together in it.
    """
    counted = accesses.groupBy(*accesses.columns).agg(F.count("*").alias("_n"))
    pairs = dealt(counted).join(surfaces.select("file", "surface"), "file", "left")
    parts = pairs.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(COPIES).cast("long"))))
    each = dealt(parts.withColumn("_n", F.least(F.col("_n") - F.col("_from"), F.lit(COPIES)).cast("int")).drop("_from"))
    return each.withColumn("_from", F.explode(F.array_repeat(F.lit(0), F.col("_n")))).drop("_n", "_from")
