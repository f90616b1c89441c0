"""Signals, ranking and budgets of summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Code, category, severity, place within its tier.
SIGNALS = (
    ("CHECK_PASS", "check", "low", 0), ("CHECK_FAIL", "check", "high", 0), ("CHECK_INCOMPLETE", "check", "medium", 0),
    ("GATE_PASS", "gate", "low", 0), ("GATE_FAIL", "gate", "high", 0), ("GATE_INCOMPLETE", "gate", "medium", 0),
    ("BOUNDARY_VIOLATIONS", "boundary", "high", 0),
    ("TRUST_LOW_RESOLUTION", "trust", "medium", 0), ("TRUST_STALE_SNAPSHOT", "trust", "medium", 1), ("TRUST_NO_ENRICHMENT", "trust", "low", 2),
    ("IMPORT_CYCLES", "structure", "medium", 0), ("HIGH_COMPLEXITY", "structure", "medium", 1), ("HIGH_FAN_OUT", "structure", "low", 0), ("HIGH_INSTABILITY", "structure", "low", 1),
    ("CALLERS_SUMMARY", "structure", "low", 2), ("CALLEES_SUMMARY", "structure", "low", 3),
    ("MODULE_SUMMARY", "informational", "low", 0), ("SNAPSHOT_INFO", "informational", "low", 1),
)
# Order of categories and severities, and how much each budget shows.
CATEGORIES, SEVERITIES = ("check", "gate", "boundary", "trust", "structure", "informational"), ("low", "medium", "high")
BUDGETS = {"small": (5, 3, 3), "medium": (15, 5, 5), "large": (50, 20, 10)}


def catalogue(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SIGNALS, "code string, category string, severity string, tier int")


def ranked(signals: DataFrame, known: DataFrame) -> DataFrame:
    """Rank signals (code, ord: order in which they were made) by severity, category, tier, then order."""
    at = lambda names, c: F.array_position(F.array(*(F.lit(n) for n in names)), F.col(c))
    rows = signals.join(F.broadcast(known), "code")  # the catalogue is fixed
    order = Window.orderBy(F.desc(at(SEVERITIES, "severity")), at(CATEGORIES, "category"), "tier", "ord", "code")
    return rows.withColumn("rank", F.row_number().over(order).cast("long"))


def within(ranked_rows: DataFrame, budget: str) -> DataFrame:
    """The rows a budget shows, each with how many were left out."""
    cap = BUDGETS[budget][0]
    total = ranked_rows.agg(F.count("*").alias("_n"))
    return ranked_rows.crossJoin(F.broadcast(total)).filter(F.col("rank") <= cap).withColumn("omitted", F.greatest(F.col("_n") - cap, F.lit(0))).drop("_n")


def module_signals(stats: DataFrame, fan_out: int = 20, instability: float = 0.7) -> DataFrame:
    """Signals about modules: how many are over a limit."""
    row = stats.agg(F.count("*").alias("modules"), F.count(F.when(F.col("fan_out") >= fan_out, 1)).alias("out"), F.count(F.when(F.col("instability") >= instability, 1)).alias("unstable"))
    each = F.explode(F.array_compact(F.array(F.struct(F.lit("MODULE_SUMMARY").alias("code"), F.col("modules").alias("n"), F.lit(0).alias("ord")), F.when(F.col("out") > 0, F.struct(F.lit("HIGH_FAN_OUT").alias("code"), F.col("out").alias("n"), F.lit(1).alias("ord"))), F.when(F.col("unstable") > 0, F.struct(F.lit("HIGH_INSTABILITY").alias("code"), F.col("unstable").alias("n"), F.lit(2).alias("ord"))))))
    return row.select(each.alias("s")).select("s.*")


def counted(code: str, rows: DataFrame, ord_: int) -> DataFrame:
    """A signal with the number of rows, if there are any."""
    return rows.agg(F.count("*").alias("n")).filter("n > 0").select(F.lit(code).alias("code"), "n", F.lit(ord_).alias("ord"))


def callers_by_module(found: DataFrame) -> DataFrame:
    """key, module, n of the neighbours of each symbol."""
    return found.groupBy("key", F.coalesce("module", F.lit("")).alias("module")).agg(F.count("*").alias("n"))


def explain(sections: dict[str, DataFrame], cap: int = 15) -> DataFrame:
    """section, item, rank, omitted: at most ``cap`` items of each section, in order of item."""
    out = None
    for name, rows in sections.items():
        item = rows.select(F.lit(name).alias("section"), F.col(rows.columns[0]).cast("string").alias("item")).distinct()
        out = item if out is None else out.unionByName(item)
    order = Window.partitionBy("section").orderBy("item")
    total = out.groupBy("section").agg(F.count("*").alias("_n"))
    return out.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= cap).join(total, "section").select("section", "item", "rank", F.greatest(F.col("_n") - cap, F.lit(0)).alias("omitted"))
