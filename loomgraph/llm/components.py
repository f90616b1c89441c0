"""Connected components by alternating large-star and small-star steps, all in DataFrames.

Defined cases: links of a node with itself and repeated links change nothing; links with a null end are left out; an
empty table of links gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u").toDF("u", "v"))
    least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = staged(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct()


def roots(links: DataFrame, a: str, b: str) -> DataFrame:
    """Columns u, v: each node that is in a link and isn't the smallest of its component, with that smallest node.

    Steps repeat until nothing changes; each is written to the shared folder. A hub is never gathered: minima are
    partial aggregates, written before the join, which then has one row for each key on that side and can split the other.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    edges = staged(edges, "links")
    seen = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen or not now[0]:
            return edges
        seen = now
        edges = staged(_small(_large(edges)), "links")
