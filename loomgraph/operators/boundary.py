"""Matching of what one process provides with what another consumes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import cli_key, http_confidence, http_key, http_path


#: A key that many share has the product of its sides; consumers are dealt over as many parts of it, providers stand in each.
SPREAD = 32


def _spread(providers: DataFrame) -> DataFrame:
    return providers.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))


def match_http(providers: DataFrame, consumers: DataFrame) -> DataFrame:
    """provider, consumer, basis, confidence. ``providers``: uid, method, path; ``consumers``: the same and confidence.

    Equal method and path match by address. A consumer of unknown method without such a match matches by path alone.
    """
    p = providers.select(F.col("uid").alias("provider"), http_key(F.col("method"), F.col("path")).alias("_key"), http_path(F.col("path")).alias("_path"))
    c = consumers.select(F.col("uid").alias("consumer"), "method", http_confidence(F.col("confidence"), F.col("path")).alias("_sure"), http_key(F.col("method"), F.col("path")).alias("_key"), http_path(F.col("path")).alias("_path"), F.pmod(F.xxhash64("uid"), F.lit(SPREAD)).cast("int").alias("_part"))
    exact = c.join(_spread(p.select("provider", "_key")), ["_key", "_part"]).select("provider", "consumer", F.lit("address_match").alias("basis"), F.col("_sure").alias("confidence"))
    rest = c.filter(F.coalesce(F.col("method"), F.lit("*")) == "*").join(p.select("_key").distinct(), "_key", "left_anti")
    loose = rest.join(_spread(p.select("provider", "_path")), ["_path", "_part"]).select("provider", "consumer", F.lit("heuristic").alias("basis"), (F.col("_sure") * 0.7).alias("confidence"))
    return exact.unionByName(loose)


def match_cli(providers: DataFrame, consumers: DataFrame) -> DataFrame:
    """provider, consumer, basis, confidence of commands; beyond equal ones, those equal without the first of 3 or more words."""
    p = providers.select(F.col("uid").alias("provider"), cli_key(F.col("address")).alias("_key"))
    c = consumers.select(F.col("uid").alias("consumer"), "confidence", cli_key(F.col("address")).alias("_key"))
    exact = c.join(p, "_key").select("provider", "consumer", F.lit("address_match").alias("basis"), (F.col("confidence") * 0.9).alias("confidence"))
    words = F.split("_key", r"\s+")
    rest = c.join(p.select("_key").distinct(), "_key", "left_anti").filter(F.size(words) >= 3).withColumn("_key", F.array_join(F.slice(words, 2, F.size(words)), " "))
    return exact.unionByName(rest.join(p, "_key").select("provider", "consumer", F.lit("heuristic").alias("basis"), (F.col("confidence") * 0.75).alias("confidence")))


def _keyed(facts: DataFrame) -> DataFrame:
    return facts.withColumn("_key", http_key(F.col("method"), F.col("path"))).withColumn("_path", http_path(F.col("path"))).withColumn("_any", F.coalesce("method", F.lit("*")) == "*")


def linked(providers: DataFrame, consumers: DataFrame, side: str) -> DataFrame:
    """The facts of one side (``provider`` or ``consumer``) that ``match_http`` gives any link, by keys alone: links aren't
    made, as a key that many share has the product of its sides."""
    p, c = _keyed(providers), _keyed(consumers)
    keys = p.select("_key").distinct()
    rest = c.filter("_any").join(keys, "_key", "left_anti")
    if side == "provider":
        exact = p.join(c.select("_key").distinct(), "_key", "left_semi").select("uid")
        return _chosen(providers, exact.union(p.join(rest.select("_path").distinct(), "_path", "left_semi").select("uid")))
    exact = c.join(keys, "_key", "left_semi").select("uid")
    return _chosen(consumers, exact.union(rest.join(p.select("_path").distinct(), "_path", "left_semi").select("uid")))


def _chosen(facts: DataFrame, chosen: DataFrame) -> DataFrame:
    return facts.join(chosen.select("uid").distinct(), "uid", "left_semi")


def unlinked(providers: DataFrame, consumers: DataFrame, side: str) -> DataFrame:
    """``unmatched`` of one side by all links of ``match_http``, without making them."""
    facts = providers if side == "provider" else consumers
    return unmatched(facts, linked(providers, consumers, side).select(F.col("uid").alias(side)), side)


def unmatched(facts: DataFrame, links: DataFrame, side: str) -> DataFrame:
    """Facts without a link whose operation, file and line are those of a linked fact, whichever its uid."""
    linked_ = facts.join(links.select(F.col(side).alias("uid")).distinct(), "uid", "left_semi").select("operation", "file", "line").distinct()
    return facts.join(linked_, ["operation", "file", "line"], "left_anti")


def summary(providers: DataFrame, consumers: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """side, kind, count: facts by method and links by basis. Without ``links`` those of ``match_http`` are counted by
    key, as products, and not made."""
    side = lambda df, name, column: df.groupBy(F.coalesce(column, F.lit("*")).alias("kind")).agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "kind", "n")
    both = side(providers, "provider", F.col("method")).unionByName(side(consumers, "consumer", F.col("method")))
    if links is not None:
        return both.unionByName(side(links, "link", F.col("basis")))
    p, c = _keyed(providers), _keyed(consumers)
    per = lambda df, by, n: df.groupBy(by).agg(F.count("*").alias(n))
    keys = per(p, "_key", "_p")
    exact = per(c, "_key", "_c").join(keys, "_key").select(F.lit("address_match").alias("kind"), (F.col("_p") * F.col("_c")).alias("n"))
    loose = per(c.filter("_any").join(keys, "_key", "left_anti"), "_path", "_c").join(per(p, "_path", "_p"), "_path").select(F.lit("heuristic").alias("kind"), (F.col("_p") * F.col("_c")).alias("n"))
    return both.unionByName(exact.union(loose).groupBy("kind").agg(F.sum("n").alias("n")).select(F.lit("link").alias("side"), "kind", "n"))
