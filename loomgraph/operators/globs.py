"""Many path patterns against many paths, by equality joins on what is literal in a pattern.

``*`` stands for any characters of a segment, ``**`` for any characters; all else is literal. A pattern is found by one
anchor: the directories before its first wildcard or its longest literal segment, whichever is longer, else what follows its last wildcard
from a dot on, else nothing. A path offers each of its directories, segments and dotted ends. Patterns and paths that
agree in an anchor are then compared by regular expression, so a pattern meets only paths that hold its literal part;
no expression in the plan grows with the number of patterns.

Defined cases: a null pattern or path matches nothing; an empty pattern matches an empty path; repeated patterns and
paths count once; patterns are told apart by their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pattern_regex(pattern: Column) -> Column:
    """The pattern as a regular expression over whole paths."""
    literal = F.regexp_replace(pattern, r"([.\\+^$|()\[\]{}?])", r"\\$1")
    return F.concat(F.lit(r"(?s)\A"), F.replace(F.replace(F.replace(literal, F.lit("**"), F.lit("\x01")), F.lit("*"), F.lit("[^/]*")), F.lit("\x01"), F.lit(".*")), F.lit(r"\z"))


def _anchor(pattern: Column) -> Column:
    head = F.regexp_extract(pattern, r"(?s)\A([^*]*)/[^/*]*\*", 1)
    # Next to ** a segment may go on in the path, so only segments between slashes or at an end count.
    inner = F.filter(F.split(F.regexp_replace(pattern, r"[^/]*\*[^/]*", "\x01"), "/"), lambda s: ~s.contains("\x01") & (s != ""))
    longest = F.array_max(F.transform(inner, lambda s: F.struct(F.length(s).alias("n"), s.alias("s"))))["s"]
    end = F.regexp_extract(pattern, r"(?s)\*[^*/.]*(\.[^*/.]+)\z", 1)
    return F.when(~pattern.contains("*"), F.concat(F.lit("="), pattern)).when((head != "") & (F.length(head) >= F.coalesce(F.length(longest), F.lit(0))), F.concat(F.lit("d"), head)).when(longest.isNotNull(), F.concat(F.lit("s"), longest)).when(end != "", F.concat(F.lit("e"), end)).otherwise(F.lit("*"))


def _offers(path: Column) -> Column:
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.concat(F.lit("d"), F.array_join(F.slice(parts, 1, k), "/")))
    own = F.transform(parts, lambda s: F.concat(F.lit("s"), s))
    end = F.regexp_extract(path, r"(?s)(\.[^/.]+)\z", 1)
    return F.array_distinct(F.concat(F.array(F.lit("*"), F.concat(F.lit("="), path), F.concat(F.lit("e"), end)), above, own))


def matches(paths: DataFrame, patterns: DataFrame) -> DataFrame:
    """path, pattern for each pair that matches."""
    known = patterns.filter("pattern is not null").select("pattern").distinct().withColumn("_anchor", _anchor(F.col("pattern"))).withColumn("_regex", pattern_regex(F.col("pattern")))
    offered = paths.filter("path is not null").select("path").distinct().withColumn("_anchor", F.explode(_offers(F.col("path"))))
    return offered.join(known, "_anchor").filter(F.expr("path rlike _regex")).select("path", "pattern")


def routed(paths: DataFrame, includes: DataFrame, excludes: DataFrame) -> DataFrame:
    """path, included, excluded: without any include pattern all are included; an exclude pattern may also be a file's name."""
    named = paths.select("path", F.substring_index("path", "/", -1).alias("pattern"))
    by_name = named.join(excludes.select("pattern").distinct(), "pattern", "left_semi").select("path")
    out = matches(paths, excludes).select("path").union(by_name).distinct().withColumn("_out", F.lit(True))
    into = matches(paths, includes).select("path").distinct().withColumn("_in", F.lit(True))
    none = includes.filter("pattern is not null").agg((F.count("*") == 0).alias("_none"))  # one row
    rows = paths.select("path").distinct().join(into, "path", "left").join(out, "path", "left").crossJoin(F.broadcast(none))
    return rows.select("path", (F.col("_none") | F.coalesce("_in", F.lit(False))).alias("included"), F.coalesce("_out", F.lit(False)).alias("excluded"))
