"""What commands print and report: counts, percentages, listings, clipped annotations, effective verdicts, identities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import one_decimal

MARKER = "\n[truncated]"


def top_types(samples: DataFrame, most: int = 15) -> DataFrame:
    """The receiver types that enrichment found most often: count descending, then name."""
    return samples.filter("receiver_type is not null").groupBy("receiver_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "receiver_type").limit(most)


def percent(part: Column, whole: Column | None = None) -> Column:
    """A share (or a part of a whole) as a percentage with one decimal; null where it has no value."""
    return F.concat(one_decimal(part * 100.0 if whole is None else part * 100.0 / F.nullif(whole, F.lit(0))), F.lit("%"))


def iso(moment: Column) -> Column:
    """A moment in ISO 8601, UTC, whole seconds. The session's time zone is taken off first."""
    return F.concat(F.date_format(F.to_utc_timestamp(moment, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


def node_line() -> Column:
    """One line for a node with uid, name, subtype, file and line_start."""
    place = F.when(F.col("file").isNotNull(), F.concat(F.lit(" "), "file", F.lit(":"), F.col("line_start").cast("string"))).otherwise("")
    return F.concat("uid", F.lit(" "), "name", F.lit(" ("), "subtype", F.lit(")"), place)


def listing(df: DataFrame, columns: Sequence[str], widths: Sequence[int]) -> DataFrame:
    """Rows as text lines of fixed columns, cut or filled to their width."""
    return df.select(F.rtrim(F.concat_ws("  ", *(F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("-")), w, " ") for c, w in zip(columns, widths, strict=True)))).alias("line"))


def effective(judged: DataFrame, waived: DataFrame, verdict: str) -> DataFrame:
    """effective_verdict: WAIVED wherever a waiver stands, else what was computed. The gate lets a PASS stand; this
    older rule doesn't."""
    marked = waived.select("req_id").distinct().withColumn("_waived", F.lit(True))
    return judged.join(marked, "req_id", "left").withColumn("effective_verdict", F.when(F.col("_waived"), "WAIVED").otherwise(F.col(verdict))).drop("_waived")


def clipped(text: Column, most: int = 8192) -> Column:
    """Struct of text and truncated: at most so many bytes, ended at a whole character, then a marker."""
    head = F.make_valid_utf8(F.substring(F.encode(text, "UTF-8"), 1, most).cast("string"))
    head = F.regexp_replace(head, "\ufffd+$", "")
    cut = F.octet_length(text) > most
    return F.struct(F.when(cut, F.concat(head, F.lit(MARKER))).otherwise(text).alias("text"), cut.alias("truncated"))


def canonical_json(columns: Sequence[str]) -> Column:
    """A JSON object of columns in order of name, nulls left out: equal content gives equal text."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(columns))))


def surface_identity(columns: Sequence[str]) -> Column:
    """The key of a surface: the hash of its canonical JSON."""
    return F.substring(F.sha2(canonical_json(columns), 256), 1, 16)


def stripped_comment(raw: Column) -> Column:
    """The text of a documentation comment without its frame of stars and slashes."""
    inner = F.regexp_replace(F.regexp_replace(raw, r"^\s*/\*\*?", ""), r"\*/\s*$", "")
    return F.regexp_replace(F.regexp_replace(inner, r"(?m)^[ \t]*\*[ \t]?", ""), r"^\s+|\s+$", "")


def changed_paths(lines: DataFrame) -> DataFrame:
    """path, change of ``git diff --name-status`` lines (column value): renames and copies give their new path."""
    parts = F.split("value", "\t")
    change = F.element_at(F.create_map(*(F.lit(x) for kv in {"A": "added", "M": "modified", "D": "deleted", "R": "renamed", "C": "copied", "T": "modified"}.items() for x in kv)), F.substring("value", 1, 1))
    return lines.filter(F.size(parts) >= 2).select(F.element_at(parts, -1).alias("path"), change.alias("change")).distinct()


def front_matter(documents: DataFrame) -> DataFrame:
    """path, key, value of the scalar entries in the front matter of documents (path, text)."""
    block = F.regexp_extract("text", r"(?s)^---\r?\n(.*?)\r?\n---", 1)
    lines = documents.select("path", F.explode(F.split(block, r"\r?\n")).alias("_l"))
    return lines.select("path", F.regexp_extract("_l", r"^([A-Za-z_][A-Za-z0-9_-]*)\s*:\s*(.+)$", 1).alias("key"), F.trim(F.regexp_replace(F.regexp_extract("_l", r"^([A-Za-z_][A-Za-z0-9_-]*)\s*:\s*(.+)$", 2), "^[\"']|[\"']$", "")).alias("value")).filter("key <> ''")
