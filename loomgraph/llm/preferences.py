"""Preference formatting of chat pairs, with DataFrame and SQL functions only.

The longest common turn prefix of a chosen and a rejected conversation is rendered once as the prompt; what follows is
rendered as the two completions, each with the character spans that train (contents and end marks of assistant turns),
everything else being masked. Turns are compared by role and text.

Defined cases: turns with a null pair, side or other side names are no turns of a pair and are left out; turns are
ordered by number (null first), then role and text, and repeated turns stay; a null role renders as ``user``, a null
text as nothing; a side without turns gives a null completion and an empty prompt; equal conversations are all prompt
with two empty completions; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))), "")


def _spans(turns: Column) -> Column:
    """[start, end) character spans of the assistant turns' contents and end marks, as "start-end" joined by commas."""
    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, t):
        start = acc["at"] + F.length(t["role"]) + len(START) + 1
        stop = start + F.length(t["text"]) + len(END)
        span = F.concat(start.cast("string"), F.lit("-"), stop.cast("string"))
        return F.struct((stop + 1).cast("long").alias("at"), F.when(t["role"] == "assistant", F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    return F.array_join(F.aggregate(turns, first, step, lambda acc: acc["out"]), ",")


def format_pairs(turns: DataFrame, pair_col: str = "pair_id", side_col: str = "side", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """One row per pair: pair_col, n_common, prompt, chosen, rejected, chosen_spans, rejected_spans."""
    rows = turns.select(F.col(f"`{pair_col}`").alias("_p"), F.col(f"`{side_col}`").alias("_s"), F.struct(F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`"), F.lit("user")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).alias("_t")).filter(F.col("_p").isNotNull() & F.col("_s").isin(chosen, rejected))

    def side(name):
        ordered = F.sort_array(F.collect_list(F.when(F.col("_s") == name, F.col("_t"))))
        return F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))

    pairs = rows.groupBy("_p").agg(side(chosen).alias("c"), side(rejected).alias("r"))
    shorter = F.least(F.size("c"), F.size("r"))
    differs = F.filter(F.sequence(F.lit(1), shorter), lambda i: F.element_at("c", i) != F.element_at("r", i))
    pairs = pairs.withColumn("n_common", F.when(shorter == 0, 0).otherwise(F.coalesce(F.array_min(differs) - 1, shorter)))
    rest = {k: F.slice(k, F.col("n_common") + 1, F.greatest(F.size(k), F.lit(1))) for k in ("c", "r")}
    there = {k: F.size(k) > 0 for k in ("c", "r")}
    return pairs.select(
        F.col("_p").alias(pair_col), F.col("n_common").cast("long").alias("n_common"), _rendered(F.slice("c", 1, F.col("n_common"))).alias("prompt"),
        F.when(there["c"], _rendered(rest["c"])).alias("chosen"), F.when(there["r"], _rendered(rest["r"])).alias("rejected"),
        F.when(there["c"], _spans(rest["c"])).alias("chosen_spans"), F.when(there["r"], _spans(rest["r"])).alias("rejected_spans"),
    )
