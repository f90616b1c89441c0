"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Sources share a total by weight; a target stops at ``cap`` times its source's size and the excess is reshared by weight
until none is above, each time by sums over three classes of weight. A source first gives complete epochs; the fraction
that is left is filled by documents in order of their exponential keys -ln(u) / quality, u being a hash of identifier
and seed, so likelier documents come first without replacement.

Keys are kept as whole numbers in order of size (logarithms to 44 bits), and the prefix sum that ends at the budget is
found from the top: sizes by the leading bits of the key, then, inside the one bucket in which the budget ends, by six
bits more, until it has at most ``window`` rows. Only those, and as many that follow, are put in order, so no task ever
holds a source, however large. Where the next document doesn't fit what is left of the budget, later ones of the window
that do are taken (``extras`` at most); last, one that overshoots is, if that comes nearer to the target.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; documents of size 0 are
taken as often as there are complete epochs and count nothing; a null identifier hashes like the text's size alone;
repeated rows count as rows, and those that tie in key and identifier are taken or left together; null, negative or zero
quality counts as the least positive one; an empty table gives an empty result; other columns are ignored by ``plan``
and carried unchanged by ``mixed``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import spread, staged, word_count

WEIGHTS, SHARE, CAP, SEED, WINDOW, EXTRAS = (3.0, 1.0, 2.0), 1.5, 2.0, 20, 4096, 64
#: Bits of a key below a whole unit of its logarithm; by how many of them a first bucket is wide, and a finer one less.
_FINE, _WIDE, _STEP = 44, 38, 6


def quality(text: str, size: Column) -> Column:
    """A document's default quality weight: 1 for words of five characters on average, falling to either side."""
    mean = F.length(F.coalesce(F.col(text), F.lit(""))) / F.greatest(size, F.lit(1)) - 1
    return 1 / (1 + F.abs(mean - 5))


def _sized(df: DataFrame, id_col: str, text_col: str, source_col: str, quality_col: str | None, seed: int) -> DataFrame:
    size = word_count(f"`{text_col}`")
    weight = F.col(f"`{quality_col}`").cast("double") if quality_col else quality(f"`{text_col}`", size)
    rows = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{source_col}`").cast("string").alias("_source"), size.alias("_size"), F.when(weight > 1e-6, weight).otherwise(1e-6).alias("_weight"))
    return rows.withColumn("_key", _key(F.col("_id"), F.col("_size"), F.col("_weight"), seed)).drop("_weight")


def _key(identifier: Column, size: Column, weight: Column, seed: int) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(identifier.cast("string"), F.concat(F.lit("size "), size.cast("string")))), 12)
    return F.floor(F.log(-F.log((bits.cast("double") + 0.5) / float(1 << 52)) / weight) * float(1 << _FINE))


def _numbered(sources: DataFrame) -> DataFrame:
    """Add _place: the source's place from 0 in order of code points, null last. Ranges are sorted each on its own."""
    dealt = staged(sources.repartitionByRange(spread(sources, 1), F.asc_nulls_last("_source")).withColumn("_part", F.spark_partition_id()), "mix-sources")
    sizes = dict(dealt.groupBy("_part").count().collect())  # as many rows as partitions
    before = [sum(n for q, n in sizes.items() if q < p) for p in range(max(sizes, default=0) + 1)]
    own = Window.partitionBy("_part").orderBy(F.asc_nulls_last("_source"))
    return dealt.withColumn("_place", F.row_number().over(own) - 1 + F.element_at(F.array(*map(F.lit, before)), F.col("_part") + 1)).drop("_part")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Add _target to a table of _source and _total, one row for each source."""
    kind = (F.col("_place") % len(weights)).cast("int")
    rows = _numbered(sources).withColumn("_kind", kind).withColumn("_w", F.element_at(F.array(*(F.lit(float(x)) for x in weights)), kind + 1))
    full, level, n = F.lit(False), 0.0, -1
    while True:
        # Whole numbers for each class of weight, so the order of rows changes nothing.
        sums = rows.groupBy("_kind").agg(F.sum("_total").alias("all"), F.sum(F.when(full, F.col("_total")).otherwise(0)).alias("full"), F.count(F.when(full, 1)).alias("n"), F.count(F.when(~full, 1)).alias("open")).collect()  # a row for each weight
        now, open_ = sum(r["n"] for r in sums), sum(weights[r["_kind"]] * r["open"] for r in sums)
        if now == n or not open_:
            return rows.select("_source", "_total", F.when(full, F.col("_total") * cap).otherwise(F.col("_w") * level).alias("_target"))
        n, level = now, (share * sum(r["all"] for r in sums) - cap * sum(r["full"] for r in sums)) / open_
        full = F.col("_total") * cap <= F.col("_w") * level


def _located(sums: DataFrame, shift: int, window: int) -> DataFrame:
    """Of sums by bucket (_source, _bucket, _words, _rows, _start, _budget): the one of each source in which its budget
    ends, the last one that a window from there holds, and what comes before."""
    run = Window.partitionBy("_source").orderBy("_bucket")
    upto = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = sums.withColumn("_before", F.col("_start") + F.sum("_words").over(upto) - F.col("_words")).withColumn("_seen", F.sum("_rows").over(upto))
    hit = (F.col("_before") <= F.col("_budget")) & (F.col("_budget") < F.col("_before") + F.col("_words"))
    whole = Window.partitionBy("_source")
    ends = ends.withColumn("_from", F.max(F.when(hit, F.struct("_bucket", "_before", "_rows", "_seen"))).over(whole)).filter((F.col("_bucket") == F.col("_from._bucket")) | ((F.col("_bucket") > F.col("_from._bucket")) & (F.col("_seen") - F.col("_from._seen") + F.col("_from._rows") <= window)))
    found = ends.groupBy("_source").agg(F.first("_from").alias("f"), F.max("_bucket").alias("_last"), F.first("_budget").alias("_budget"))
    return found.select(F.col("_source").alias("_es"), F.col("f._bucket").alias("_first"), "_last", F.col("f._before").alias("_before"), F.col("f._rows").alias("_n"), "_budget", F.lit(shift).alias("_shift"))


def _by_bucket(rows: DataFrame, shift: int, start: Column, budget: Column) -> DataFrame:
    return rows.groupBy("_source", F.shiftright("_key", shift).alias("_bucket")).agg(F.sum("_size").alias("_words"), F.count("*").alias("_rows"), F.first(start).alias("_start"), F.first(budget).alias("_budget"))


def _filled(window_rows: DataFrame, extras: int) -> DataFrame:
    """For each source, from its window: the last key and identifier of the prefix that fits, and what is taken beyond."""
    # Rows that tie stand together, so what is taken doesn't hang on their order.
    tie = window_rows.groupBy("_source", "_key", "_id").agg(F.sum("_size").alias("_size"), F.first(F.col("_budget") - F.col("_before")).alias("_left"))
    all_ = tie.groupBy("_source").agg(F.sort_array(F.collect_list(F.struct("_key", "_id", "_size"))).alias("_docs"), F.first("_left").alias("_left"))
    kind = window_rows.schema["_id"].dataType.simpleString()
    none, many = f"cast(null as struct<_key:bigint,_id:{kind}>)", f"cast(array() as array<struct<_key:bigint,_id:{kind}>>)"
    start = F.struct(F.col("_left").alias("left"), F.lit(True).alias("whole"), F.expr(none).alias("last"), F.expr(many).alias("more"))

    def step(acc, d):
        own, fits = F.struct(d["_key"].alias("_key"), d["_id"].alias("_id")), d["_size"] <= acc["left"]
        later = fits & ~acc["whole"] & (F.size(acc["more"]) < extras)
        takes = (fits & acc["whole"]) | later
        return F.struct(F.when(takes, acc["left"] - d["_size"]).otherwise(acc["left"]).alias("left"), (acc["whole"] & fits).alias("whole"), F.when(acc["whole"] & fits, own).otherwise(acc["last"]).alias("last"), F.when(later, F.concat(acc["more"], F.array(own))).otherwise(acc["more"]).alias("more"))

    done = all_.withColumn("_f", F.aggregate("_docs", start, step))
    beyond = lambda d: F.col("_f.last").isNull() | (F.struct(d["_key"], d["_id"]) > F.struct(F.col("_f.last._key"), F.col("_f.last._id")))
    left = F.filter("_docs", lambda d: beyond(d) & (d["_size"] > 0) & ~F.exists(F.col("_f.more"), lambda e: (e["_key"] == d["_key"]) & e["_id"].eqNullSafe(d["_id"])))
    least = F.array_min(F.transform(left, lambda d: F.struct(d["_size"].alias("_size"), d["_key"].alias("_key"), d["_id"].alias("_id"))))
    done = done.withColumn("_least", least)
    over = F.col("_least._size") - F.col("_f.left") < F.col("_f.left")
    more = F.when(over, F.concat("_f.more", F.array(F.struct(F.col("_least._key").alias("_key"), F.col("_least._id").alias("_id"))))).otherwise(F.col("_f.more"))
    return done.select(F.col("_source").alias("_ls"), F.col("_f.last._key").alias("_cut_key"), F.col("_f.last._id").alias("_cut_id"), more.alias("_more"))


def _cutoffs(rows: DataFrame, weights: Sequence[float], share: float, cap: float, window: int, extras: int) -> DataFrame:
    """For each source: _total, _target, _epochs, and where its fraction ends: the bucket (its leading bits and how many
    others; null: there is no fraction), the last (_cut_key, _cut_id) taken from there on in order (null: none), and
    _more, those taken after it."""
    zero = F.lit(0).cast("long")
    sums = staged(_by_bucket(rows, _WIDE, zero, zero).drop("_start", "_budget"), "mix-sums")
    goals = targets(sums.groupBy("_source").agg(F.sum("_words").alias("_total")), weights, share, cap)
    goals = goals.withColumn("_epochs", F.when(F.col("_total") > 0, F.floor(F.col("_target") / F.col("_total") + 1e-12)).otherwise(0)).withColumn("_budget", F.greatest(F.lit(0.0), F.col("_target") - F.col("_epochs") * F.col("_total")))
    goals = staged(goals, "mix-goals")
    budgets = goals.select(F.col("_source").alias("_s"), "_budget").filter("_budget > 0")
    sums = sums.withColumn("_start", zero).join(budgets, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    shift, settled = _WIDE, []
    ends = staged(_located(sums, shift, window), "mix-ends")
    while True:
        settled.append(ends.filter((F.col("_n") <= window) | F.lit(shift == 0)))
        wide = ends.filter((F.col("_n") > window) & F.lit(shift > 0))
        if not wide.limit(1).count():
            break
        inside = rows.join(wide, F.col("_source").eqNullSafe(F.col("_es")) & (F.shiftright("_key", shift) == F.col("_first")))
        shift = max(0, shift - _STEP)
        ends = staged(_located(_by_bucket(inside, shift, F.col("_before"), F.col("_budget")), shift, window), "mix-ends")
    ends = reduce(DataFrame.unionByName, settled)
    bucket = F.expr("shiftright(_key, _shift)")
    inside = rows.join(ends, F.col("_source").eqNullSafe(F.col("_es")) & (bucket >= F.col("_first")) & (bucket <= F.col("_last")))
    at = ends.select("_es", F.col("_first").alias("_cut_bucket"), "_shift")
    out = goals.join(at, F.col("_source").eqNullSafe(F.col("_es")), "left").join(_filled(inside, extras), F.col("_source").eqNullSafe(F.col("_ls")), "left")
    return out.select("_source", "_total", "_target", "_epochs", "_cut_key", "_cut_id", "_cut_bucket", "_shift", "_more")


def _copies(key: Column, identifier: Column) -> Column:
    """How often a row is taken, given the columns of its source's cutoff."""
    bucket = F.call_function("shiftright", key, F.col("_shift"))
    upto = (key < F.col("_cut_key")) | ((key == F.col("_cut_key")) & (F.coalesce(identifier < F.col("_cut_id"), identifier.isNull()) | identifier.eqNullSafe(F.col("_cut_id"))))
    later = F.exists("_more", lambda e: (e["_key"] == key) & e["_id"].eqNullSafe(identifier))
    takes = (bucket < F.col("_cut_bucket")) | F.coalesce(upto, F.lit(False)) | F.coalesce(later, F.lit(False))
    return (F.col("_epochs") + F.when(F.col("_cut_bucket").isNotNull() & takes, 1).otherwise(0)).cast("long")


def plan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality_col: str | None = None, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED, window: int = WINDOW, extras: int = EXTRAS) -> DataFrame:
    """One row per input row: id_col, source_col, size, source_size, target, copies, taken."""
    rows = staged(_sized(df, id_col, text_col, source_col, quality_col, seed), "mix-sizes")
    cut = staged(_cutoffs(rows, weights, share, cap, window, extras), "mix-cutoffs").withColumnRenamed("_source", "_cs")
    out = rows.join(cut, F.col("_source").eqNullSafe(F.col("_cs"))).withColumn("copies", _copies(F.col("_key"), F.col("_id")))
    return out.select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target"), "copies", (F.col("copies") * F.col("_size")).alias("taken"))


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality_col: str | None = None, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED, window: int = WINDOW, extras: int = EXTRAS) -> DataFrame:
    """The mix itself: each row as often as it is taken, with all columns of the input."""
    rows = staged(_sized(df, id_col, text_col, source_col, quality_col, seed), "mix-sizes")
    cut = staged(_cutoffs(rows, weights, share, cap, window, extras), "mix-cutoffs").withColumnRenamed("_source", "_cs")
    size = word_count(f"`{text_col}`")
    weight = F.col(f"`{quality_col}`").cast("double") if quality_col else quality(f"`{text_col}`", size)
    key = _key(F.col(f"`{id_col}`"), size, F.when(weight > 1e-6, weight).otherwise(1e-6), seed)
    columns = [F.col(f"__row.`{c}`") for c in df.columns]
    packed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__row"), F.col(f"`{source_col}`").cast("string").alias("_source"), key.alias("_key"), F.col(f"`{id_col}`").alias("_id"))
    taken = packed.join(cut, F.col("_source").eqNullSafe(F.col("_cs"))).withColumn("_n", _copies(F.col("_key"), F.col("_id"))).filter("_n > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).select(*columns)
