"""Sharding by fixed virtual slots, with DataFrame and SQL functions only.

Records hash into a fixed number of virtual slots, bytes are summed by slot, and a versioned map assigns slots to
shards: largest slot first, each to the shard with the least bytes so far. Rebalancing edits the map and never rehashes
a record; ``with_one_more`` moves slots into the new shard only. What a shard holds is numbered without gaps: an offset
for each virtual slot, and the row's place within it, so no task sorts a whole shard. Copies of one text have hashes of
their own, so a group of copies spreads over all slots.

Defined cases: a null text has no bytes and the checksum of the empty text; a null identifier hashes by checksum and
size; repeated rows get places of their own; an empty table gives an empty result; other columns are ignored. The map
has as many rows as there are virtual slots, whatever the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged

SHARDS, SLOTS, OVERHEAD = 40, 4096, 16


def records(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """id_col, size, text_crc32 and virtual_slot of each row."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").alias(id_col), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return rows.withColumn("virtual_slot", F.pmod(F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col))).otherwise(F.xxhash64("text_crc32", "size")), F.lit(slots)).cast("int"))


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> DataFrame:
    """virtual_slot, bytes, rows for every slot, empty ones too."""
    found = rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = rows.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(found, "virtual_slot", "left").na.fill(0, ["bytes", "rows"])


def first_map(sizes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """version 1 of the map: version, virtual_slot, shard, bytes, rows."""
    one = sizes.agg(F.sort_array(F.collect_list(F.struct("bytes", "virtual_slot", "rows")), asc=False).alias("s"))
    dealt = F.expr(f"""
        aggregate(s,
          named_struct('load', transform(sequence(0, {shards - 1}), i -> named_struct('b', 0L, 'k', i)),
                       'out', cast(array() as array<struct<x:struct<bytes:bigint,virtual_slot:int,rows:bigint>,shard:int>>)),
          (a, x) -> named_struct(
            'load', array_sort(concat(slice(a.load, 2, {shards - 1}), array(named_struct('b', a.load[0].b + x.bytes, 'k', a.load[0].k)))),
            'out', concat(a.out, array(named_struct('x', x, 'shard', a.load[0].k)))),
          a -> a.out)""")
    return one.select(F.explode(dealt).alias("m")).select(F.lit(1).alias("version"), "m.x.virtual_slot", "m.shard", "m.x.bytes", "m.x.rows")


def with_one_more(slot_map: DataFrame) -> DataFrame:
    """The next version, for one more shard: each shard hands over small slots up to its bytes above the new mean."""
    every = Window.partitionBy()
    shard = Window.partitionBy("shard")
    run = shard.orderBy("bytes", "virtual_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = slot_map.withColumn("_new", F.max("shard").over(every) + 1).withColumn("_mean", F.sum("bytes").over(every) / (F.col("_new") + 1))
    moved = (F.col("bytes") > 0) & (F.sum("bytes").over(run) <= F.sum("bytes").over(shard) - F.col("_mean"))
    return sized.withColumn("shard", F.when(moved, F.col("_new")).otherwise(F.col("shard"))).withColumn("version", F.col("version") + 1).drop("_new", "_mean")


def rebalanced(slot_map: DataFrame, sizes: DataFrame) -> DataFrame:
    """The next version for changed sizes: shards above the mean hand over slots, shards below take them by deficit."""
    every, shard = Window.partitionBy(), Window.partitionBy("shard")
    now = slot_map.drop("bytes", "rows").join(sizes, "virtual_slot")
    n = F.max("shard").over(every) + 1
    run = shard.orderBy("bytes", "virtual_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    now = now.withColumn("_mean", F.sum("bytes").over(every) / n).withColumn("_own", F.sum("bytes").over(shard)).withColumn("_go", (F.col("bytes") > 0) & (F.sum("bytes").over(run) <= F.col("_own") - F.col("_mean")))
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    room = now.groupBy("shard").agg(F.first("_mean").alias("_mean"), F.first("_own").alias("_own")).withColumn("_need", F.greatest(F.lit(0.0), F.col("_mean") - F.col("_own"))).withColumn("_to", F.sum("_need").over(upto)).withColumn("_from", F.col("_to") - F.col("_need")).select(F.col("shard").alias("_taker"), "_from", "_to").filter("_to > _from")
    middle = Window.orderBy("shard", "virtual_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    going = now.filter("_go").withColumn("_at", F.sum("bytes").over(middle) - F.col("bytes") / 2)
    taken = going.join(F.broadcast(room), (F.col("_at") > F.col("_from")) & (F.col("_at") <= F.col("_to"))).select("virtual_slot", "_taker")
    return now.join(taken, "virtual_slot", "left").select((F.col("version") + 1).alias("version"), "virtual_slot", F.coalesce("_taker", "shard").alias("shard"), "bytes", "rows")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version of the map, the latest by default."""
    stored = spark.read.parquet(path)
    wanted = version if version is not None else stored.agg(F.max("version")).first()[0]
    return stored.filter(F.col("version") == wanted)


def store_map(slot_map: DataFrame, path: str) -> None:
    """Add a version to the stored ones; earlier versions stay readable."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def assigned(rows: DataFrame, slot_map: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``records`` with shard, slot (place in the shard, from 0) and map_version."""
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slot_map.select("version", "virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("_first"))
    place = Window.partitionBy("virtual_slot").orderBy(F.col(id_col), "text_crc32", "size")
    out = rows.join(F.broadcast(offsets), "virtual_slot")  # as many rows as virtual slots
    return out.withColumn("slot", F.col("_first") + F.row_number().over(place) - 1).withColumnRenamed("version", "map_version").drop("_first")


def shard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """id_col, size, text_crc32, virtual_slot, shard, map_version, slot of each row."""
    rows = staged(records(df, id_col, text_col, slots), "shard-records")
    return assigned(rows, staged(first_map(slot_sizes(rows, slots), shards), "shard-map"), id_col)
