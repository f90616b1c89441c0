"""Streams give the rows of their batch equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from helpers import rows
from loomgraph.streaming import windows


def _source(spark, tmp_path):
    data = [(i, f"2024-01-01 {i % 5:02d}:{i % 60:02d}:00", i % 4, "ab"[i % 2], float(i)) for i in range(200)]
    df = spark.createDataFrame(data, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.union(df.limit(20)).repartition(3).write.parquet(str(tmp_path / "events"))
    return spark.read.parquet(str(tmp_path / "events")), windows.read_events(spark, str(tmp_path / "events"), df.schema)


def test_tumbling_and_sliding(spark, tmp_path):
    batch, stream = _source(spark, tmp_path)
    for name, f in (("tumbling", windows.tumbling), ("sliding", windows.sliding)):
        got = windows.run_available(f(windows.timed(stream, "1 day")), f"s_{name}", str(tmp_path / name), "complete")
        assert rows(got.select(sorted(got.columns))) == rows(f(windows.timed(batch)).select(sorted(got.columns)))


def test_deduplication(spark, tmp_path):
    batch, stream = _source(spark, tmp_path)
    got = windows.run_available(windows.deduplicated(windows.timed(stream, "1 day")), "s_dedup", str(tmp_path / "d"))
    assert got.count() == 200 == windows.deduplicated(windows.timed(batch)).count()


def test_latest_state(spark, tmp_path):
    batch, stream = _source(spark, tmp_path)
    got = windows.run_available(windows.latest_per_user_stream(windows.timed(stream)), "s_latest", str(tmp_path / "l"), "update")
    assert rows(got.select("user_id", "event_id")) == rows(windows.latest_per_user(windows.timed(batch)).select("user_id", "event_id"))


def test_latest_state_is_bounded(spark, tmp_path):
    """Users come and go over many days; state holds those of the last hours, results are the newest events."""
    from datetime import timedelta

    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    for day in range(4):
        data = [(day * 100 + i, f"2024-01-{day + 1:02d} 0{i % 5}:00:00", day * 10 + i % 10, "ab"[i % 2], float(i)) for i in range(40)]
        df = spark.createDataFrame(data, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        latest = windows.latest_per_user_within(windows.timed(stream, "1 hour"), timedelta(hours=6))
        query = latest.writeStream.format("memory").queryName("s_within").outputMode("update").option("checkpointLocation", str(tmp_path / "w")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    got = windows.latest_per_user(spark.table("s_within"))
    batch = windows.latest_per_user(spark.read.parquet(str(tmp_path / "events")))
    assert rows(got.select("user_id", "event_id")) == rows(batch.select("user_id", "event_id")) and got.count() == 40
    assert len(states) >= 4 and max(states) < 80
