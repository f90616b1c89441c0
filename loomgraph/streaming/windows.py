"""The same transformations for batch and streaming tables of events (event_id, ts, user_id, event_type, value)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def timed(events: DataFrame, late: str | None = None) -> DataFrame:
    """Times as instants; a watermark if ``late`` says how long to wait."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late) if late else rows


def _bounds(df: DataFrame) -> DataFrame:
    return df.withColumn("window_start", F.col("window.start")).withColumn("window_end", F.col("window.end")).drop("window")


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    return _bounds(events.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("greatest")))


def sliding(events: DataFrame, width: str = "1 hour", step: str = "30 minutes") -> DataFrame:
    return _bounds(events.groupBy(F.window("ts", width, step), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("greatest")))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    out = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.withColumn("session_start", F.col("session_window.start")).withColumn("session_end", F.col("session_window.end")).drop("session_window")


def deduplicated(events: DataFrame) -> DataFrame:
    """One event for each id; within the watermark in a stream."""
    return events.dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def latest_per_user(events: DataFrame) -> DataFrame:
    """Batch: each user's last event, ties by id."""
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("user_id", "event_id", "ts", "event_type", "value")


def _newest(key, batches, state):
    import pandas as pd

    best = state.get if state.exists else None
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            mine = (int(row.ts.value), int(row.event_id), row.event_type, float(row.value))
            best = mine if best is None or mine[:2] > best[:2] else best
    state.update(best)
    yield pd.DataFrame({"user_id": [key[0]], "event_id": [best[1]], "ts": [pd.Timestamp(best[0])], "event_type": [best[2]], "value": [best[3]]})


def latest_per_user_stream(events: DataFrame) -> DataFrame:
    """Streaming: the same with one small state for each user; update mode."""
    rows = events.select("user_id", "event_id", "ts", "event_type", "value")
    return rows.groupBy("user_id").applyInPandasWithState(_newest, "user_id long, event_id long, ts timestamp, event_type string, value double", "ts long, event_id long, event_type string, value double", "update", "NoTimeout")


class _Latest:
    """A user's newest event in a value with a time to live; a timer at event time drops what the watermark has passed."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "ts long, event_id long, event_type string, value double")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        before = best = tuple(self.best.get()) if self.best.exists() else None
        for pdf in rows:
            for row in pdf.itertuples(index=False):
                mine = (int(row.ts.value), int(row.event_id), row.event_type, float(row.value))
                best = mine if best is None or mine[:2] > best[:2] else best
        if best != before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
            self.best.update(best)
            self.handle.registerTimer(best[0] // 1_000_000 + self.keep_ms)
            yield pd.DataFrame({"user_id": [key[0]], "event_id": [best[1]], "ts": [pd.Timestamp(best[0])], "event_type": [best[2]], "value": [best[3]]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.best.clear()
        return iter(())

    def handleInitialState(self, key, initialState, timerValues) -> None: ...

    def close(self) -> None: ...


def latest_per_user_within(events: DataFrame, keep: timedelta) -> DataFrame:
    """Streaming, update mode: each user's newest event whenever it changes; a user silent for ``keep`` beyond the
    watermark is forgotten, so state is bounded by the users of that time. ``events`` need a watermark on ts, and the
    session a RocksDB state store."""
    from pyspark.sql.streaming import StatefulProcessor

    ms = int(keep.total_seconds() * 1000)
    processor = type("LatestWithin", (_Latest, StatefulProcessor), {})(ms)
    rows = events.select("user_id", "event_id", "ts", "event_type", "value")
    return rows.groupBy("user_id").transformWithStateInPandas(processor, "user_id long, event_id long, ts timestamp, event_type string, value double", "Update", "EventTime")


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what is there now and end; the result is a table in memory, for tests."""
    stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)


def merge_each_batch(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """Hand every micro-batch to ``merge``, which must be idempotent by batch number."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)
