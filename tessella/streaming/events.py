"""Event streams: windowed totals with late data, sessions, and commits that survive a replay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def timed(events: DataFrame) -> DataFrame:
    """ts as a point in time: watermarks don't take clock readings without a zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event_id once, as long as its copies come within the watermark."""
    return timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def totals(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and the sum of their values for each window and type; works on tables and streams."""
    events = timed(events)
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    grouped = events.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, session_start, session_end, n."""
    events = timed(events)
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    grouped = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def write_batches(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Every micro-batch in a folder of its own number, overwritten if it is replayed: each is there once."""

    def put(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
