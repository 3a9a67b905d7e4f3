"""Coordination over a stream: tumbling or sliding windows with a watermark. An extension; batch answers come from the relation of the same name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def coordinated_bursts(events: DataFrame, length: str = "2 hours", slide: str | None = None, late: str = "1 hour", least: int = 3) -> DataFrame:
    """Windows in which at least ``least`` events happen: their start, number, distinct senders (approximately, so that
    the state of a window has a fixed size) and sum. ``events``: (ts, user_id, value), a stream or a table."""
    rows = events.select(F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    rows = rows.withWatermark("ts", late)
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    found = rows.groupBy(window).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("user_id").alias("senders"), F.sum("value").alias("total"))
    return found.where(F.col("n") >= least).select(F.col("window.start").alias("window_start"), "n", "senders", "total")


def start(events: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Appends finished windows as Parquet."""
    return coordinated_bursts(events, **options).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
