"""Hourly counts, as a batch and as a stream with the same numbers, and outcomes applied to a state table by micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def hourly(events: DataFrame, late: str | None = None) -> DataFrame:
    """(clicked_hour, user_id, click_count) of events (ts, user_id). ``late``: how far a stream's events may lag; windows close after it."""
    timed = events.select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    if late:
        timed = timed.withWatermark("ts", late)
    counted = timed.groupBy(F.window("ts", "1 hour"), "user_id").agg(F.count(F.lit(1)).alias("click_count"))
    return counted.select(F.col("window.start").alias("clicked_hour"), "user_id", "click_count")


def stream_into(source: DataFrame, path: str, checkpoint: str, late: str = "2 hours") -> StreamingQuery:
    """Hourly counts of a stream, appended to Parquet as their windows close; restartable from ``checkpoint``."""
    return (
        hourly(source, late).writeStream.outputMode("append").format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def apply_stream(outcomes: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """``step`` on every micro-batch; a batch that is run again has the same id, so a step keyed by it is exactly once."""
    return outcomes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
