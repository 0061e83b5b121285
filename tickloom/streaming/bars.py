"""Bars from a tick stream, and duplicate bars within the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom.sources.bars import tick_order


def stream_bars(ticks: DataFrame, width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """OHLCV bars of a tick stream ``(symbol, ts, seq, price, spread)``.

    A bar is emitted once its window lies ``lateness`` behind the newest tick; the state holds open
    bars only. ``ts`` may be zone-less: watermarks need an instant, so it is read as UTC.
    """
    timed = ticks.withColumn("ts", F.col("ts").cast("timestamp"))
    rank = tick_order()
    bars = timed.withWatermark("ts", lateness).groupBy("symbol", F.window("ts", width)).agg(
        F.min_by("price", rank).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", rank).alias("close"),
        F.count(F.lit(1)).alias("tick_volume"),
        F.max_by("spread", rank).cast("int").alias("spread"),
    )
    return bars.select("symbol", F.col("window.start").cast("timestamp_ntz").alias("time"),
                       "open", "high", "low", "close", "tick_volume", "spread")


def first_arrivals(bars: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Keep the first bar of every ``(symbol, time)`` seen within the watermark."""
    timed = bars.withColumn("_at", F.col("time").cast("timestamp"))
    return timed.withWatermark("_at", lateness).dropDuplicatesWithinWatermark(
        ["symbol", "time"]).drop("_at")


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Process what has arrived, append it to ``path``, stop."""
    return stream.writeStream.format("parquet").outputMode("append").option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
