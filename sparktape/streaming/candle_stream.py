"""Candles from a live tape with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparktape.functions.timeops import iso_day
from sparktape.operators.candles import ohlcv_columns


def with_event_time(trades: DataFrame, delay: str) -> DataFrame:
    """Add ``event_time`` and a watermark on it; trades later than ``delay`` are dropped, never a second candle."""
    return trades.withColumn("event_time", F.timestamp_millis("t")).withWatermark("event_time", delay)


def dedupe_stream(trades: DataFrame) -> DataFrame:
    """First arrival per (symbol, id) within the watermark; state is bounded by the delay."""
    return trades.dropDuplicatesWithinWatermark(["symbol", "a"])


def candle_stream(trades: DataFrame, bucket: str = "1 second", delay: str = "10 seconds", dedupe: bool = True) -> DataFrame:
    """Streaming ``symbol, epoch_ms, open .. trade_count``; a candle is final once the watermark passes it."""
    rows = with_event_time(trades, delay)
    if dedupe:
        rows = dedupe_stream(rows)
    grouped = rows.groupBy("symbol", F.window("event_time", bucket).alias("w")).agg(*ohlcv_columns(["t", "a"]))
    return grouped.select(
        "symbol",
        F.unix_millis("w.start").alias("epoch_ms"),
        "open",
        "high",
        "low",
        "close",
        "volume",
        "trade_count",
    )


def write_candle_stream(
    candles: DataFrame, path: str, checkpoint: str, backfill: bool = False, every: str = "10 seconds"
) -> StreamingQuery:
    """Append final candles to Parquet by symbol and day; restarts resume from ``checkpoint``."""
    writer = (
        candles.withColumn("day", iso_day(F.col("epoch_ms")))
        .writeStream.outputMode("append")
        .format("parquet")
        .partitionBy("symbol", "day")
        .option("checkpointLocation", checkpoint)
    )
    writer = writer.trigger(availableNow=True) if backfill else writer.trigger(processingTime=every)
    return writer.start(path)
