"""Aggregate trades to candles.

Trades carry ``symbol, a, t, p, q`` (id, epoch ms, price, quantity).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktape.functions.timeops import floor_to
from sparktape.lineage import saved
from sparktape.operators.scans import join_on


def _rank(order: list[str]) -> Column:
    """One sortable number for one or two long columns, which must not be NULL.

    A fixed-width number keeps the roll-up a hash aggregate; ordering by a struct would make it sort all trades.
    """
    if len(order) == 1:
        return F.col(order[0])
    first, second = (F.col(c).cast("decimal(19,0)") for c in order)
    # More than the span of a long, so the second column never reaches into the first.
    return first * F.expr("20000000000000000000BD") + second


def ohlcv_columns(order: list[str]) -> list[Column]:
    """Open, high, low, close, volume and count; open and close follow ``order``."""
    rank = _rank(order)
    return [
        F.round(F.min_by("p", rank), 8).alias("open"),
        F.round(F.max("p"), 8).alias("high"),
        F.round(F.min("p"), 8).alias("low"),
        F.round(F.max_by("p", rank), 8).alias("close"),
        F.round(F.sum("q"), 8).alias("volume"),
        F.count(F.lit(1)).alias("trade_count"),
    ]


def ohlcv(trades: DataFrame, bucket_ms: int = 1000, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """One candle per key and time bucket that has trades, whatever the input order."""
    return (
        trades.withColumn("epoch_ms", floor_to(F.col("t"), bucket_ms))
        .groupBy(*keys, "epoch_ms")
        .agg(*ohlcv_columns(["t", "a"]))
    )


def ohlcv_runs(
    trades: DataFrame, bucket_ms: int = 1000, arrival: str = "a", arrivals_per_chunk: int = 1_000_000
) -> DataFrame:
    """Candles in arrival order: a new one whenever the bucket differs from the previous trade's.

    Out-of-order input therefore gives several candles for one bucket; ``run`` tells them apart.
    """
    # Runs within a chunk of arrivals, then one row per chunk tells which of them go on across its edge.
    here = Window.partitionBy("symbol", "_chunk").orderBy(arrival)
    rows = trades.withColumns(
        {"epoch_ms": floor_to(F.col("t"), bucket_ms), "_chunk": floor_to(F.col(arrival), arrivals_per_chunk)}
    )
    changed = F.when(F.lag("epoch_ms").over(here) == F.col("epoch_ms"), 0).otherwise(1).cast("long")
    rows = rows.withColumn("_changed", changed).withColumn("_run", F.sum("_changed").over(here))
    runs = rows.groupBy("symbol", "_chunk", "_run", "epoch_ms").agg(
        F.min_by("p", arrival).alias("_open"),
        F.max("p").alias("_high"),
        F.min("p").alias("_low"),
        F.max_by("p", arrival).alias("_close"),
        F.sum("q").alias("_volume"),
        F.count(F.lit(1)).alias("_count"),
    )
    runs = saved(runs)
    edges = runs.groupBy("symbol", "_chunk").agg(
        F.min_by("epoch_ms", "_run").alias("_first"), F.max_by("epoch_ms", "_run").alias("_last"), F.max("_run").alias("_runs")
    )
    chunks = Window.partitionBy("symbol").orderBy("_chunk")
    goes_on = F.when(F.lag("_last").over(chunks) == F.col("_first"), 1).otherwise(0)
    edges = edges.withColumn("_goes_on", goes_on)
    earlier = F.coalesce(F.sum("_runs").over(chunks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = edges.select(
        "symbol", "_chunk", (earlier - F.sum("_goes_on").over(chunks.rowsBetween(Window.unboundedPreceding, 0))).alias("_shift")
    )
    runs = join_on(runs, edges, ["symbol", "_chunk"]).withColumn("run", F.col("_run") + F.col("_shift"))
    return runs.groupBy("symbol", "run", "epoch_ms").agg(
        F.round(F.min_by("_open", "_chunk"), 8).alias("open"),
        F.round(F.max("_high"), 8).alias("high"),
        F.round(F.min("_low"), 8).alias("low"),
        F.round(F.max_by("_close", "_chunk"), 8).alias("close"),
        F.round(F.sum("_volume"), 8).alias("volume"),
        F.sum("_count").alias("trade_count"),
    )


def coverage(candles: DataFrame, keys: tuple[str, ...] = ("symbol",), bucket_ms: int = 1000) -> DataFrame:
    """Rows found against buckets spanned by first and last candle."""
    found = candles.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("candles"),
        F.min("epoch_ms").alias("first_ms"),
        F.max("epoch_ms").alias("last_ms"),
    )
    expected = F.when(F.col("candles") < 2, F.col("candles")).otherwise(
        F.floor((F.col("last_ms") - F.col("first_ms")) / F.lit(bucket_ms)).cast("long")
    )
    return found.withColumn("expected", expected).withColumn(
        "coverage", F.round(F.col("candles") / F.nullif(F.col("expected"), F.lit(0)), 6)
    )


def candle_text(candles: DataFrame) -> DataFrame:
    """Candles as text, ready for a CSV file."""
    from sparktape.functions.pricing import plain_decimal
    from sparktape.functions.timeops import iso_millis

    return candles.select(
        "symbol",
        iso_millis(F.col("epoch_ms")).alias("timestamp"),
        *[plain_decimal(F.col(c)).alias(c) for c in ("open", "high", "low", "close", "volume")],
        F.col("trade_count").alias("tradeCount"),
    )
