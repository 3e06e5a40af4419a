"""The provided tables seen as a trade tape, candles and a trade log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparktape.functions.timeops import HOUR_MS, to_millis
from sparktape.lineage import saved
from sparktape.operators.candles import ohlcv
from sparktape.operators.trades import trade_log
from sparktape.schema import Params

DEFAULTS = Params(
    xs=(20.0, 50.0),
    ys=(7200, 21600),
    zs=(20.0, 90.0),
    hold_s=21600,
    direction="long",
    size=100.0,
    fee=0.001,
    slip=0.0005,
    capital=1000.0,
    y_max_s=21600,
    top_n=3,
    chunk_ms=5 * 86_400_000,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a tape: symbol = event type, price = value, quantity from the properties."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"),
        F.col("event_id").alias("a"),
        to_millis(F.col("ts")).alias("t"),
        F.col("value").alias("p"),
        F.get_json_object("props", "$.k").cast("double").alias("q"),
    )


def order_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as a tape; many orders share a day, so ties are common."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("symbol"),
        F.col("o_orderkey").alias("a"),
        to_millis(F.col("o_orderdate")).alias("t"),
        F.col("o_totalprice").alias("p"),
        F.lit(1.0).alias("q"),
    )


def candles(spark: SparkSession, sf_dir: str, bucket_ms: int = HOUR_MS) -> DataFrame:
    return ohlcv(trades(spark, sf_dir), bucket_ms)


def candle_table(spark: SparkSession, sf_dir: str, bucket_ms: int = HOUR_MS) -> DataFrame:
    """Candles rolled up once, for runs that read them more than once."""
    return saved(candles(spark, sf_dir, bucket_ms))


def gappy_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candles where every fifth hour has no close and every seventh no high."""
    hour = F.floor(F.col("epoch_ms") / HOUR_MS)
    rows = candle_table(spark, sf_dir)
    return rows.withColumns(
        {"close": F.when(F.pmod(hour, F.lit(5)) != 2, F.col("close")), "high": F.when(F.pmod(hour, F.lit(7)) != 3, F.col("high"))}
    )


def tlog(spark: SparkSession, sf_dir: str, params: Params = DEFAULTS, bucket_ms: int = HOUR_MS) -> DataFrame:
    return trade_log(candle_table(spark, sf_dir, bucket_ms), params)
