"""Candles that late trades restate: every micro-batch leaves mergeable parts, and candles are read as of any batch.

A watermark drops trades that come after their candle was published. Here nothing is dropped: a micro-batch folds its trades
to one part per symbol and bucket - with the ranks of its first and last trade, so that parts merge in any order - and writes
them under its own number. A repeated batch replaces its own parts, so a restart changes nothing. Reading merges the parts
of each candle; the number of parts tells how often it was restated. :func:`compact` folds old parts into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparktape.functions.timeops import floor_to
from sparktape.lineage import delete
from sparktape.operators.candles import _rank

PARTS = (
    "symbol string, epoch_ms long, open double, open_at decimal(38,0), high double, low double, close double, close_at decimal(38,0), "
    "volume double, trade_count long, parts long, last_batch long"
)


def candle_parts(trades: DataFrame, bucket_ms: int, batch: int) -> DataFrame:
    """One mergeable row per symbol and bucket of ``symbol, a, t, p, q``; trades repeated within them count once."""
    rank = _rank(["t", "a"]).cast("decimal(38,0)")
    rows = trades.dropDuplicates(["symbol", "a"]).withColumn("epoch_ms", floor_to(F.col("t"), bucket_ms))
    return rows.groupBy("symbol", "epoch_ms").agg(
        F.min_by("p", rank).alias("open"), F.min(rank).alias("open_at"), F.max("p").alias("high"), F.min("p").alias("low"),
        F.max_by("p", rank).alias("close"), F.max(rank).alias("close_at"), F.sum("q").alias("volume"), F.count(F.lit(1)).alias("trade_count"),
        F.lit(1).cast("long").alias("parts"), F.lit(batch).cast("long").alias("last_batch"),
    )


def merged(parts: DataFrame) -> DataFrame:
    """Parts of the same candle as one; merging is associative."""
    return parts.groupBy("symbol", "epoch_ms").agg(
        F.min_by("open", "open_at").alias("open"), F.min("open_at").alias("open_at"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "close_at").alias("close"), F.max("close_at").alias("close_at"), F.sum("volume").alias("volume"), F.sum("trade_count").alias("trade_count"),
        F.sum("parts").alias("parts"), F.max("last_batch").alias("last_batch"),
    )


def write_restated(trades: DataFrame, path: str, checkpoint: str, bucket_ms: int = 1000, backfill: bool = False, every: str = "10 seconds") -> StreamingQuery:
    """Keep the parts of every micro-batch of the stream ``trades`` below ``path``."""

    def keep(batch: DataFrame, number: int) -> None:
        candle_parts(batch.select("symbol", "a", "t", "p", "q"), bucket_ms, number).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = trades.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if backfill else writer.trigger(processingTime=every)
    return writer.start()


def _folders(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """(last batch within the compacted parts or -1, batches written after it); only finished writes count."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return -1, []
    done = [s.getPath() for s in files.listStatus(root) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    numbers = {kind: [int(p.getName()[len(kind) :]) for p in done if p.getName().startswith(kind)] for kind in ("batch=", "upto=")}
    base = max(numbers["upto="], default=-1)
    return base, sorted(n for n in numbers["batch="] if n > base)


def _parts(spark: SparkSession, path: str, as_of: int | None) -> tuple[DataFrame, list[str]]:
    base, batches = _folders(spark, path)
    if as_of is not None and as_of < base:
        raise ValueError(f"batches up to {base} are merged into one")
    paths = [f"{path}/upto={base}"] * (base >= 0) + [f"{path}/batch={n}" for n in batches if as_of is None or n <= as_of]
    return (spark.read.schema(PARTS).parquet(*paths) if paths else spark.createDataFrame([], PARTS)), paths


def restated_candles(spark: SparkSession, path: str, as_of: int | None = None) -> DataFrame:
    """Candles of all trades that have come in, or had by batch ``as_of``: ``symbol, epoch_ms, open .. trade_count``, and
    ``version`` (the last batch that changed the candle) and ``restated`` (how often it was changed after its first one)."""
    rows = merged(_parts(spark, path, as_of)[0])
    number = lambda c: F.round(c, 8).alias(c)
    return rows.select(
        "symbol", "epoch_ms", *map(number, ("open", "high", "low", "close", "volume")), "trade_count",
        F.col("last_batch").alias("version"), (F.col("parts") - 1).alias("restated"),
    )


def compact(spark: SparkSession, path: str) -> None:
    """Merge all finished parts into one; readers see either the old ones or the new one, as only finished folders count."""
    rows, paths = _parts(spark, path, None)
    base, batches = _folders(spark, path)
    if not batches:
        return
    merged(rows).write.mode("overwrite").parquet(f"{path}/upto={batches[-1]}")
    for old in paths:
        delete(spark, old)
