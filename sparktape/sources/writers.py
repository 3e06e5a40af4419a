"""Writers for trade tapes, candles, summaries and trade logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktape.functions.pricing import plain_decimal
from sparktape.functions.timeops import iso_day, iso_millis
from sparktape.lineage import saved
from sparktape.operators.candles import candle_text


def write_trades(
    trades: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet", gzip: bool = True
) -> None:
    """Tape by symbol and day, in time order within a file.

    Overwriting replaces the days that ``trades`` holds, once all of them are written; other days stay, and a write that
    fails changes nothing. Range partitioning on (symbol, day, time) lets a busy day spread over several files. JSON lines have the tape's own
    fields, prices as plain decimals and, where the tape has them, the maker and best-match flags.
    """
    rows = trades.withColumn("day", iso_day(F.col("t")))
    rows = rows.repartitionByRange("symbol", "day", "t", "a").sortWithinPartitions("symbol", "day", "t", "a")
    if fmt == "json":
        # Field names and order of a tape line.
        optional = (("first_id", "f"), ("last_id", "l"), ("t", "T"), ("is_maker", "m"), ("is_best", "M"))
        line = F.struct(
            "a",
            *[plain_decimal(F.col(c)).alias(c) for c in ("p", "q")],
            *[F.col(c).alias(n) for c, n in optional if c in trades.columns],
        )
        # As text: two field names differ by case only, which a table of columns could not hold.
        rows, fmt = rows.select(F.to_json(line).alias("value"), "symbol", "day"), "text"
    writer = rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "day").format(fmt)
    if fmt == "text" and gzip:
        writer = writer.option("compression", "gzip")
    writer.save(path)


def store_days(trades: DataFrame, path: str, fmt: str = "parquet", gzip: bool = True) -> DataFrame:
    """Write whole days as :func:`write_trades` does, then their record below ``<path>-days``; returns the record's new rows.

    The record has one row per symbol and day - rows, first and last time and id, and volume - and is replaced day by day like
    the tape, so totals of a long tape are read from it (:func:`sparktape.sources.readers.stored_days`), not from the trades.
    Rows are counted as written. It is written last: a day whose record is missing or old was not finished, and storing it
    again finishes it.
    """
    rows = saved(trades)
    write_trades(rows, path, fmt=fmt, gzip=gzip)
    days = rows.groupBy("symbol", iso_day(F.col("t")).alias("day")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("t").alias("first_ms"), F.max("t").alias("last_ms"),
        F.min("a").alias("first_id"), F.max("a").alias("last_id"), F.round(F.sum("q"), 8).alias("volume"),
    )
    days = saved(days)
    few = days.repartitionByRange("symbol", "day")
    few.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "day").parquet(f"{path}-days")
    return days


def write_candles_csv(candles: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Candle CSV with plain decimals, by symbol."""
    rows = candle_text(candles).repartitionByRange("symbol", "timestamp").sortWithinPartitions("symbol", "timestamp")
    rows.write.mode(mode).partitionBy("symbol").option("header", True).csv(path)


def write_candles(candles: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Candles as Parquet by symbol and day, so that ranges prune whole folders."""
    rows = candles.withColumn("day", iso_day(F.col("epoch_ms")))
    rows = rows.repartitionByRange("symbol", "day", "epoch_ms").sortWithinPartitions("symbol", "day", "epoch_ms")
    rows.write.mode(mode).partitionBy("symbol", "day").parquet(path)


def write_summary(summary: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet") -> None:
    writer = summary.write.mode(mode).partitionBy("symbol")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)


def write_trade_log(
    log: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet", top: DataFrame | None = None
) -> None:
    """Trade log by symbol, sorted by parameter set; ``top`` (symbol, combo_id) keeps the best sets, each in its own folder.

    CSV can be read back with :func:`sparktape.sources.readers.read_trade_log`.
    """
    rows = log if top is None else log.join(top.select("symbol", "combo_id"), ["symbol", "combo_id"], "left_semi")
    rows = rows.withColumns(
        {"entry_time": iso_millis(F.col("entry_ms")), "exit_time": iso_millis(F.col("exit_ms"))}
    )
    rows = rows.repartitionByRange("symbol", "combo_id", "entry_ms").sortWithinPartitions(
        "symbol", "combo_id", "entry_ms"
    )
    writer = rows.write.mode(mode).partitionBy("symbol", *([] if top is None else ["combo_id"]))
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)
