"""Readers for trade tapes, candles and trade logs."""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktape.functions.pricing import parse_number
from sparktape.functions.timeops import DAY_MS, day_to_millis, floor_to, iso_day, normalize_epoch
from sparktape.operators.scans import Run, running
from sparktape.operators.tape import time_range, uncovered_intervals
from sparktape.schema import CANDLE_FILE_COLUMNS, LEGACY_TRADE_LOG_NAMES, TRADE_SCHEMA, TapeError


def _tape_columns(symbol: Column) -> list[Column]:
    return [
        symbol.alias("symbol"),
        F.col("a"),
        normalize_epoch(F.col("T")).alias("t"),
        parse_number(F.col("p")).alias("p"),
        parse_number(F.col("q")).alias("q"),
        F.col("f").alias("first_id"),
        F.col("l").alias("last_id"),
    ]


def _symbol_of(symbol: str | None, above: str) -> Column:
    """The given name, else the partition folder ``symbol=..`` or the folder above ``above`` in the file's path."""
    if symbol:
        return F.lit(symbol.upper())
    path = F.url_decode(F.col("_metadata.file_path"))
    found = [F.regexp_extract(path, pattern, 1) for pattern in (r"/symbol=([^/]+)/", rf"([^/]+)/{above}/")]
    name = F.coalesce(*[F.nullif(f, F.lit("")) for f in found])
    return F.upper(F.coalesce(name, F.raise_error(F.concat(F.lit("no symbol given and none in the path "), path))))


def _or_empty(read, schema: str, spark: SparkSession) -> DataFrame:
    """What ``read`` gives, no rows where the path does not exist."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def parse_tape_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """JSON lines to columns ``a, p, q, f, l, T, maker, best``; blank and malformed lines are dropped.

    Parsed as one struct and renamed by position: two field names differ by case only.
    """
    names = ["a", "p", "q", "f", "l", "T", "maker", "best"]
    renamed = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, TRADE_SCHEMA)])
    parsed = F.from_json(F.col(line), TRADE_SCHEMA).cast(renamed)
    others = [c for c in lines.columns if c != line]
    rows = lines.where(F.trim(F.col(line)) != "").select(*others, parsed.alias("_r"))
    return rows.select(*others, *[F.col(f"_r.{n}").alias(n) for n in names]).where(
        F.col("a").isNotNull() & F.col("T").isNotNull()
    )


_PARSED = "symbol string, a long, p string, q string, f long, l long, T long, maker boolean, best boolean"


def tape_rows(parsed: DataFrame) -> DataFrame:
    """Parsed lines with a ``symbol`` as ``symbol, a, t, p, q, first_id, last_id, is_maker, is_best``."""
    return parsed.select(*_tape_columns(F.col("symbol")), F.col("maker").alias("is_maker"), F.col("best").alias("is_best"))


def read_trades_json(spark: SparkSession, path: str | list[str], symbol: str | None = None) -> DataFrame:
    """JSONL or gzipped JSONL tape as ``symbol, a, t, p, q, first_id, last_id, is_maker, is_best``; empty if there is no file.

    A gzip file is read by one task; :func:`sparktape.operators.candles.ohlcv` shuffles right after, other uses may
    repartition.
    """
    name = _symbol_of(symbol, "raw")
    lines = _or_empty(lambda: spark.read.text(path).select("value", name.alias("symbol")), "value string, symbol string", spark)
    return tape_rows(parse_tape_lines(lines))


BULK_COLUMNS = ["a", "p", "q", "f", "l", "T", "maker", "best"]


def parse_bulk_rows(rows: DataFrame) -> DataFrame:
    """Text columns ``symbol`` and BULK_COLUMNS as a tape. Rows with under seven fields or a non-numeric id are skipped.

    A missing eighth field counts as true, any text but ``true``/``True`` as false.
    """
    rows = rows.where(F.col("a").try_cast("long").isNotNull() & F.col("maker").isNotNull())
    # The texts read as true.
    true = lambda c: F.trim(F.col(c)).isin("true", "True")
    return tape_rows(
        rows.select(
            "symbol",
            "p",
            "q",
            *[F.col(c).try_cast("long").alias(c) for c in ("a", "f", "l", "T")],
            true("maker").alias("maker"),
            F.coalesce(true("best"), F.lit(True)).alias("best"),
        )
    )


def read_trades_csv(spark: SparkSession, path: str | list[str], symbol: str | None = None) -> DataFrame:
    """Daily trade CSV with or without header, as :func:`parse_bulk_rows` reads it."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in BULK_COLUMNS])
    rows = spark.read.schema(schema).option("mode", "PERMISSIVE").csv(path)
    return parse_bulk_rows(rows.select(*BULK_COLUMNS, _symbol_of(symbol, "raw").alias("symbol")))


def read_by_header(spark: SparkSession, path: str | list[str], glob: str, required: list[str], renamed: dict[str, str], keep_empty: bool) -> DataFrame:
    """CSV files below ``path``, every one by its own header, as text columns with ``file_path``.

    Files are grouped by their first line, of which there are few; each group is one scan with its own schema. Old names are
    ``renamed``; a file that lacks a ``required`` column is an error, and unless ``keep_empty`` one without rows.
    """
    reader = lambda: spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    at = F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id())
    lines = reader().text(path).select("value", F.col("_metadata.file_path").alias("file_path"), at.alias("_at"))
    heads = lines.groupBy("file_path").agg(F.min_by("value", "_at").alias("head"), F.count_if(F.trim("value") != "").alias("n"))
    by_head = heads.groupBy("head").agg(F.collect_list("file_path").alias("files"), F.min("n").alias("least")).orderBy("head").collect()
    parts = []
    for group in by_head:
        names = [renamed.get(n, n) for n in next(csv.reader([group.head.lstrip("\ufeff")]))]
        missing = [c for c in required if c not in names]
        if missing:
            raise TapeError(f"missing columns: {missing}; found: {names}; in {group.files[0]}")
        if group.least < 2 and not keep_empty:
            raise TapeError(f"no rows in a file with the columns {names}, such as one of {group.files[:3]}")
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        part = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(group.files)
        parts.append(part.select(*names, F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name")))
    if not parts:
        raise TapeError(f"no file {glob} in {path}")
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def _symbol_in_path() -> Column:
    """Symbol from a ``symbol=..`` folder or the folder above ``ohlc`` of the column ``file_path``; NULL if there is none."""
    path = F.url_decode(F.col("file_path"))
    found = [F.regexp_extract(path, pattern, 1) for pattern in (r"/symbol=([^/]+)/", r"([^/]+)/ohlc/")]
    return F.upper(F.coalesce(*[F.nullif(f, F.lit("")) for f in found]))


def read_candles(spark: SparkSession, path: str | list[str], symbol: str | None = None) -> DataFrame:
    """Candle CSV as ``symbol, epoch_ms, open .. volume, trade_count``; times in epoch ms or ISO form.

    Columns are matched by each file's own header; a file without rows is an error.
    """
    raw = read_by_header(spark, path, "*.csv", CANDLE_FILE_COLUMNS, {}, keep_empty=False)
    stamp = F.col("timestamp")
    unknown = F.raise_error(F.concat(F.lit("no symbol given and none in the path "), F.col("file_path")))
    named = [F.col("symbol")] if "symbol" in raw.columns else []
    name = F.lit(symbol.upper()) if symbol else F.coalesce(*named, _symbol_in_path(), unknown)
    return raw.select(
        name.alias("symbol"),
        F.coalesce(
            stamp.try_cast("double").cast("long"), F.unix_millis(F.try_to_timestamp(stamp))
        ).alias("epoch_ms"),
        *[parse_number(F.col(c)).alias(c) for c in ("open", "high", "low", "close", "volume")],
        F.coalesce(F.col("tradeCount").try_cast("long"), F.lit(0).cast("long")).alias("trade_count"),
    )


def read_trade_log(spark: SparkSession, path: str | list[str], required: list[str]) -> DataFrame:
    """Trade-log CSV files below ``path``, named ``trades_*.csv`` or as this package writes them, with ``file_name``.

    Old column names are renamed, columns are matched by each file's own header, and what a file lacks is NULL. Symbol and
    set id come from partition folders where the file does not have them. Adds ``hold_seconds`` if there are times.
    """
    raw = read_by_header(spark, path, "{trades_*,part-*}.csv", required, LEGACY_TRADE_LOG_NAMES, keep_empty=True)
    from_path = {"symbol": _symbol_in_path(), "combo_id": F.nullif(F.regexp_extract("file_path", r"/combo_id=(\d+)/", 1), F.lit(""))}
    for name, value in from_path.items():
        own = [F.col(name)] if name in raw.columns else []
        raw = raw.withColumn(name, F.coalesce(*own, value))
    texts = {"file_name", "symbol", "reason", "entry_time", "exit_time", "direction"}
    whole = {"combo_id", "entry_ms", "exit_ms", "y_seconds"}
    number = lambda c: F.col(c).try_cast("long") if c in whole else parse_number(F.col(c))
    rows = raw.select(*[F.col(c) if c in texts else number(c).alias(c) for c in raw.columns if c != "file_path"])
    if {"entry_time", "exit_time"} <= set(rows.columns):
        stamp = lambda c: F.try_to_timestamp(F.col(c))
        rows = (
            rows.withColumns({"entry_time": stamp("entry_time"), "exit_time": stamp("exit_time")})
            .withColumns(
                {"entry_ms": F.unix_millis("entry_time"), "exit_ms": F.unix_millis("exit_time")}
            )
            .withColumn("hold_seconds", (F.col("exit_ms") - F.col("entry_ms")) / F.lit(1000.0))
        )
    return rows


def raw_file_spans(files: DataFrame, path: str = "path") -> DataFrame:
    """File paths to day spans ``start_ms, end_ms`` read from the names; other names are left out.

    A single-day name spans that day. Plain and gzipped files both count.
    """
    # The name formats of raw files.
    name = F.regexp_extract(F.col(path), r"([^/]+?)\.jsonl(?:\.gz)?$", 1)
    days = F.regexp_extract_all(name, F.lit(r"(\d{4}-\d{2}-\d{2})"), F.lit(1))
    return (
        files.select("*", name.alias("_name"), days.alias("_days"))
        .where(F.col("_name").rlike(r"^aggTrades_\d{4}-\d{2}-\d{2}(_\d{4}-\d{2}-\d{2})?$"))
        .select(
            *files.columns,
            day_to_millis(F.get("_days", F.lit(0))).alias("start_ms"),
            F.when(F.size("_days") == 2, day_to_millis(F.get("_days", F.lit(1))))
            .otherwise(day_to_millis(F.get("_days", F.lit(0))) + DAY_MS)
            .alias("end_ms"),
        )
    )


def list_files(spark: SparkSession, folder: str, suffix: str = "*.jsonl*") -> DataFrame:
    """Paths below ``folder`` whose names match ``suffix``; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", suffix)
        .load(folder)
        .select("path")
    )


def range_files(spark: SparkSession, folder: str, start_ms: int, end_ms: int) -> DataFrame:
    """``path`` of the tape files below ``folder`` that ``[start_ms, end_ms)`` needs, by their names alone.

    Raw files carry their span in the name; of those in one folder that overlap the range, only files that no other
    one covers are needed. Files in a ``day=..`` folder are all needed if the day overlaps the range.
    """
    files = list_files(spark, folder, "*").withColumn("_day", F.nullif(F.regexp_extract("path", r"/day=(\d{4}-\d{2}-\d{2})/", 1), F.lit("")))
    begin = day_to_millis(F.col("_day"))
    by_day = files.where((begin < end_ms) & (begin + DAY_MS > start_ms)).select("path")
    spans = raw_file_spans(files.where("_day is null").select("path")).withColumn("_folder", F.regexp_extract("path", r"^(.*)/", 1))
    needed = uncovered_intervals(spans, ["_folder"], "path", "start_ms", "end_ms", F.lit(start_ms), F.lit(end_ms), 1000 * DAY_MS)
    return by_day.unionByName(needed.select("path"))


def read_trades_range(spark: SparkSession, folder: str, start_ms: int, end_ms: int, symbol: str | None = None) -> DataFrame:
    """:func:`read_trades_json` of ``[start_ms, end_ms)``: only the files that the range needs are opened.

    The files' names come to the driver, as Spark's own scan would bring them. Where files overlap, trades repeat:
    :func:`sparktape.operators.tape.dedupe` removes them.
    """
    paths = sorted(r.path for r in range_files(spark, folder, start_ms, end_ms).collect())
    trades = read_trades_json(spark, paths, symbol) if paths else tape_rows(spark.createDataFrame([], _PARSED))
    return time_range(trades, start_ms, end_ms)


def read_trades_stored(spark: SparkSession, path: str, start_ms: int, end_ms: int) -> DataFrame:
    """A Parquet tape's ``[start_ms, end_ms)``; days outside are pruned by their folders."""
    day = F.col("day").cast("string")
    rows = spark.read.parquet(path).where((day >= iso_day(F.lit(start_ms))) & (day <= iso_day(F.lit(end_ms - 1))))
    return time_range(rows.drop("day"), start_ms, end_ms)


# Columns of the record of days.
DAYS = "rows long, first_ms long, last_ms long, first_id long, last_id long, volume double, symbol string, day string"


def stored_days(spark: SparkSession, path: str) -> DataFrame:
    """The record that :func:`sparktape.sources.writers.store_days` keeps of a tape, with the running total of rows."""
    record = _or_empty(lambda: spark.read.schema(DAYS).parquet(f"{path}-days"), DAYS, spark)
    record = record.withColumn("day_ms", day_to_millis(F.col("day")))
    return running(record, ["symbol"], ["day_ms"], floor_to(F.col("day_ms"), 1000 * DAY_MS), [Run("running_rows", "sum", F.col("rows"))]).drop("day_ms")


def reject_empty(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise TapeError(f"no rows in {what}")
    return df
