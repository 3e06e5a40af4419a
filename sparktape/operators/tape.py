"""Filters and set operations on the trade tape and on time intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktape.functions.timeops import DAY_MS, floor_to, split_days
from sparktape.operators.scans import Run, running


def time_range(trades: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    return trades.where((F.col("t") >= start_ms) & (F.col("t") < end_ms))


def time_range_counts(trades: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Kept and skipped rows of :func:`time_range` per symbol."""
    inside = (F.col("t") >= start_ms) & (F.col("t") < end_ms)
    return trades.groupBy("symbol").agg(
        F.count_if(inside).alias("kept"), F.count_if(~inside).alias("skipped")
    )


def dedupe(trades: DataFrame, keys: tuple[str, ...] = ("symbol", "a")) -> DataFrame:
    return trades.dropDuplicates(list(keys))


def merge_days(*parts: DataFrame) -> DataFrame:
    """Union of per-day or per-file parts; an empty part adds nothing."""
    return reduce(lambda x, y: x.unionByName(y), parts)


def uncovered_intervals(
    intervals: DataFrame,
    keys: list[str],
    name: str,
    start: str,
    end: str,
    req_start: Column,
    req_end: Column,
    chunk: int,
) -> DataFrame:
    """Intervals overlapping ``[req_start, req_end)`` that no larger (or equal, earlier named) one covers.

    Of intervals with one start only the longest can stay, so those are aggregated first; a chunk then holds at most
    one interval per possible start. In start order an interval is covered exactly when an earlier one reaches its
    end: one running maximum replaces the containment self-join. ``start`` and ``end`` are numeric.
    """
    s, e = F.col(start), F.col(end)
    longest = (
        intervals.where((s < req_end) & (e > req_start))
        .groupBy(*keys, start)
        .agg(F.min_by(F.struct(*intervals.columns), F.struct(-e, F.col(name))).alias("_row"))
        .select("_row.*")
    )
    seen = running(
        longest, keys, [start], floor_to(s, chunk), [Run("_reach", "max", e, inclusive=False)]
    )
    return seen.where(F.col("_reach").isNull() | (F.col("_reach") < e)).drop("_reach")


def day_coverage(requested: DataFrame, trades: DataFrame, keys: list[str]) -> DataFrame:
    """Each requested ``[start_ms, end_ms)`` as days, flagged whether the tape holds trades of that day."""
    days = requested.select(
        *keys, F.explode(split_days(F.col("start_ms"), F.col("end_ms"))).alias("d")
    ).select(*keys, F.col("d.day_start").alias("day_ms"))
    present = (
        trades.select(*keys, floor_to(F.col("t"), DAY_MS).alias("day_ms"))
        .distinct()
        .withColumn("present", F.lit(True))
    )
    return days.join(present, [*keys, "day_ms"], "left").withColumn(
        "present", F.coalesce("present", F.lit(False))
    )


def day_totals(trades: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Rows per day and the running total up to that day."""
    per_day = trades.groupBy(*keys, floor_to(F.col("t"), DAY_MS).alias("day_ms")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    return running(
        per_day, list(keys), ["day_ms"], floor_to(F.col("day_ms"), 1000 * DAY_MS), [Run("running_rows", "sum", F.col("rows"))]
    )
