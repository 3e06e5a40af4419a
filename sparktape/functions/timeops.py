"""Epoch-millisecond arithmetic and text forms, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
HOUR_MS = 3_600_000
# Fixed value: largest 13-digit epoch; anything above is in microseconds.
MAX_EPOCH_MS = 9_999_999_999_999


def normalize_epoch(t: Column) -> Column:
    """Microseconds to milliseconds; milliseconds stay."""
    return F.when(t > MAX_EPOCH_MS, F.floor(t / 1000).cast("long")).otherwise(t)


def floor_to(t: Column, width_ms: int) -> Column:
    """Start of the bucket holding ``t``; integer arithmetic only."""
    return t - F.pmod(t, F.lit(int(width_ms)))


def to_millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def iso_millis(t: Column) -> Column:
    return F.date_format(F.timestamp_millis(t), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_day(t: Column) -> Column:
    return F.date_format(F.timestamp_millis(t), "yyyy-MM-dd")


def epoch_seconds(t: Column) -> Column:
    return t / F.lit(1000.0)


def day_to_millis(day: Column) -> Column:
    """``yyyy-MM-dd`` to epoch ms at UTC midnight; anything else is an error."""
    parsed = F.try_to_timestamp(day, F.lit("yyyy-MM-dd"))
    return F.when(
        day.isNotNull() & parsed.isNull(),
        F.raise_error(F.concat(F.lit("invalid date: "), day)).cast("long"),
    ).otherwise(F.unix_millis(parsed))


def in_window(t: Column, start: Column, end: Column, window_end: Column) -> Column:
    """Day end is exclusive, window end inclusive."""
    return (t >= start) & (t < end) & (t <= window_end)


def split_days(start_ms: Column, end_ms: Column) -> Column:
    """Array of (day_start, day_end) covering ``[start, end)`` in day steps."""
    steps = F.ceil((end_ms - start_ms) / F.lit(float(DAY_MS))).cast("long")
    offsets = F.when(steps > 0, F.sequence(F.lit(0).cast("long"), steps - 1)).otherwise(
        F.array().cast("array<bigint>")
    )
    return F.transform(
        offsets,
        lambda i: F.struct(
            (start_ms + i * F.lit(DAY_MS)).alias("day_start"),
            F.least(start_ms + (i + 1) * F.lit(DAY_MS), end_ms).alias("day_end"),
        ),
    )


def hour_windows(day_start: Column, day_end: Column) -> Column:
    """Array of (window_start, window_end): hourly windows, the end inclusive for membership."""
    steps = F.ceil((day_end - day_start) / F.lit(float(HOUR_MS))).cast("long")
    offsets = F.when(steps > 0, F.sequence(F.lit(0).cast("long"), steps - 1)).otherwise(
        F.array().cast("array<bigint>")
    )
    return F.transform(
        offsets,
        lambda i: F.struct(
            (day_start + i * F.lit(HOUR_MS)).alias("window_start"),
            F.least(day_start + (i + 1) * F.lit(HOUR_MS), day_end).alias("window_end"),
        ),
    )
