"""Chronological splits at exact row positions, without a global sort."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktape.functions.timeops import DAY_MS, floor_to
from sparktape.lineage import saved
from sparktape.operators.scans import join_on
from sparktape.schema import TapeError

# Bucket widths used to narrow a position down: day, minute, millisecond. Each bucket has a bounded number of parts.
WIDTHS = (DAY_MS, 60_000, 1)


def times_at(df: DataFrame, keys: list[str], time: str, positions: Callable[[Column], Column]) -> DataFrame:
    """Time found at given positions of the sorted rows of each key.

    ``positions`` maps the row count to an array of positions from 0. Result: ``keys, n, first_ms, id, pos, at_ms``,
    with ``at_ms`` NULL for a position outside the rows. Only counts per bucket are ever sorted. Each level saves its
    few rows, so that Spark knows their size and filters the next scan of ``df`` by broadcast instead of shuffling it;
    pass a table rather than a long computation.
    """
    t = F.col(time)
    per_day = df.groupBy(*keys, floor_to(t, DAY_MS).alias("_b0")).agg(
        F.count(F.lit(1)).alias("_cnt"), F.min(time).alias("_first")
    )
    wanted = (
        per_day.groupBy(*keys)
        .agg(F.sum("_cnt").alias("n"), F.min("_first").alias("first_ms"))
        .select("*", F.posexplode(positions(F.col("n"))).alias("id", "pos"))
        .withColumn("_left", F.col("pos"))
    )
    counts, parent = per_day.drop("_first"), []
    found = wanted
    for level, width in enumerate(WIDTHS):
        bucket = f"_b{level}"
        if level:
            spot = found.where(F.col(f"_b{level - 1}").isNotNull()).select(*keys, f"_b{level - 1}").distinct()
            finer = df.select(*keys, floor_to(t, WIDTHS[level - 1]).alias(f"_b{level - 1}"), floor_to(t, width).alias(bucket))
            counts = (
                join_on(finer, spot, [*keys, f"_b{level - 1}"])
                .groupBy(*keys, f"_b{level - 1}", bucket)
                .agg(F.count(F.lit(1)).alias("_cnt"))
            )
            parent = [f"_b{level - 1}"]
        upto = F.sum("_cnt").over(
            Window.partitionBy(*keys, *parent).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
        )
        counts = counts.withColumn("_upto", upto)
        on = [F.col(f"w.{k}").eqNullSafe(F.col(f"c.{k}")) for k in (*keys, *parent)]
        found = (
            found.alias("w")
            .join(
                counts.alias("c"),
                on + [F.col("_left") < F.col("_upto"), F.col("_left") >= F.col("_upto") - F.col("_cnt")],
                "left",
            )
            .select(
                *[f"w.{k}" for k in keys],
                "n",
                "first_ms",
                "id",
                "pos",
                (F.col("_left") - (F.col("_upto") - F.col("_cnt"))).alias("_left"),
                bucket,
            )
        )
        found = saved(found)
    return found.select(*keys, "n", "first_ms", "id", "pos", F.col(f"_b{len(WIDTHS) - 1}").alias("at_ms"))


def train_val_split(df: DataFrame, ratio: float, time: str = "epoch_ms", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Add ``part``: rows before the time at position ``int(n * ratio)`` train, the others validation.

    Equal times at the edge all go to validation.
    """
    cut = times_at(df, list(keys), time, lambda n: F.array(F.floor(n * F.lit(float(ratio))).cast("long")))
    part = (
        F.when((F.col("n") < 2) | (F.col("pos") >= F.col("n")), "train")
        .when(F.col("pos") <= 0, "validation")
        .when(F.col(time) < F.col("at_ms"), "train")
        .otherwise("validation")
    )
    return join_on(df, cut.select(*keys, "n", "pos", "at_ms"), list(keys)).select(*df.columns, part.alias("part"))


def fold_cuts(df: DataFrame, k: int, time: str = "epoch_ms", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``keys, _cuts``: the times at which k+1 chunks of equal size begin, but for the first; equal times stay together.

    Too few rows or an empty chunk is an error.
    """
    if k < 2:
        raise TapeError(f"k must be >= 2, got {k}")
    size = lambda n: F.floor(n / F.lit(k + 1)).cast("long")
    edges = times_at(df, list(keys), time, lambda n: F.array(*[size(n) * i for i in range(1, k + 1)]))
    cuts = edges.groupBy(*keys).agg(
        F.first("n").alias("n"),
        F.first("first_ms").alias("first_ms"),
        F.transform(F.array_sort(F.collect_list(F.struct("id", "at_ms"))), lambda e: e["at_ms"]).alias("_cuts"),
    )
    rising = F.forall(
        F.sequence(F.lit(1), F.lit(k - 1)), lambda i: F.get("_cuts", i) > F.get("_cuts", i - 1)
    )
    sound = (size(F.col("n")) >= 1) & (F.get("_cuts", F.lit(0)) > F.col("first_ms")) & rising
    return cuts.select(
        *keys,
        F.when(F.coalesce(sound, F.lit(False)), F.col("_cuts"))
        .otherwise(F.raise_error(F.lit("not enough rows or times for the folds")).cast("array<bigint>"))
        .alias("_cuts"),
    )


def in_folds(df: DataFrame, cuts: DataFrame, time: str = "epoch_ms", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Rows per ``fold`` (1..k) and ``part``, of the cuts of :func:`fold_cuts`."""
    t, at = F.col(time), F.col("_cut")
    part = F.when(t < at, "train").when(F.col("_next").isNull() | (t < F.col("_next")), "validation")
    return (
        join_on(df, cuts, list(keys))
        .select(*df.columns, "_cuts", F.posexplode("_cuts").alias("_i", "_cut"))
        .withColumn("_next", F.get("_cuts", F.col("_i") + 1))
        .select(*df.columns, (F.col("_i") + 1).cast("long").alias("fold"), part.alias("part"))
        .where(F.col("part").isNotNull())
    )


def kfold_split(df: DataFrame, k: int, time: str = "epoch_ms", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Rows per ``fold`` (1..k) and ``part``: expanding train, then the next of k+1 chunks as validation.

    Equal times stay on one side. Too few rows or an empty side is an error.
    """
    return in_folds(df, fold_cuts(df, k, time, keys), time, keys)


def split_report(parts: DataFrame, keys: list[str], time: str = "epoch_ms", whole: list[str] | None = None) -> DataFrame:
    """Rows, share, first and last time per part; ``whole`` is the key whose parts make 100 percent."""
    whole = whole if whole is not None else [k for k in keys if k != "part"]
    rows = parts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.min(time).alias("first_ms"), F.max(time).alias("last_ms")
    )
    total = F.sum("rows").over(Window.partitionBy(*whole))
    return rows.withColumn("pct", F.round(F.col("rows") / total * 100.0, 1))


def leakage(parts: DataFrame, keys: list[str], time: str = "epoch_ms") -> DataFrame:
    """Times present on both sides and whether train ends before validation starts."""
    train, val = F.col("part") == "train", F.col("part") == "validation"
    per_time = parts.groupBy(*keys, time).agg(F.bool_or(train).alias("_t"), F.bool_or(val).alias("_v"))
    return (
        per_time.groupBy(*keys)
        .agg(
            F.count_if(F.col("_t") & F.col("_v")).alias("shared_times"),
            F.max(F.when(F.col("_t"), F.col(time))).alias("train_last_ms"),
            F.min(F.when(F.col("_v"), F.col(time))).alias("validation_first_ms"),
        )
        .withColumn("in_order", F.col("train_last_ms") < F.col("validation_first_ms"))
    )
