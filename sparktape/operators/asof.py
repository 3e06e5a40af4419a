"""Lookups along time between two tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktape.functions.positions import block_table, first_hit
from sparktape.functions.timeops import floor_to
from sparktape.lineage import saved
from sparktape.operators.horizon import fan_of, first_hits, tree
from sparktape.operators.scans import Run, chunk_with_halo, join_on, running, spread, with_close


def asof_forward(
    left: DataFrame, right: DataFrame, keys: list[str], at: str, time: str, value: str, chunk_ms: int
) -> DataFrame:
    """Add to each left row the ``value`` of the first right row with ``time >= at``; NULL if there is none.

    Both sides are put on one axis and read backwards, so no pairs are formed.
    """
    probes = left.select(*keys, F.col(at).alias("_pos"), F.struct(*left.columns).alias("_row"), F.lit(None).cast("double").alias("_val"))
    marks = right.select(
        *keys,
        F.col(time).alias("_pos"),
        F.lit(None).cast(probes.schema["_row"].dataType).alias("_row"),
        F.col(value).cast("double").alias("_val"),
    )
    axis = probes.unionByName(marks).withColumns(
        {"_back": -F.col("_pos"), "_probe": F.col("_row").isNotNull().cast("int")}
    )
    found = running(
        axis, keys, ["_back", "_probe"], floor_to(F.col("_back"), chunk_ms), [Run("_found", "last", F.col("_val"))]
    )
    return found.where("_probe = 1").select("_row.*", F.col("_found").alias(value))


def _reach(path: pa.Table, entries: pa.Table, targets: list[float], horizon_ms: int, short: bool) -> pa.Table:
    """Seconds from each entry to its targets, on one chunk of candles with the horizon after it."""
    path = path.sort_by("epoch_ms")
    ms, close = path["epoch_ms"].to_numpy(), path["close"].to_numpy()
    price, start_ms = entries["entry_price"].to_numpy(), entries["entry_ms"].to_numpy()
    table = block_table(close, np.minimum if short else np.maximum)
    start = np.searchsorted(ms, start_ms, side="left")
    out = []
    for target in targets if len(ms) else []:
        if short:
            at = first_hit(table, start, lambda c, goal=price * (1 - target / 100.0): c <= goal)
        else:
            at = first_hit(table, start, lambda c, goal=price * (1 + target / 100.0): c >= goal)
        when = ms[np.minimum(at, len(ms) - 1)]
        late = (at == len(ms)) | (when > start_ms + horizon_ms)
        out.append(
            entries.append_column("target", pa.array(np.full(len(start), target))).append_column(
                "seconds", pa.array((when - start_ms) / 1000.0, mask=late)
            )
        )
    if not out:
        empty = pa.array([], type=pa.float64())
        return entries.slice(0, 0).append_column("target", empty).append_column("seconds", empty)
    return pa.concat_tables(out)


def _reach_schema(trades: DataFrame, keys: list[str]) -> T.StructType:
    return T.StructType(
        [
            *[trades.schema[c] for c in (*keys, "entry_ms", "entry_price")],
            T.StructField("target", T.DoubleType()),
            T.StructField("seconds", T.DoubleType()),
        ]
    )


def _reached(path: DataFrame, entries: DataFrame, keys: list[str], levels: list[float], horizon_ms: int, short: bool, schema: T.StructType) -> DataFrame:
    kept = [*keys, "entry_ms", "entry_price"]
    return (
        spread(path, *keys, "_chunk")
        .groupBy(*keys, "_chunk")
        .cogroup(entries.groupBy(*keys, "_chunk"))
        .applyInArrow(lambda p, e: _reach(p, e.select(kept), levels, int(horizon_ms), short), schema)
    )


def _distant_targets(
    trades: DataFrame, candles: DataFrame, targets: list[float], horizon_ms: int, direction: str, chunk_ms: int, keys: list[str]
) -> DataFrame:
    """:func:`time_to_target` for horizons longer than a chunk: own chunk first, then the nodes after it."""
    levels, short = [float(t) for t in targets], direction == "short"
    entry, each = [*keys, "entry_ms", "entry_price"], F.explode(F.array(*[F.lit(t) for t in levels]))
    chunk = lambda t: floor_to(F.col(t), chunk_ms).alias("_chunk")
    path = saved(with_close(candles.select(*keys, "epoch_ms", "close")).select(*keys, "epoch_ms", "close", chunk("epoch_ms")))
    entries = trades.select(*entry, chunk("entry_ms")).distinct()
    near = _reached(path, entries, keys, levels, horizon_ms, short, _reach_schema(trades, keys))
    rows = saved(join_on(entries.withColumn("target", each), near, [*entry, "target"], "left"))

    kind = "min" if short else "max"
    nodes = tree(path.groupBy(*keys, "_chunk").agg((F.min if short else F.max)("close").alias("close")), keys, chunk_ms, fan_of(horizon_ms, chunk_ms), {"close": kind})
    past_chunk = F.col("entry_ms") + horizon_ms >= F.col("_chunk") + chunk_ms

    def passes(close, q):
        goal = q["entry_price"] * (1 - q["target"] / 100.0 if short else 1 + q["target"] / 100.0)
        return close <= goal if short else close >= goal

    open_ = rows.where(F.col("seconds").isNull() & past_chunk)
    hits = first_hits(open_, ["entry_price", "target"], path, nodes, keys, "close", short, passes, chunk_ms, horizon_ms)
    rows = join_on(rows, hits, [*keys, "_chunk", "entry_price", "target"], "left")
    late = F.col("hit_ms") - F.col("entry_ms")
    seconds = F.coalesce("seconds", F.when(past_chunk & (late <= horizon_ms), late / F.lit(1000.0)))
    rows = rows.select(*entry, "target", seconds.alias("seconds"))
    return join_on(trades.withColumn("target", each), rows, [*entry, "target"], "left")


def time_to_target(
    trades: DataFrame,
    candles: DataFrame,
    targets: list[float],
    horizon_ms: int,
    direction: str,
    chunk_ms: int,
    keys: tuple[str, ...] = ("symbol",),
) -> DataFrame:
    """Add ``target, seconds``: time from entry to the first close ``target`` percent in favour, NULL if not in the horizon.

    Every trade keeps one row per target, also where there are no candles. Looked up once per distinct entry; a task holds one
    chunk of candles plus the horizon, or, where the horizon is longer than a chunk, one chunk: what it leaves open goes on
    over a tree of chunks.
    """
    keys = list(keys)
    if horizon_ms > chunk_ms:
        return _distant_targets(trades, candles, targets, int(horizon_ms), direction, int(chunk_ms), keys)
    width = max(int(chunk_ms), int(horizon_ms))
    path = chunk_with_halo(with_close(candles.select(*keys, "epoch_ms", "close")), keys, "epoch_ms", width, after_ms=horizon_ms)
    entries = (
        trades.select(*keys, "entry_ms", "entry_price")
        .distinct()
        .withColumn("_chunk", floor_to(F.col("entry_ms"), width))
    )
    schema = _reach_schema(trades, keys)
    levels, short = [float(t) for t in targets], direction == "short"
    found = _reached(path, entries, keys, levels, horizon_ms, short, schema)
    each = trades.withColumn("target", F.explode(F.array(*[F.lit(t) for t in levels])))
    return join_on(each, found, [*keys, "entry_ms", "entry_price", "target"], "left")
