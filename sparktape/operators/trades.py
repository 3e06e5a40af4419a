"""The trade log: signals, exits, one open trade per parameter set, prices and profit."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparktape.functions.pricing import excursions, exit_price, profit
from sparktape.lineage import saved
from sparktape.operators.exits import exits, long_exits
from sparktape.operators.nonoverlap import select_nonoverlapping
from sparktape.operators.scans import chunk_with_halo, join_on, spread, with_close
from sparktape.operators.signals import long_moves, moves_dynamic, moves_fixed
from sparktape.schema import Params

# Lanes (y, z) that a task of the walk handles together, for all x.
LANES_TOGETHER = 16


def entry_moves(candles: DataFrame, params: Params, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Every possible entry, with its move over each lookback: ``keys, epoch_ms, move_<i>`` (``y_actual_seconds``)."""
    keys = list(keys)
    ys = [params.y_max_s] if params.dynamic_y else sorted(params.ys)
    path = with_close(candles.select(*keys, "epoch_ms", "close"))
    moved = moves_dynamic(path, keys, params.y_max_s, params.chunk_ms) if params.dynamic_y else moves_fixed(path, keys, ys, params.chunk_ms)
    reached = [F.coalesce(F.col(f"move_{i}") >= min(params.xs), F.lit(False)) for i in range(len(ys))]
    return moved.where(reduce(or_, reached)).drop("close")


def entry_exits(
    candles: DataFrame, params: Params, keys: tuple[str, ...] = ("symbol",), moves: DataFrame | None = None
) -> DataFrame:
    """Every possible entry and, per z, its exit; shared by all x and y. ``moves`` are saved :func:`entry_moves`.

    Holds up to a chunk come with the chunk; longer ones are followed over a tree of chunks.
    """
    keys = list(keys)
    moves = saved(entry_moves(candles, params, tuple(keys))) if moves is None else moves
    path = with_close(candles.select(*keys, "epoch_ms", "high", "low", "close"))
    entries = moves.select(*keys, "epoch_ms", F.lit(True).alias("is_entry"))
    path = join_on(path, entries, [*keys, "epoch_ms"], "left").withColumn("is_entry", F.coalesce("is_entry", F.lit(False)))
    if params.hold_ms > params.chunk_ms:
        return long_exits(path, keys, list(params.zs), params.hold_ms, params.slip, params.direction, params.chunk_ms)
    rows = chunk_with_halo(path, keys, "epoch_ms", params.chunk_ms, after_ms=params.hold_ms, first_after=True)
    rows = spread(rows, *keys, "_chunk", rows=3 * candles.count())
    flagged = rows.withColumn("is_entry", F.col("_core") & F.col("is_entry"))
    return exits(flagged, keys, list(params.zs), params.hold_ms, params.slip, params.direction)


def taken_trades(
    moves: DataFrame, found: DataFrame, sets: DataFrame | None, params: Params, keys: tuple[str, ...] = ("symbol",)
) -> DataFrame:
    """Entries and exits each parameter set really takes, of those it has a signal for: ``keys, combo_id, x, y, z, ...``.

    The walk gets one row per entry, lookback and z, with its move, and steps over all x itself; only ids and times go
    through it, and prices are joined to the few trades that remain.
    """
    keys = list(keys)
    xs, zs = sorted(params.xs), sorted(params.zs)
    ys = [params.y_max_s] if params.dynamic_y else sorted(params.ys)
    rows = long_moves(moves, ys, [*keys, "epoch_ms"]).where(F.col("move") >= min(xs))
    if sets is not None:
        scope = [c for c in keys if c in sets.columns]
        rows = rows.join(sets.select(*scope, "y").distinct(), [*scope, "y"], "left_semi")
    fired = join_on(rows, found.select(*keys, "epoch_ms", "z", "exit_ms"), [*keys, "epoch_ms"])
    if sets is not None:
        fired = fired.join(sets.select(*scope, "y", "z").distinct(), [*scope, "y", "z"], "left_semi")
    spot = lambda values, kind, c: F.array_position(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col(c)) - 1
    lane = spot(ys, "bigint", "y") * len(zs) + spot(zs, "double", "z")
    taken = select_nonoverlapping(
        fired.select(*keys, lane.alias("lane"), "epoch_ms", "exit_ms", "move"),
        keys,
        "lane",
        "epoch_ms",
        "exit_ms",
        params.chunk_ms,
        lanes_together=LANES_TOGETHER,
        spans=params.spans,
        value="move",
        levels=tuple(float(x) for x in xs),
        rows_expected=moves.count() * len(ys) * len(zs),
    )
    level, pair = F.pmod("lane", F.lit(len(xs))), F.floor(F.col("lane") / len(xs))
    value = lambda values, kind, at: F.get(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), at.cast("int"))
    taken = taken.select(
        *keys,
        (level * (len(ys) * len(zs)) + pair + 1).cast("int").alias("combo_id"),
        value(xs, "double", level).alias("x"),
        value(ys, "bigint", F.floor(pair / len(zs))).alias("y"),
        value(zs, "double", F.pmod(pair, F.lit(len(zs)))).alias("z"),
        "epoch_ms",
    )
    if sets is not None:
        taken = taken.drop("combo_id").join(sets, [*scope, "x", "y", "z"])
    taken = join_on(taken, found, [*keys, "epoch_ms", "z"])
    if params.dynamic_y:
        taken = join_on(taken, moves.select(*keys, "epoch_ms", "y_actual_seconds"), [*keys, "epoch_ms"])
    return taken


def trade_log(
    candles: DataFrame, params: Params, keys: tuple[str, ...] = ("symbol",), sets: DataFrame | None = None
) -> DataFrame:
    """One row per trade and parameter set.

    ``keys`` may hold a split part besides the symbol; nothing then crosses a part. ``sets`` limits the run to some
    parameter sets of the grid (``combo_id, x, y, z`` and optionally keys). Moves and exits of all possible entries are
    saved once: both the walk and the join of prices start from them. Pass saved candles: they are read twice.
    """
    moves = saved(entry_moves(candles, params, keys))
    return log_of(moves, saved(entry_exits(candles, params, keys, moves)), params, keys, sets)


def log_of(moves: DataFrame, found: DataFrame, params: Params, keys: tuple[str, ...] = ("symbol",), sets: DataFrame | None = None) -> DataFrame:
    """:func:`trade_log` from saved :func:`entry_moves` and :func:`entry_exits`."""
    taken = taken_trades(moves, found, sets, params, keys)
    leave = exit_price(F.col("raw_exit"), params.slip, params.direction)
    fees, pnl, pct = profit(F.col("entry_price"), F.col("exit_price"), params.size, params.fee, params.direction)
    mae, mfe = excursions(F.col("entry_price"), F.col("max_price"), F.col("min_price"), params.direction)
    actual: Column = F.col("y_actual_seconds") if params.dynamic_y else F.lit(None).cast("double")
    return taken.withColumn("exit_price", leave).select(
        *keys,
        "combo_id",
        F.col("epoch_ms").alias("entry_ms"),
        "exit_ms",
        "entry_price",
        "exit_price",
        F.col("max_price").alias("max_price_during_trade"),
        F.col("min_price").alias("min_price_during_trade"),
        pnl.alias("pnl"),
        pct.alias("pnl_percent"),
        fees.alias("fees"),
        "reason",
        F.col("x").alias("x_percent"),
        F.col("y").alias("y_seconds"),
        F.col("z").alias("z_percent"),
        mae.alias("mae_pct"),
        mfe.alias("mfe_pct"),
        actual.alias("y_actual_seconds"),
    )


def stoploss(trades: DataFrame, levels: list[float], size: float, direction: str) -> DataFrame:
    """Each trade under each stop level: ``level, sl_triggered, new_pnl, new_pnl_percent``."""
    rows = trades.withColumn("level", F.explode(F.array(*[F.lit(float(v)) for v in levels])))
    share = F.col("level") / 100.0
    quantity = F.lit(float(size)) / F.col("entry_price")
    if direction == "short":
        stop = F.col("entry_price") * (1.0 + share)
        hit = F.col("max_price_during_trade") >= stop
        pnl = F.lit(float(size)) - quantity * stop - F.col("fees")
    else:
        stop = F.col("entry_price") * (1.0 - share)
        hit = F.col("min_price_during_trade") <= stop
        pnl = quantity * stop - F.lit(float(size)) - F.col("fees")
    return rows.select(
        "*",
        hit.alias("sl_triggered"),
        F.when(hit, pnl).otherwise(F.col("pnl")).alias("new_pnl"),
        F.when(hit, pnl / F.lit(float(size)) * 100.0).otherwise(F.col("pnl_percent")).alias("new_pnl_percent"),
    )
