"""Whole runs composed of the operators."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparktape.operators.grid import axes, expand_grid
from sparktape.operators.metrics import advanced_metrics, trade_metrics
from sparktape.operators.screening import apply_thresholds, derive, passes, rank_by_score, screen, verdict
from sparktape.operators.scans import join_on
from sparktape.operators.signals import long_moves
from sparktape.operators.splits import fold_cuts, in_folds, train_val_split
from sparktape.operators.trades import entry_exits, entry_moves, log_of, trade_log
from sparktape.lineage import saved
from sparktape.schema import Params


def symbol_sets(candles: DataFrame, params: Params) -> DataFrame:
    """Every parameter set of every symbol: ``symbol, combo_id, x, y, z``."""
    return expand_grid(candles.select("symbol").distinct(), ["symbol"], *axes(params))


def screen_grid(candles: DataFrame, params: Params) -> DataFrame:
    """Derived screening figures of every parameter set, sets without trades included."""
    log = trade_log(candles, params)
    sums = screen(log, ["symbol", "combo_id"], params.direction, symbol_sets(candles, params), params.dynamic_y)
    return derive(sums, params.capital)


def signal_counts(moves: DataFrame, params: Params) -> DataFrame:
    """``symbol, x, y, signals`` of saved entry moves, for pairs that have any: counted by the highest x reached, then summed up."""
    ys = [params.y_max_s] if params.dynamic_y else sorted(params.ys)
    xs = F.array(*[F.lit(float(x)) for x in sorted(params.xs)])
    reached = F.size(F.filter(xs, lambda x: F.col("move") >= x)).alias("reached")
    levels = long_moves(moves, ys, ["symbol"]).select("symbol", "y", reached).where("reached > 0").groupBy("symbol", "y", "reached").agg(F.count(F.lit(1)).alias("n"))
    each = levels.select("symbol", "y", "n", F.explode(F.slice(xs, F.lit(1), F.col("reached"))).alias("x"))
    return each.groupBy("symbol", "x", "y").agg(F.sum("n").alias("signals"))


def able_sets(moves: DataFrame, candles: DataFrame, params: Params) -> DataFrame:
    """Parameter sets that may reach ``min_trades``: a set has at most as many trades as signals."""
    counts = signal_counts(moves, params).withColumnRenamed("symbol", "_symbol")
    sets = symbol_sets(candles, params)
    same = sets.symbol.eqNullSafe(counts._symbol) & (sets.x == counts.x) & (sets.y == counts.y)
    able = F.coalesce("signals", F.lit(0)) >= params.min_trades
    return sets.join(counts.select("_symbol", "x", "y", "signals"), same, "left").where(able).select("symbol", "combo_id", sets.x, sets.y, "z")


def able_moves(moves: DataFrame, sets: DataFrame, params: Params) -> DataFrame:
    """Entries that some of the sets has a signal for."""
    ys = [params.y_max_s] if params.dynamic_y else sorted(params.ys)
    least = sets.groupBy("symbol").agg(*[F.min(F.when(F.col("y") == y, F.col("x"))).alias(f"_least_{i}") for i, y in enumerate(ys)])
    fires = [F.coalesce(F.col(f"move_{i}") >= F.col(f"_least_{i}"), F.lit(False)) for i in range(len(ys))]
    return join_on(moves, least, ["symbol"]).where(reduce(or_, fires)).select(*moves.columns)


def screen_and_rank(candles: DataFrame, params: Params) -> DataFrame:
    """The best sets that pass the thresholds.

    Sets with fewer signals than the least number of trades cannot pass: they are dropped before exits and walk, with the
    entries that only they have.
    """
    if params.skip_filters or params.min_trades <= 0:
        return rank_by_score(apply_thresholds(screen_grid(candles, params), params), ["symbol"], params.top_n)
    moves = saved(entry_moves(candles, params))
    sets = saved(able_sets(moves, candles, params))
    moves = saved(able_moves(moves, sets, params))
    log = log_of(moves, saved(entry_exits(candles, params, moves=moves)), params, sets=sets)
    sums = screen(log, ["symbol", "combo_id"], params.direction, None, params.dynamic_y)
    sums = join_on(sets, sums, ["symbol", "combo_id"])
    return rank_by_score(apply_thresholds(derive(sums, params.capital), params), ["symbol"], params.top_n)


def evaluate_parts(parts: DataFrame, sets: DataFrame, params: Params) -> DataFrame:
    """Full metrics of the given sets on every part; nothing crosses a part."""
    keys = ["symbol", "part", "combo_id"]
    log = saved(trade_log(parts, params, ("symbol", "part"), sets))
    return trade_metrics(log, keys, params.direction, params.capital, params.chunk_ms).join(
        advanced_metrics(log, keys, params.direction, params.chunk_ms), keys
    )


def screen_and_validate(candles: DataFrame, params: Params) -> tuple[DataFrame, DataFrame]:
    """Screen on the train part, rank, then compare the best sets on train and validation.

    Returns the screened sets, and one row per ranked set with ``train_`` and ``validation_`` metrics (zero without
    trades) and a verdict.
    """
    parts = train_val_split(saved(candles), params.train_ratio)
    screened = saved(screen_grid(parts.where(F.col("part") == "train").drop("part"), params))
    top = rank_by_score(apply_thresholds(screened, params), ["symbol"], params.top_n).select(
        "symbol", "combo_id", "x", "y", "z", "score", "rank"
    )
    detail = evaluate_parts(parts, top.select("symbol", "combo_id", "x", "y", "z"), params)
    measures = [c for c in detail.columns if c not in ("symbol", "part", "combo_id")]
    sides = detail.groupBy("symbol", "combo_id").agg(
        *[
            F.max(F.when(F.col("part") == side, F.col(c))).alias(f"{side}_{c}")
            for side in ("train", "validation")
            for c in measures
        ]
    )
    profit = "total_pnl_percent" if params.direction == "signal-only" else "total_pnl"
    compared = (
        top.join(sides, ["symbol", "combo_id"], "left")
        .fillna(0)
        .withColumn("verdict", verdict(F.col(f"train_{profit}"), F.col(f"validation_{profit}")))
    )
    return screened, compared


def fold_log(candles: DataFrame, params: Params, k: int, sets: DataFrame | None = None) -> DataFrame:
    """Trade log of every fold's train and validation part, with keys ``symbol, fold, part``; nothing crosses a part.

    Exits are searched once, over all candles. A part only changes those that lie beyond its end: they are searched again
    per cut, over the candles from the first such entry to the cut. Moves are taken once over all candles for the train
    parts, which share their start, and once for the validation parts, of which each candle has one at most. Folds then are
    lanes of one walk: what is repeated for each fold are entries, not candles.
    """
    candles = saved(candles)
    cuts = saved(fold_cuts(candles, k))
    moves = saved(entry_moves(candles, params))
    found = saved(entry_exits(candles, params, moves=moves))

    late = join_on(found.select("symbol", "epoch_ms", "exit_ms"), cuts, ["symbol"])
    late = late.select("symbol", "epoch_ms", "exit_ms", F.posexplode("_cuts").alias("cut", "cut_ms"))
    late = saved(late.where("epoch_ms < cut_ms and exit_ms >= cut_ms").select("symbol", "cut", "cut_ms", "epoch_ms").distinct())
    spans = late.groupBy("symbol", "cut", "cut_ms").agg(F.min("epoch_ms").alias("from_ms"))
    near = join_on(candles, spans, ["symbol"]).where("epoch_ms >= from_ms and epoch_ms < cut_ms").drop("from_ms", "cut_ms")
    again = saved(entry_exits(saved(near), params, ("symbol", "cut"), late.select("symbol", "cut", "epoch_ms")))

    # A train part of fold f ends at cut f - 1, its validation part at cut f.
    views = in_folds(found, cuts)
    views = join_on(views, cuts, ["symbol"]).withColumn("cut", (F.col("fold") - F.when(F.col("part") == "train", 1).otherwise(0)).cast("int"))
    views = views.withColumn("_crosses", F.coalesce(F.col("exit_ms") >= F.get("_cuts", F.col("cut")), F.lit(False))).drop("_cuts")
    entry = ["symbol", "fold", "part", "epoch_ms"]
    crossing = views.where("_crosses").select(*entry, "z", "cut")
    crossing = join_on(crossing, again, ["symbol", "cut", "epoch_ms", "z"])
    columns = [*entry, *[c for c in found.columns if c not in ("symbol", "epoch_ms")]]
    exits = saved(views.where(~F.col("_crosses")).select(*columns).unionByName(crossing.select(*columns)))

    train = in_folds(moves, cuts).where("part = 'train'")
    held_out = in_folds(candles, cuts).where("part = 'validation'")
    held_out = entry_moves(held_out, params, ("symbol", "fold", "part"))
    return log_of(saved(train.unionByName(held_out)), exits, params, ("symbol", "fold", "part"), sets)


def kfold_compare(candles: DataFrame, params: Params, k: int) -> DataFrame:
    """One row per symbol, fold and parameter set, with ``train_`` and ``validation_`` metrics (zero without trades) and a verdict."""
    candles = saved(candles)
    log = saved(fold_log(candles, params, k))
    keys = ["symbol", "fold", "part", "combo_id"]
    detail = trade_metrics(log, keys, params.direction, params.capital, params.chunk_ms).join(
        advanced_metrics(log, keys, params.direction, params.chunk_ms), keys
    )
    measures = [c for c in detail.columns if c not in keys]
    sides = detail.groupBy("symbol", "fold", "combo_id").agg(
        *[F.max(F.when(F.col("part") == side, F.col(c))).alias(f"{side}_{c}") for side in ("train", "validation") for c in measures]
    )
    every = symbol_sets(candles, params).withColumn("fold", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(k).cast("long"))))
    profit = "total_pnl_percent" if params.direction == "signal-only" else "total_pnl"
    rows = every.join(sides, ["symbol", "fold", "combo_id"], "left").fillna(0)
    return rows.withColumn("verdict", verdict(F.col(f"train_{profit}"), F.col(f"validation_{profit}")))


def verdict_counts(screened: DataFrame, compared: DataFrame, params: Params) -> DataFrame:
    """Per symbol: sets screened, kept by the thresholds, validated, and how they held up (money plus percent)."""
    train = F.col("train_total_pnl") + F.col("train_total_pnl_percent")
    later = F.col("validation_total_pnl") + F.col("validation_total_pnl_percent")
    held = compared.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("validated"),
        F.count_if((train > 0) & (later > 0)).alias("robust"),
        F.count_if((train > 0) & (later <= 0)).alias("overfit"),
        F.count_if(train <= 0).alias("weak"),
    )
    seen = screened.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("screened"), F.count_if(passes(params)).alias("filtered")
    )
    return seen.join(held, "symbol", "left").fillna(0)
