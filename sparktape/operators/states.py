"""Metrics of a trade log as states that merge: one stored row per key set and period instead of the log.

A state holds sums and extremes, the shape of the profit curve within its period (its sum, its highest and lowest point and its
largest fall) and its losing streaks (the one it begins with, the one it ends with, the longest). Neighbouring periods merge
to a state of the same form, in any grouping, so months come from days and a longer range from what is stored. Metrics are
read off a state; the log is not needed again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktape.functions.timeops import floor_to
from sparktape.operators.metrics import NO_LOSS_FACTOR, scored_value
from sparktape.operators.scans import join_on

#: Columns of a state that merge by one aggregate.
_SUMS = ["trades", "wins", "losses", "pnl", "pnl_percent", "value", "gain", "loss", "win_sum", "loss_sum", "mae", "mfe", "mae_n", "mfe_n"]
_TOPS, _LOWS = ["best", "max_mae", "max_mfe"], ["worst"]
CURVE = ["top", "bottom", "fall"]
STREAK = ["head", "tail", "longest"]
STATE = [*_SUMS, *_TOPS, *_LOWS, "spread", *CURVE, *STREAK]


def daily_states(log: DataFrame, keys: list[str], direction: str, period_ms: int = 86_400_000) -> DataFrame:
    """One state per key set and period (``period``: its start) in which trades were entered."""
    v = scored_value(direction)
    period = [*keys, "period"]
    along = Window.partitionBy(*period).orderBy("entry_ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = log.withColumns({"period": floor_to(F.col("entry_ms"), period_ms), "_v": v})
    rows = rows.withColumns({"_cum": F.sum("pnl").over(along), "_streak": F.sum((F.col("_v") > 0).cast("long")).over(along)})
    rows = rows.withColumns({"_peak": F.max("_cum").over(along), "_mean": F.avg("_v").over(Window.partitionBy(*period))})
    v, zero = F.col("_v"), F.lit(0.0)
    some = lambda c: F.coalesce(F.sum(c), zero)
    # By streak first - the losses after each win - then by period: one shuffle, as both keys begin alike.
    parts = rows.groupBy(*period, "_streak").agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(v > 0).alias("wins"), F.count_if(v <= 0).alias("losses"),
        F.sum("pnl").alias("pnl"), F.sum("pnl_percent").alias("pnl_percent"), F.sum(v).alias("value"),
        some(F.when(v > 0, v)).alias("gain"), some(F.when(v < 0, v)).alias("loss"), some(F.when(v > 0, v)).alias("win_sum"), some(F.when(v <= 0, v)).alias("loss_sum"),
        some("mae_pct").alias("mae"), some("mfe_pct").alias("mfe"), F.count("mae_pct").alias("mae_n"), F.count("mfe_pct").alias("mfe_n"),
        F.max(v).alias("best"), F.max("mae_pct").alias("max_mae"), F.max("mfe_pct").alias("max_mfe"), F.min(v).alias("worst"),
        F.sum((v - F.col("_mean")) * (v - F.col("_mean"))).alias("spread"), F.max("_cum").alias("top"), F.min("_cum").alias("bottom"), F.max(F.col("_peak") - F.col("_cum")).alias("fall"),
    )
    return parts.groupBy(*period).agg(
        *_plain(), F.sum("spread").alias("spread"), F.max("top").alias("top"), F.min("bottom").alias("bottom"), F.max("fall").alias("fall"),
        F.coalesce(F.max(F.when(F.col("_streak") == 0, F.col("losses"))), F.lit(0)).alias("head"),
        F.max_by("losses", "_streak").alias("tail"), F.max("losses").alias("longest"),
    )


def _plain() -> list[Column]:
    """Merged sums and extremes, as aggregates over states."""
    return [*[F.sum(c).alias(c) for c in _SUMS], *[F.max(c).alias(c) for c in _TOPS], *[F.min(c).alias(c) for c in _LOWS]]


def merge_states(states: DataFrame, keys: list[str], period_ms: int | None = None) -> DataFrame:
    """States of longer periods, each a multiple of the stored ones; of the whole range where ``period_ms`` is not given.

    A window runs over the periods of one key set that merge into one, never over trades.
    """
    to = floor_to(F.col("period"), period_ms) if period_ms else F.min("period").over(Window.partitionBy(*keys))
    rows = states.withColumn("_to", to)
    group = [*keys, "_to"]
    before = Window.partitionBy(*group).orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {"_start": F.coalesce(F.sum("pnl").over(before), F.lit(0.0)), "_streak": F.coalesce(F.sum((F.col("wins") > 0).cast("long")).over(before), F.lit(0))}
    )
    rows = rows.withColumn("_high", F.max(F.col("_start") + F.col("top")).over(before))
    fall = F.greatest("fall", F.col("_high") - (F.col("_start") + F.col("bottom")))
    every = Window.partitionBy(*group)
    off = F.col("value") / F.col("trades") - F.sum("value").over(every) / F.sum("trades").over(every)
    rows = rows.withColumn("spread", F.col("spread") + F.col("trades") * off * off)
    # A period's first streak goes on with the one before it; a period with a win ends that and begins another.
    runs = F.array(F.struct(F.col("_streak").alias("at"), F.col("head").alias("n")), F.when(F.col("wins") > 0, F.struct((F.col("_streak") + 1).alias("at"), F.col("tail").alias("n"))))
    streaks = rows.select(*group, F.inline(F.array_compact(runs))).groupBy(*group, "at").agg(F.sum("n").alias("n")).groupBy(*group).agg(
        F.coalesce(F.max(F.when(F.col("at") == 0, F.col("n"))), F.lit(0)).alias("head"), F.max_by("n", "at").alias("tail"), F.max("n").alias("_across")
    )
    whole = rows.groupBy(*group).agg(
        *_plain(), F.sum("spread").alias("spread"), F.max(F.col("_start") + F.col("top")).alias("top"),
        F.min(F.col("_start") + F.col("bottom")).alias("bottom"), F.max(fall).alias("fall"), F.max("longest").alias("longest"),
    )
    merged = join_on(whole, streaks, group).withColumn("longest", F.greatest("longest", "_across"))
    return merged.select(*keys, F.col("_to").alias("period"), *STATE)


def state_metrics(states: DataFrame, keys: list[str], capital: float) -> DataFrame:
    """The columns of ``trade_metrics`` and ``advanced_metrics`` from one state per key set."""
    c, zero = F.col, F.lit(0.0)
    ratio = lambda part, n: F.when(c(n) > 0, c(part) / c(n))
    loss, std = F.abs("loss"), F.sqrt(c("spread") / c("trades"))
    share, mean = c("wins") / c("trades"), c("value") / c("trades")
    win, lost = F.round(F.coalesce(ratio("win_sum", "wins"), zero), 6), F.round(F.coalesce(ratio("loss_sum", "losses"), zero), 6)
    return states.select(
        *keys, c("trades").alias("total_trades"), c("wins").alias("winning_trades"), c("losses").alias("losing_trades"),
        c("pnl").alias("total_pnl"), c("pnl_percent").alias("total_pnl_percent"), mean.alias("average_pnl"), c("best").alias("best_trade"), c("worst").alias("worst_trade"),
        F.when(loss == 0, F.when(c("gain") > 0, F.lit(NO_LOSS_FACTOR)).otherwise(zero)).otherwise(c("gain") / loss).alias("profit_factor"),
        F.round(ratio("mae", "mae_n"), 4).alias("avg_mae"), F.round("max_mae", 4).alias("max_mae"), F.round(ratio("mfe", "mfe_n"), 4).alias("avg_mfe"), F.round("max_mfe", 4).alias("max_mfe"),
        (c("fall") / F.lit(float(capital)) * 100.0).alias("max_drawdown"), (share * 100.0).alias("win_rate"),
        F.round(F.when(std > 1e-9 * F.abs(mean), mean / std).otherwise(zero), 4).alias("sharpe_ratio"), F.round(share * win + (1 - share) * lost, 6).alias("expectancy"),
        win.alias("avg_win"), lost.alias("avg_loss"), c("longest").alias("max_consecutive_losses"),
    )
