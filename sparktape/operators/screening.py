"""Grid screening: accumulators per parameter set, derived figures, thresholds and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktape.operators.metrics import NO_LOSS_FACTOR, scored_value
from sparktape.schema import Params


def screen(
    trades: DataFrame, keys: list[str], direction: str, all_keys: DataFrame | None = None, dynamic_y: bool = False
) -> DataFrame:
    """Eight sums per key set (nine with dynamic lookback). For signal-only the money columns hold percents."""
    v = scored_value(direction)
    sums = [
        F.count(F.lit(1)).alias("total_trades"),
        F.count_if(v > 0).alias("winning_trades"),
        F.count_if(v <= 0).alias("losing_trades"),
        F.sum(v).alias("total_pnl"),
        F.coalesce(F.sum(F.when(v > 0, v)), F.lit(0.0)).alias("gross_profit"),
        F.coalesce(F.sum(F.when(v <= 0, v)), F.lit(0.0)).alias("gross_loss"),
        F.max(v).alias("best_trade"),
        F.min(v).alias("worst_trade"),
    ]
    if dynamic_y:
        sums.append(F.round(F.avg("y_actual_seconds"), 2).alias("avg_y_actual"))
    rows = trades.groupBy(*keys).agg(*sums)
    return rows if all_keys is None else all_keys.join(rows, keys, "left").fillna(0)


def derive(screened: DataFrame, capital: float) -> DataFrame:
    """Rates, ratios and proxies from the accumulators, rounded."""
    c = F.col
    n, spread = c("total_trades"), c("best_trade") - c("worst_trade")
    win_rate = F.when(n > 0, c("winning_trades") / n * 100.0).otherwise(0.0)
    factor = F.when(c("gross_loss") != 0, c("gross_profit") / F.abs("gross_loss")).otherwise(
        F.when(c("gross_profit") > 0, NO_LOSS_FACTOR).otherwise(0.0)
    )
    avg_win = F.when(c("winning_trades") > 0, c("gross_profit") / c("winning_trades")).otherwise(0.0)
    avg_loss = F.when(c("losing_trades") > 0, c("gross_loss") / c("losing_trades")).otherwise(0.0)
    share = win_rate / 100.0
    # The spread of results counts as four deviations, one if there is no spread.
    deviation = F.when(spread > 0, spread / 4.0).otherwise(1.0)
    money = ("total_pnl", "gross_profit", "gross_loss", "best_trade", "worst_trade")
    others = [x for x in screened.columns if x not in money]
    return screened.select(
        *others,
        *[F.round(x, 6).alias(x) for x in money],
        F.round(win_rate, 2).alias("win_rate"),
        F.round(factor, 4).alias("profit_factor"),
        F.round(avg_win, 6).alias("avg_win"),
        F.round(avg_loss, 6).alias("avg_loss"),
        F.round(share * avg_win - (1 - share) * F.abs(avg_loss), 6).alias("expectancy"),
        F.round(F.abs(c("worst_trade")) / F.lit(float(capital)) * 100.0, 4).alias("max_drawdown"),
        F.round(F.when(n > 1, c("total_pnl") / n / deviation).otherwise(0.0), 4).alias("sharpe_ratio"),
    )


def score() -> Column:
    # Weights of the composite score and the cap on the profit factor.
    return F.round(
        F.col("total_pnl") * 0.4
        + F.least(F.col("profit_factor"), F.lit(10.0)) * 0.3
        + F.col("win_rate") / 100.0 * 0.2
        - F.col("max_drawdown") * 0.3,
        6,
    )


def passes(params: Params) -> Column:
    if params.skip_filters:
        return F.lit(True)
    return (
        (F.col("total_trades") >= params.min_trades)
        & (F.col("win_rate") >= params.min_win_rate)
        & (F.col("profit_factor") >= params.min_profit_factor)
        & (F.col("max_drawdown") <= params.max_drawdown)
    )


def apply_thresholds(derived: DataFrame, params: Params) -> DataFrame:
    return derived.where(passes(params))


def filter_funnel(derived: DataFrame, params: Params, keys: list[str]) -> DataFrame:
    return (
        derived.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("before"), F.count_if(passes(params)).alias("after"))
        .withColumn("removed", F.col("before") - F.col("after"))
        .withColumn("removed_pct", F.round(F.col("removed") / F.col("before") * 100.0, 1))
    )


def rank_by_score(derived: DataFrame, keys: list[str], top_n: int) -> DataFrame:
    """The best sets per key by score, numbered from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "combo_id")
    return (
        derived.withColumn("score", score())
        .withColumn("rank", F.row_number().over(order).cast("long"))
        .where(F.col("rank") <= top_n)
    )


def top_by_profit(metrics: DataFrame, keys: list[str], direction: str, top_n: int) -> DataFrame:
    """Sets with trades first, then by profit; numbered from 1 per key.

    Profits are compared at six places, so that sets with the same trades tie whatever order their sums ran in.
    """
    profit = F.round("total_pnl_percent" if direction == "signal-only" else "total_pnl", 6)
    order = Window.partitionBy(*keys).orderBy(F.desc(F.col("total_trades") > 0), F.desc(profit), "combo_id")
    return metrics.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top_n)


def verdict(train_profit: Column, validation_profit: Column) -> Column:
    return (
        F.when(train_profit <= 0, "WEAK").when(validation_profit > 0, "ROBUST").otherwise("OVERFIT")
    )


def summary_rows(metrics: DataFrame, sets: DataFrame) -> DataFrame:
    """Metrics of every parameter set, rounded for the summary table."""
    # Decimal places per summary column.
    places = {
        "win_rate": 2,
        "total_pnl": 4,
        "total_pnl_percent": 4,
        "max_drawdown": 4,
        "average_pnl": 4,
        "best_trade": 4,
        "worst_trade": 4,
        "profit_factor": 4,
    }
    counts = ["total_trades", "winning_trades", "losing_trades"]
    return metrics.join(sets, "combo_id").select(
        "symbol", "combo_id", "x", "y", "z", *counts, *[F.round(c, p).alias(c) for c, p in places.items()]
    )
