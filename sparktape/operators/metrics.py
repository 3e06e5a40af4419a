"""Performance of a trade log per key set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktape.functions.timeops import floor_to
from sparktape.lineage import saved
from sparktape.operators.scans import Run, join_on, running

# Profit factor reported when nothing was lost, per report.
NO_LOSS_FACTOR = 999.99
NO_LOSS_FACTOR_POSTHOC = 999.0


def scored_value(direction: str) -> Column:
    """What wins and losses are counted on."""
    return F.col("pnl_percent" if direction == "signal-only" else "pnl")


def _ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole != 0, part / whole).otherwise(F.lit(empty))


def max_drawdown(df: DataFrame, keys: list[str], value: str, capital: float, chunk_ms: int, order: str = "entry_ms") -> DataFrame:
    """Largest fall of ``capital + running sum`` from its peak (``dd_u``) and in percent of capital (``dd_p``).

    The peak starts at the first trade. Each chunk yields its sum, top, bottom and own drawdown; the fall across
    chunks follows from those.
    """
    here = (
        Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = (
        df.select(*keys, order, F.col(value).alias("_v"), floor_to(F.col(order), chunk_ms).alias("_chunk"))
        .withColumn("_cum", F.sum("_v").over(here))
        .withColumn("_peak", F.max("_cum").over(here))
        .groupBy(*keys, "_chunk")
        .agg(
            F.sum("_v").alias("_sum"),
            F.max("_cum").alias("_top"),
            F.min("_cum").alias("_bottom"),
            F.max(F.col("_peak") - F.col("_cum")).alias("_dd"),
        )
        .withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)))
        .withColumn("_high", F.max(F.col("_start") + F.col("_top")).over(before))
    )
    fall = F.greatest(F.col("_dd"), F.col("_high") - (F.col("_start") + F.col("_bottom")))
    return (
        chunks.groupBy(*keys)
        .agg(F.max(fall).alias("dd_u"))
        .withColumn("dd_p", F.col("dd_u") / F.lit(float(capital)) * 100.0)
    )


def equity_curve(df: DataFrame, keys: list[str], capital: float, chunk_ms: int, value: str = "pnl") -> DataFrame:
    """Add ``equity, peak, drawdown`` per trade in entry order.

    Each chunk yields its sum and its top, which give both what the curve and what the peak carry into the next ones.
    """
    here = (
        Window.partitionBy(*keys, "_chunk").orderBy("entry_ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    local = (
        df.withColumn("_chunk", floor_to(F.col("entry_ms"), chunk_ms))
        .withColumn("_cum", F.sum(value).over(here))
        .withColumn("_top", F.max("_cum").over(here))
    )
    local = saved(local)
    carry = (
        local.groupBy(*keys, "_chunk")
        .agg(F.sum(value).alias("_sum"), F.max("_cum").alias("_most"))
        .withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)))
        .withColumn("_high", F.max(F.col("_start") + F.col("_most")).over(before))
    )
    rows = join_on(local, saved(carry.select(*keys, "_chunk", "_start", "_high")), [*keys, "_chunk"], "left")
    rows = rows.withColumn("equity", F.lit(float(capital)) + (F.col("_start") + F.col("_cum")))
    rows = rows.withColumn("peak", F.lit(float(capital)) + F.greatest("_high", F.col("_start") + F.col("_top")))
    return rows.select(*df.columns, "equity", "peak", (F.col("peak") - F.col("equity")).alias("drawdown"))


def loss_streak(df: DataFrame, keys: list[str], value: Column, chunk_ms: int) -> DataFrame:
    """Longest run of trades without a win; a zero counts as a loss."""
    rows = df.select(*keys, "entry_ms", (value > 0).cast("long").alias("_win"))
    rows = running(
        rows, keys, ["entry_ms"], floor_to(F.col("entry_ms"), chunk_ms), [Run("_wins", "sum", F.col("_win"))]
    )
    runs = rows.groupBy(*keys, "_wins").agg(F.sum(1 - F.col("_win")).alias("_len"))
    return runs.groupBy(*keys).agg(F.max("_len").alias("max_consecutive_losses"))


def profit_factor(value: Column, cap: float = NO_LOSS_FACTOR) -> Column:
    """Sum of gains over sum of losses, as an aggregate."""
    gain = F.coalesce(F.sum(F.when(value > 0, value)), F.lit(0.0))
    loss = F.abs(F.coalesce(F.sum(F.when(value < 0, value)), F.lit(0.0)))
    return F.when(loss == 0, F.when(gain > 0, F.lit(cap)).otherwise(0.0)).otherwise(gain / loss)


def trade_metrics(
    trades: DataFrame,
    keys: list[str],
    direction: str,
    capital: float,
    chunk_ms: int,
    all_keys: DataFrame | None = None,
) -> DataFrame:
    """Counts, totals, extremes, drawdown, profit factor and excursions per key set.

    ``all_keys`` adds a zero row for key sets without trades.
    """
    value = scored_value(direction)
    totals = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_trades"),
        F.count_if(value > 0).alias("winning_trades"),
        F.count_if(value <= 0).alias("losing_trades"),
        F.sum("pnl").alias("total_pnl"),
        F.sum("pnl_percent").alias("total_pnl_percent"),
        F.avg(value).alias("average_pnl"),
        F.max(value).alias("best_trade"),
        F.min(value).alias("worst_trade"),
        profit_factor(value).alias("profit_factor"),
        F.round(F.avg("mae_pct"), 4).alias("avg_mae"),
        F.round(F.max("mae_pct"), 4).alias("max_mae"),
        F.round(F.avg("mfe_pct"), 4).alias("avg_mfe"),
        F.round(F.max("mfe_pct"), 4).alias("max_mfe"),
    )
    falls = max_drawdown(trades, keys, "pnl", capital, chunk_ms).select(*keys, F.col("dd_p").alias("max_drawdown"))
    rows = totals.join(falls, keys).withColumn(
        "win_rate", F.col("winning_trades") / F.col("total_trades") * 100.0
    )
    if all_keys is not None:
        rows = all_keys.join(rows, keys, "left").fillna(0)
    return rows


def posthoc_metrics(trades: DataFrame, keys: list[str], pnl: str, capital: float, chunk_ms: int) -> DataFrame:
    """Metrics of one profit column; key sets without trades are absent."""
    v = F.col(pnl)
    win, loss = F.when(v > 0, v), F.when(v <= 0, v)
    rows = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(win).alias("nw"),
        F.count(loss).alias("nl"),
        F.coalesce(F.avg(win), F.lit(0.0)).alias("avg_w"),
        F.coalesce(F.avg(loss), F.lit(0.0)).alias("avg_l"),
        F.coalesce(F.sum(win), F.lit(0.0)).alias("gp"),
        F.coalesce(F.sum(loss), F.lit(0.0)).alias("gl"),
        F.sum(v).alias("total"),
        F.max(v).alias("best"),
        F.min(v).alias("worst"),
    )
    rows = rows.join(max_drawdown(trades, keys, pnl, capital, chunk_ms), keys)
    wr = F.col("nw") / F.col("n") * 100.0
    return rows.select(
        "*",
        wr.alias("wr"),
        F.when(F.col("gl") < 0, F.col("gp") / F.abs("gl"))
        .otherwise(F.when(F.col("gp") > 0, F.lit(NO_LOSS_FACTOR_POSTHOC)).otherwise(0.0))
        .alias("pf"),
        (wr / 100.0 * F.col("avg_w") + (1 - wr / 100.0) * F.col("avg_l")).alias("expect"),
    )


def break_even(metrics: DataFrame, size: float) -> DataFrame:
    """Win rate needed to break even, on :func:`posthoc_metrics`; ``loss_win_ratio`` is NULL for no average win."""
    ratio = F.when(F.col("avg_w") > 0, F.abs("avg_l") / F.col("avg_w"))
    return (
        metrics.withColumn("loss_win_ratio", ratio)
        .withColumn(
            "break_even_wr",
            F.coalesce(F.col("loss_win_ratio") / (1.0 + F.col("loss_win_ratio")) * 100.0, F.lit(100.0)),
        )
        .withColumn("gap", F.col("wr") - F.col("break_even_wr"))
        .withColumn("losing", F.col("gap") < 0)
        .withColumn("worst_pct_of_size", F.abs("worst") / F.lit(float(size)) * 100.0)
    )


def advanced_metrics(trades: DataFrame, keys: list[str], direction: str, chunk_ms: int) -> DataFrame:
    """Sharpe ratio, average win and loss, expectancy (on the rounded averages) and the longest losing streak."""
    v = scored_value(direction)
    std = F.col("_std")
    rows = trades.groupBy(*keys).agg(
        F.avg(v).alias("_mean"),
        F.stddev_pop(v).alias("_std"),
        F.round(F.coalesce(F.avg(F.when(v > 0, v)), F.lit(0.0)), 6).alias("avg_win"),
        F.round(F.coalesce(F.avg(F.when(v <= 0, v)), F.lit(0.0)), 6).alias("avg_loss"),
        (F.count_if(v > 0) / F.count(F.lit(1))).alias("_share"),
    )
    rows = rows.join(loss_streak(trades, keys, v, chunk_ms), keys)
    return rows.select(
        *keys,
        F.round(F.when(std > 0, F.col("_mean") / std).otherwise(0.0), 4).alias("sharpe_ratio"),
        F.round(F.col("_share") * F.col("avg_win") + (1 - F.col("_share")) * F.col("avg_loss"), 6).alias(
            "expectancy"
        ),
        "avg_win",
        "avg_loss",
        "max_consecutive_losses",
    )
