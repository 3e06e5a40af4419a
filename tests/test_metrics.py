import random
import statistics

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from sparktape.operators import metrics, percentiles, posthoc, screening
from sparktape.operators import trades as trade_ops
from sparktape.schema import Params

LOG = (
    "symbol string, combo_id int, entry_ms long, pnl double, pnl_percent double, fees double, entry_price double, "
    "max_price_during_trade double, min_price_during_trade double, reason string, mae_pct double, mfe_pct double"
)


def log(spark, pnls, symbol="S", combo=1):
    data = [
        (symbol, combo, i * 1000, float(p), float(p), 0.2, 100.0, 100.0 + abs(p), 100.0 - abs(p),
         "drop-z" if i % 2 else "max-hold", abs(p) * 1.0, abs(p) * 2.0)
        for i, p in enumerate(pnls)
    ]
    return spark.createDataFrame(data, LOG)


KEYS = ["symbol", "combo_id"]


def test_small_example(spark):
    m = metrics.posthoc_metrics(log(spark, [10, -5, 20]), KEYS, "pnl", 1000.0, 10_000).first()
    assert (m.n, m.nw, m.nl, round(m.wr, 2), m.total) == (3, 2, 1, 66.67, 25.0)
    assert (m.avg_w, m.avg_l, m.pf, m.dd_u, m.dd_p) == (15.0, -5.0, 6.0, 5.0, 0.5)
    assert metrics.posthoc_metrics(log(spark, [1]).limit(0), KEYS, "pnl", 1000.0, 10_000).count() == 0


@pytest.mark.parametrize("value,rate,factor", [(1, 100.0, 999.99), (-1, 0.0, 0.0)])
def test_all_win_all_lose(spark, value, rate, factor):
    m = metrics.trade_metrics(log(spark, [value] * 5), KEYS, "long", 1000.0, 2000).first()
    assert (m.total_trades, m.win_rate, m.profit_factor) == (5, rate, factor)
    p = metrics.posthoc_metrics(log(spark, [value] * 5), KEYS, "pnl", 1000.0, 2000).first()
    assert p.pf == (999.0 if value > 0 else 0.0)


def test_sets_without_trades_get_zero_rows(spark):
    sets = spark.createDataFrame([("S", 1), ("S", 2)], "symbol string, combo_id int")
    got = metrics.trade_metrics(log(spark, [1, 2]), KEYS, "long", 1000.0, 2000, sets).orderBy("combo_id").collect()
    assert got[1].total_trades == 0 and got[1].win_rate == 0.0 and got[1].max_drawdown == 0.0
    sums = screening.screen(log(spark, [1, 2]), KEYS, "long", sets).orderBy("combo_id").collect()
    assert (sums[1].total_trades, sums[1].best_trade) == (0, 0.0)


def test_drawdown_and_streak_do_not_depend_on_chunks(spark):
    rng = random.Random(9)
    pnls = [rng.choice([-3.0, -1.0, 0.0, 2.0, 4.0]) for _ in range(60)]
    equity = np.cumsum(pnls)
    fall = float(np.max(np.maximum.accumulate(equity) - equity))
    longest = run = 0
    for p in pnls:
        run = run + 1 if p <= 0 else 0
        longest = max(longest, run)
    for chunk in (1000, 7000, 10**6):
        df = log(spark, pnls)
        assert metrics.max_drawdown(df, KEYS, "pnl", 1000.0, chunk).first().dd_u == fall
        assert metrics.loss_streak(df, KEYS, F.col("pnl"), chunk).first().max_consecutive_losses == longest
        curve = metrics.equity_curve(df, KEYS, 1000.0, chunk).orderBy("entry_ms").collect()
        assert [r.equity for r in curve] == [1000.0 + e for e in equity]
        assert max(r.drawdown for r in curve) == fall


def test_first_losing_trade_shows_no_drawdown(spark):
    assert metrics.max_drawdown(log(spark, [-5, 1]), KEYS, "pnl", 1000.0, 1000).first().dd_u == 0.0


def test_advanced(spark):
    pnls = [3.0, -1.0, 0.0, 2.0, -2.0]
    m = metrics.advanced_metrics(log(spark, pnls), KEYS, "long", 2000).first()
    assert m.sharpe_ratio == round(statistics.fmean(pnls) / statistics.pstdev(pnls), 4)
    assert (m.avg_win, m.avg_loss, m.expectancy, m.max_consecutive_losses) == (2.5, -1.0, 0.4, 2)


def test_break_even(spark):
    m = metrics.posthoc_metrics(log(spark, [10, -5, 20]), KEYS, "pnl", 1000.0, 10_000)
    b = metrics.break_even(m, 100.0).first()
    assert (round(b.loss_win_ratio, 4), round(b.break_even_wr, 2), b.losing, b.worst_pct_of_size) == (0.3333, 25.0, False, 5.0)
    none = metrics.break_even(metrics.posthoc_metrics(log(spark, [-1]), KEYS, "pnl", 1000.0, 10_000), 100.0).first()
    assert (none.loss_win_ratio, none.break_even_wr) == (None, 100.0)


def test_screening_chain(spark):
    df = log(spark, [10, -5, 20]).unionByName(log(spark, [-1, -2], combo=2))
    derived = screening.derive(screening.screen(df, KEYS, "long"), 1000.0)
    one = derived.where("combo_id = 1").first()
    assert (one.win_rate, one.profit_factor, one.avg_win, one.avg_loss) == (66.67, 6.0, 15.0, -5.0)
    assert (one.max_drawdown, one.sharpe_ratio) == (0.5, round(25 / 3 / 6.25, 4))
    params = Params(min_trades=3, min_win_rate=50.0, min_profit_factor=1.0, max_drawdown=5.0)
    assert rows(screening.apply_thresholds(derived, params).select("combo_id")) == [(1,)]
    assert rows(screening.filter_funnel(derived, params, ["symbol"])) == [("S", 2, 1, 1, 50.0)]
    ranked = screening.rank_by_score(derived, ["symbol"], 1).first()
    assert ranked.combo_id == 1 and ranked["rank"] == 1
    assert ranked.score == round(25 * 0.4 + 6 * 0.3 + 0.6667 * 0.2 - 0.5 * 0.3, 6)
    assert screening.apply_thresholds(derived, Params(skip_filters=True)).count() == 2


def test_verdicts(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, -1.0), (0.0, 5.0)], "t double, v double")
    assert [r[0] for r in df.select(screening.verdict(F.col("t"), F.col("v"))).collect()] == ["ROBUST", "OVERFIT", "WEAK"]


@pytest.mark.parametrize("bins", [1, 2, 64])
def test_percentiles_are_exact(spark, bins):
    rng = random.Random(2)
    data = [("a", rng.choice([1.0, 2.0, rng.random() * 10])) for _ in range(200)] + [("b", 5.0), ("b", None)]
    df = spark.createDataFrame(data, "k string, v double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {(r.k, r.prob): r.value for r in percentiles.exact_percentiles(df, ["k"], "v", probs, bins).collect()}
    for p in probs:
        assert got["a", p] == pytest.approx(np.quantile([v for k, v in data if k == "a"], p))
        assert got["b", p] == 5.0


def test_stop_levels(spark):
    df = log(spark, [3, -4, 8])
    out = trade_ops.stoploss(df, [5.0], 100.0, "long").orderBy("entry_ms").collect()
    assert [r.sl_triggered for r in out] == [False, False, True]
    assert [round(r.new_pnl, 6) for r in out] == [3.0, -4.0, -5.2]
    impact = posthoc.stoploss_impact(df, KEYS, [2.0, 5.0, 50.0], Params(direction="long"), "long").orderBy("level").collect()
    assert [(r.level, r.triggered, r.cut_winners, r.saved_losers) for r in impact] == [
        (2.0, 3, 2, 1), (5.0, 1, 1, 0), (50.0, 0, 0, 0)
    ]
    assert impact[2].d_pnl == 0.0 and impact[2].d_dd_p == 0.0
    best = posthoc.stoploss_best(spark.createDataFrame(impact), KEYS).first()
    assert best.best_pnl_level == 50.0


def test_profile(spark):
    df = posthoc.with_excursions(log(spark, [5, -10]), "long")
    assert rows(df.select("mae_pct", "mfe_pct", "mfe_gt_mae", "quality")) == [(5.0, 5.0, False, 0.5), (10.0, 10.0, False, 0.5)]
    assert rows(posthoc.exit_reasons(df, KEYS).select("reason", "n", "pct")) == [("drop-z", 1, 50.0), ("max-hold", 1, 50.0)]
    held = posthoc.maxhold_percentiles(df, KEYS).first()
    assert (held.n, held.with_mfe, held.mae_p50, held.mae_max) == (1, 1, 5.0, 5.0)
    assert posthoc.quality_report(df, KEYS).first().band == "mostly-for"
