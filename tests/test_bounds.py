"""Ranking drops sets that cannot have enough trades before it looks for their exits."""

from dataclasses import replace

from conftest import rows
from pyspark.sql import functions as F
from test_trades import P, frame, make_candles

from sparktape.operators.screening import apply_thresholds, rank_by_score
from sparktape.operators.trades import entry_moves
from sparktape.plans import runs

BOUND = replace(P, xs=(1.0, 3.0, 8.0, 400.0), min_trades=8, min_win_rate=0.0, min_profit_factor=0.0, max_drawdown=100.0, top_n=50)


def test_ranking_is_that_of_all_sets(spark):
    df = frame(spark, {"A": make_candles(1, 200), "B": make_candles(2, 40), "C": make_candles(3, 2)}).cache()
    for params in (BOUND, replace(BOUND, dynamic_y=True, y_max_s=12)):
        got = runs.screen_and_rank(df, params)
        want = rank_by_score(apply_thresholds(runs.screen_grid(df, params), params), ["symbol"], params.top_n)
        assert rows(got.select("symbol", "rank", "combo_id", "score", "total_trades")) == rows(want.select("symbol", "rank", "combo_id", "score", "total_trades"))
        assert got.count() > 0


def test_fewer_entries_and_sets_are_walked(spark):
    df = frame(spark, {"A": make_candles(1, 200), "B": make_candles(2, 40)})
    moves = entry_moves(df, BOUND).cache()
    sets = runs.able_sets(moves, df, BOUND)
    every = runs.symbol_sets(df, BOUND).count()
    counts = {(r.symbol, r.x, r.y): r.signals for r in runs.signal_counts(moves, BOUND).collect()}
    for (symbol, x, y), n in counts.items():
        i = sorted(BOUND.ys).index(y)
        assert n == moves.where((F.col("symbol") == symbol) & (F.col(f"move_{i}") >= x)).count()
    assert {(r.symbol, r.x, r.y) for r in sets.collect()} == {k for k, n in counts.items() if n >= BOUND.min_trades}
    assert sets.count() <= every / 2
    few = runs.able_moves(moves, sets.where("x >= 3"), BOUND)
    assert 0 < few.count() < moves.count()
