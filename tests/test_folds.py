"""Trade logs of folds: exits are searched once and cut at the folds' ends, as if every part had been walked alone."""

from dataclasses import replace

import pytest
from conftest import rows
from test_trades import P, frame, make_candles
from walk import walk

from sparktape.operators import exits, splits
from sparktape.plans import runs


@pytest.mark.parametrize("hold_s, chunk_ms", [(15, 20_000), (400, 30_000)])
def test_fold_log_walks_each_part_alone(spark, hold_s, chunk_ms):
    data = {"A": make_candles(1, 140), "B": make_candles(51, 60, calm=True)}
    params = replace(P, hold_s=hold_s, chunk_ms=chunk_ms, xs=(1.0,), ys=(5,), zs=(3.0, 25.0))
    df = frame(spark, data)
    parts = {}
    for r in splits.kfold_split(df, 3).orderBy("epoch_ms").collect():
        parts.setdefault((r.symbol, r.fold, r.part), []).append({"t": r.epoch_ms, "close": r.close, "high": r.high, "low": r.low})
    want = sorted(
        (*key, x, y, z, *trade)
        for key, candles in parts.items()
        for x in params.xs for y in params.ys for z in params.zs
        for trade in walk(candles, x, y * 1000, z, hold_s * 1000, params.slip, "long")
    )
    log = runs.fold_log(df, params, 3)
    got = rows(log.select("symbol", "fold", "part", "x_percent", "y_seconds", "z_percent", "entry_ms", "exit_ms", "reason", "max_price_during_trade", "min_price_during_trade"))
    assert got == want
    ends = {key: candles[-1]["t"] for key, candles in parts.items()}
    assert sum(w[7] == ends[w[:3]] and w[8] == "end-of-data" for w in want) > 5


def test_exits_are_searched_once(spark, monkeypatch):
    df = frame(spark, {"A": make_candles(3, 300, gaps=False)})
    searched, whole = [], exits._chunk_exits
    counted = spark.sparkContext.accumulator(0)

    def counting(part, *rest):
        counted.add(part.num_rows)
        return whole(part, *rest)

    monkeypatch.setattr(exits, "_chunk_exits", counting)
    params = replace(P, hold_s=5, chunk_ms=50_000, xs=(1.0,), zs=(3.0,))
    runs.fold_log(df, params, 5).count()
    # All candles with their halos once, and the few before each cut; five folds of growing parts would be about 900.
    assert 300 <= counted.value < 400, searched


def test_kfold_compare_has_every_set(spark):
    df = frame(spark, {"A": make_candles(1, 150), "B": make_candles(2, 60)})
    params = replace(P, xs=(1.0,), ys=(5,))
    found = runs.kfold_compare(df, params, 2).collect()
    assert len(found) == 2 * 2 * len(P.zs)
    assert {r.verdict for r in found} <= {"ROBUST", "OVERFIT", "WEAK"} and all(r.train_total_trades is not None for r in found)
    with pytest.raises(Exception, match="k must be"):
        runs.kfold_compare(df, P, 1)
