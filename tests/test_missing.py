"""Missing prices, NULL keys and trades without candles: nothing wrong, nothing lost."""

import random
from dataclasses import replace
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_trades import CANDLES, P, frame, make_candles
from walk import walk

from sparktape import lineage
from sparktape.operators import asof, metrics, percentiles, posthoc, scans, signals, splits
from sparktape.operators import trades as trade_ops
from sparktape.operators.candles import ohlcv, ohlcv_runs
from sparktape.operators.exits import _chunk_exits


def with_gaps(candles, seed):
    """The candles with some closes, highs and lows missing, and what a walk over them may see."""
    rng = random.Random(seed)
    gappy = [{k: v if k == "t" or rng.random() > 0.15 else None for k, v in c.items()} for c in candles]
    seen = [
        {"t": c["t"], "close": c["close"], "high": -1.0 if c["high"] is None else c["high"], "low": 1e9 if c["low"] is None else c["low"]}
        for c in gappy
        if c["close"] is not None
    ]
    return gappy, seen


@pytest.mark.parametrize("dynamic", [False, True])
@pytest.mark.parametrize("missing", [None, float("nan")])
def test_log_with_missing_prices_equals_the_walk(spark, dynamic, missing):
    gappy, seen = with_gaps(make_candles(4, 220), 9)
    data = [("A", c["t"], 1.0, *(missing if c[k] is None else float(c[k]) for k in ("high", "low", "close"))) for c in gappy]
    params = replace(P, dynamic_y=dynamic, y_max_s=12)
    log = trade_ops.trade_log(spark.createDataFrame(data, CANDLES), params)
    got = rows(log.select("x_percent", "y_seconds", "z_percent", "entry_ms", "exit_ms", "reason", "max_price_during_trade", "min_price_during_trade"))
    want = sorted(
        (x, y, z, *trade)
        for x in params.xs
        for y in ((12,) if dynamic else params.ys)
        for z in params.zs
        for trade in walk(seen, x, y * 1000, z, 15_000, params.slip, "long", dynamic)
    )
    assert got == want and len(want) > 20


def test_window_low_skips_missing_closes(spark):
    data = [("A", i * 1000, 1.0, 1.0, 1.0, c) for i, c in enumerate([100.0, None, 120.0, 130.0])]
    found = signals.window_lows(spark.createDataFrame(data, CANDLES).select("symbol", "epoch_ms", "close"), 60_000, 60_000)
    assert rows(found.select("epoch_ms", "low_close")) == [(0, None), (1000, None), (2000, 100.0), (3000, 100.0)]


def test_sets_limit_the_run(spark):
    candles = frame(spark, {"A": make_candles(1, 150), "B": make_candles(2, 150)})
    every = trade_ops.trade_log(candles, P)
    sets = spark.createDataFrame([("A", 2, 1.0, 5, 6.0), ("B", 7, 3.0, 20, 1.0)], "symbol string, combo_id int, x double, y long, z double")
    own = trade_ops.trade_log(candles, P, sets=sets)
    wanted = every.join(sets.select("symbol", "combo_id"), ["symbol", "combo_id"], "left_semi")
    assert rows(own.select(*every.columns)) == rows(wanted) and own.count() > 5


def test_trades_without_candles_are_kept(spark):
    candles = frame(spark, {"A": make_candles(3, 50)}).select("symbol", "epoch_ms", "close")
    log = spark.createDataFrame(
        [("A", 1000, 100.0), ("A", 10**12, 100.0), ("B", 1000, 100.0), (None, 1000, 100.0), ("A", -(10**9), None)],
        "symbol string, entry_ms long, entry_price double",
    )
    found = asof.time_to_target(log, candles, [0.5, 1.0], 10_000, "long", 20_000)
    assert found.groupBy("symbol", "entry_ms").count().where("count = 2").count() == 5
    stats = posthoc.time_to_target_stats(found, [])
    assert [r.n for r in stats.collect()] == [5, 5]


def test_null_symbols_stay(spark):
    times = spark.createDataFrame([(s, t * 1000) for s in ("A", None) for t in range(12)], "symbol string, epoch_ms long")
    cut = splits.train_val_split(times, 0.75)
    assert rows(cut.groupBy(F.coalesce("symbol", F.lit("-")), "part").count()) == [("-", "train", 9), ("-", "validation", 3), ("A", "train", 9), ("A", "validation", 3)]
    folds = splits.kfold_split(times, 3)
    assert folds.where("symbol is null").count() == folds.where("symbol = 'A'").count() > 0
    values = times.withColumn("v", F.col("epoch_ms").cast("double"))
    assert rows(percentiles.exact_percentiles(values, ["symbol"], "v", [0.5]).select("value")) == [(5500.0,), (5500.0,)]
    sums = scans.running(times, ["symbol"], ["epoch_ms"], F.floor(F.col("epoch_ms") / 5000), [scans.Run("s", "sum", F.lit(1))])
    assert sums.where("symbol is null").agg(F.max("s")).first()[0] == 12
    marks = times.select("symbol", F.col("epoch_ms").alias("t"), F.lit(5.0).alias("v")).where("t = 11000")
    for chunk in (10, 1000, 10**6):
        assert asof.asof_forward(times, marks, ["symbol"], "epoch_ms", "t", "v", chunk).where("v is null").count() == 0


def test_equity_and_runs_do_not_depend_on_chunks(spark):
    rng = random.Random(3)
    log = spark.createDataFrame([(s, i * 1000, rng.uniform(-9, 10)) for s in "AB" for i in range(60)], "symbol string, entry_ms long, pnl double")
    wanted = None
    for chunk in (1000, 7000, 10**9):
        got = [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows(metrics.equity_curve(log, ["symbol"], 100.0, chunk))]
        wanted = wanted or got
        assert got == wanted
    tape = spark.createDataFrame([("A", i, rng.choice([0, 0, 0, 1]) * 1000, float(i), 1.0) for i in range(80)], "symbol string, a long, t long, p double, q double")
    whole = rows(ohlcv_runs(tape, 1000))
    assert all(rows(ohlcv_runs(tape, 1000, arrivals_per_chunk=n)) == whole for n in (1, 3, 10))
    assert sum(r[-1] for r in whole) == 80 and len(whole) > ohlcv(tape).count()


def test_exits_of_a_day_stay_narrow():
    import numpy as np
    import pyarrow as pa

    n = 20_000
    close = 100 + np.cumsum(np.random.default_rng(1).normal(0, 0.05, n))
    table = pa.table({
        "symbol": pa.array(["A"] * n), "epoch_ms": np.arange(n) * 1000, "high": close, "low": close, "close": close,
        "entry_price": close, "is_entry": np.ones(n, bool),
    })
    found = _chunk_exits(table, [0.1, 0.5], 300_000, ["symbol", "epoch_ms", "entry_price"])
    assert found.nbytes / found.num_rows < 80  # so 49 values of z on 86,400 candles stay under 340 MB


def test_scratch_deletes_what_was_saved(spark):
    folder = Path(lineage.shared_folder(spark).removeprefix("file://").removeprefix("file:"))
    before = set(folder.iterdir())
    with lineage.scratch(spark):
        candles = lineage.saved(frame(spark, {"A": make_candles(1, 60)}))
        assert trade_ops.trade_log(candles, P).count() > 0
        assert len(set(folder.iterdir()) - before) >= 3
    assert set(folder.iterdir()) <= before
