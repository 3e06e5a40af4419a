"""Holds, horizons, windows and lookbacks longer than a chunk."""

import random
from dataclasses import replace

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_trades import frame, make_candles
from walk import past_close, walk, window_low

from sparktape.operators import asof, exits, horizon, signals
from sparktape.operators import trades as trade_ops
from sparktape.schema import Params

LONG = Params(xs=(1.0, 3.0), ys=(5, 20), zs=(3.0, 25.0), hold_s=200, slip=0.0005, direction="long", chunk_ms=20_000, spans=(3, 4))


@pytest.mark.parametrize("seed, direction, chunk_ms", [(1, "long", 20_000), (2, "short", 7_000), (3, "signal-only", 60_000)])
def test_long_holds_equal_the_walk(spark, seed, direction, chunk_ms):
    data = {"A": make_candles(seed, 300), "B": make_candles(seed + 50, 90, calm=True), "C": make_candles(seed, 1)}
    params = replace(LONG, direction=direction, chunk_ms=chunk_ms)
    log = trade_ops.trade_log(frame(spark, data), params)
    got = rows(log.select("symbol", "x_percent", "y_seconds", "z_percent", "entry_ms", "exit_ms", "reason", "max_price_during_trade", "min_price_during_trade"))
    want = sorted(
        (s, x, y, z, *trade)
        for s, candles in data.items()
        for x in params.xs for y in params.ys for z in params.zs
        for trade in walk(candles, x, y * 1000, z, 200_000, params.slip, direction)
    )
    assert got == want
    assert {r[6] for r in want} == {"drop-z", "max-hold", "end-of-data"}
    far = [r for r in want if r[5] // chunk_ms - r[4] // chunk_ms > 1]
    assert len(far) > 10


def exits_of(spark, candles, params):
    df = frame(spark, {"A": candles}).cache()
    moves = df.select("symbol", "epoch_ms").withColumn("move_0", F.lit(1.0))
    return rows(trade_ops.entry_exits(df, params, moves=moves))


@pytest.mark.parametrize("seed", range(1, 2))
def test_chunk_width_changes_nothing(spark, seed):
    rng = random.Random(seed)
    candles = make_candles(seed, 150, calm=seed % 2 == 0)
    for c in candles:  # missing highs and lows are passed over
        if rng.random() < 0.2:
            c["high"] = c["low"] = float("nan")
    wide = exits_of(spark, candles, replace(LONG, chunk_ms=10**9))
    assert len(wide) == 300
    for chunk_ms in (3_000, 45_000):
        assert exits_of(spark, candles, replace(LONG, chunk_ms=chunk_ms)) == wide


def test_a_task_holds_one_chunk(spark, monkeypatch):
    candles = [{"t": i * 1000, "close": 100.0 + i % 7, "high": 108.0, "low": 99.0} for i in range(400)]
    df = frame(spark, {"A": candles})
    one_chunk, whole = exits._chunk_exits, horizon._first

    def bounded(part, *rest):
        assert part.num_rows <= 20
        return one_chunk(part, *rest)

    def few(queries, below, *rest):
        assert queries.num_rows <= 2 * 21 and below.num_rows <= 20
        return whole(queries, below, *rest)

    monkeypatch.setattr(exits, "_chunk_exits", bounded)
    monkeypatch.setattr(horizon, "_first", few)
    params = replace(LONG, hold_s=250)
    moves = df.select("symbol", "epoch_ms").withColumn("move_0", F.lit(1.0))
    found = trade_ops.entry_exits(df, params, moves=moves).groupBy("z", "reason").count().collect()
    assert sum(r["count"] for r in found) == 800


def test_null_keys_and_gaps(spark):
    schema = "symbol string, epoch_ms long, open double, high double, low double, close double"
    at = [0, 1000, 90_000, 91_000, 400_000, 401_000, 402_000]
    close = [100.0, 102.0, 101.0, None, 99.0, 60.0, 61.0]
    df = spark.createDataFrame([(s, t, p, p, p, p) for s in (None, "A") for t, p in zip(at, close)], schema)
    params = replace(LONG, hold_s=395, zs=(10.0,), direction="signal-only")
    moves = df.where("epoch_ms in (0, 1000, 90000, 402000)").select("symbol", "epoch_ms").withColumn("move_0", F.lit(1.0))
    found = rows(trade_ops.entry_exits(df, params, moves=moves).select("epoch_ms", "exit_ms", "raw_exit", "max_price", "min_price", "reason"))
    want = [(0, 400_000, 99.0, 102.0, 99.0, "max-hold"), (1000, 400_000, 99.0, 102.0, 99.0, "max-hold"), (90_000, 401_000, 60.0, 101.0, 60.0, "drop-z"), (402_000, 402_000, 61.0, 61.0, 61.0, "end-of-data")]
    assert found == sorted(want * 2)
    assert trade_ops.entry_exits(df.limit(0), params, moves=moves.limit(0)).count() == 0


@pytest.mark.parametrize("direction", ["long", "short"])
def test_distant_targets(spark, direction):
    candles = make_candles(5, 250)
    df = frame(spark, {"A": candles, "B": make_candles(6, 40)})
    trades = df.where("epoch_ms % 3000 = 0").select("symbol", (F.col("epoch_ms") - 500).alias("entry_ms"), F.col("close").alias("entry_price"))
    trades = trades.unionByName(spark.createDataFrame([("none", 1000, 5.0), (None, 1000, 5.0)], trades.schema)).cache()
    args = trades, df, [0.5, 4.0, 20.0], 300_000, direction
    found = lambda chunk_ms: sorted(asof.time_to_target(*args, chunk_ms).select("symbol", "entry_ms", "entry_price", "target", "seconds").collect(), key=str)
    wide = found(10**9)
    for chunk_ms in (9_000,):
        assert found(chunk_ms) == wide
    assert len([r for r in wide if r.seconds is not None and r.seconds > 60]) > 20


def test_distant_lookbacks_and_lows(spark):
    candles = make_candles(11, 150)
    df = frame(spark, {"A": candles, "B": make_candles(12, 10)})
    got = {r.epoch_ms: r for r in signals.lookback_closes(df, [5000, 160_000], 7_000).where("symbol = 'A'").collect()}
    lows = {r.epoch_ms: r for r in signals.window_lows(df, 130_000, 7_000).where("symbol = 'A'").collect()}
    assert len(got) == len(lows) == len(candles)
    for i, c in enumerate(candles):
        assert got[c["t"]].past_0 == past_close(candles, i, 5000)
        assert got[c["t"]].past_1 == past_close(candles, i, 160_000)
        assert (lows[c["t"]].low_close, lows[c["t"]].low_ms) == window_low(candles, i, 130_000)


def test_dynamic_log_with_a_long_window(spark):
    data = {"A": make_candles(7, 150), "B": make_candles(8, 60)}
    params = replace(LONG, dynamic_y=True, y_max_s=60)
    log = trade_ops.trade_log(frame(spark, data), params)
    got = rows(log.select("symbol", "x_percent", "z_percent", "entry_ms", "exit_ms", "reason"))
    want = sorted((s, x, z, *t[:3]) for s, c in data.items() for x in params.xs for z in params.zs for t in walk(c, x, 60_000, z, 200_000, params.slip, "long", dynamic=True))
    assert got == want
