import random
from dataclasses import replace

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from walk import past_close, walk, window_low

from sparktape.operators import asof, nonoverlap, scans, signals
from sparktape.operators import trades as trade_ops
from sparktape.plans import runs
from sparktape.schema import Params

CANDLES = "symbol string, epoch_ms long, open double, high double, low double, close double"


def make_candles(seed, n, step_ms=1000, gaps=True, calm=False):
    rng = random.Random(seed)
    out, t, price = [], 0, 100.0
    for _ in range(n):
        t += step_ms * (rng.choice([1, 1, 1, 2, 3, 40]) if gaps else 1)
        price = round(max(0.5, price * (1 + rng.uniform(-0.02, 0.02 if calm else 0.025))), 2)
        spread = rng.uniform(0, 0.01) * price
        out.append({"t": t, "close": price, "high": round(price + spread, 2), "low": round(price - spread, 2)})
    return out


def frame(spark, by_symbol):
    data = [
        (s, c["t"], c["close"], float(c["high"]), float(c["low"]), float(c["close"]))
        for s, candles in by_symbol.items()
        for c in candles
    ]
    return spark.createDataFrame(data, CANDLES)


P = Params(xs=(1.0, 3.0), ys=(5, 20), zs=(1.0, 6.0), hold_s=15, slip=0.0005, direction="long", chunk_ms=20_000)


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("direction", ["long", "short", "signal-only"])
def test_trade_log_equals_the_walk(spark, seed, direction):
    data = {"A": make_candles(seed, 150), "B": make_candles(seed + 50, 60)}
    params = replace(P, direction=direction, spans=(3, 2) if seed == 1 else () if seed == 2 else (32,))
    log = trade_ops.trade_log(frame(spark, data), params)
    got = rows(
        log.select(
            "symbol", "x_percent", "y_seconds", "z_percent", "entry_ms", "exit_ms", "reason",
            "max_price_during_trade", "min_price_during_trade",
        )
    )
    want = sorted(
        (s, x, y, z, *trade)
        for s, candles in data.items()
        for x in params.xs
        for y in params.ys
        for z in params.zs
        for trade in walk(candles, x, y * 1000, z, 15_000, params.slip, direction)
    )
    assert got == want
    assert len(want) > 40


def test_dynamic_log_equals_the_walk(spark):
    data = {"A": make_candles(7, 200), "B": make_candles(8, 80)}
    params = replace(P, dynamic_y=True, y_max_s=12)
    log = trade_ops.trade_log(frame(spark, data), params)
    got = rows(log.select("symbol", "x_percent", "z_percent", "entry_ms", "exit_ms", "reason"))
    want = sorted(
        (s, x, z, *trade[:3])
        for s, candles in data.items()
        for x in params.xs
        for z in params.zs
        for trade in walk(candles, x, 12_000, z, 15_000, params.slip, "long", dynamic=True)
    )
    assert got == want
    assert log.where("y_actual_seconds < 0 or y_actual_seconds > 12").count() == 0


def test_lookbacks_and_lows(spark):
    candles = make_candles(11, 120)
    df = frame(spark, {"A": candles})
    got = {r.epoch_ms: r for r in signals.lookback_closes(df, [5000, 60_000], 20_000).collect()}
    lows = {r.epoch_ms: r for r in signals.window_lows(df, 30_000, 20_000).collect()}
    assert len(got) == len(lows) == len(candles)
    for i, c in enumerate(candles):
        assert got[c["t"]].past_0 == past_close(candles, i, 5000)
        assert got[c["t"]].past_1 == past_close(candles, i, 60_000)
        assert (lows[c["t"]].low_close, lows[c["t"]].low_ms) == window_low(candles, i, 30_000)


def test_no_signal_for_a_huge_threshold(spark):
    line = [{"t": i * 1000, "close": 100 + 10 * i / 99, "high": 101 + i / 10, "low": 99 + i / 10} for i in range(100)]
    df = frame(spark, {"A": line})
    assert trade_ops.trade_log(df, replace(P, xs=(999.0,))).count() == 0
    assert signals.signals_fixed(df, [0.001], [5], 20_000).count() == 95


def test_exit_rules(spark):
    c = lambda t, close, high=None, low=None: {"t": t, "close": close, "high": high or close, "low": low or close}
    both = [c(0, 100.0), c(5000, 120.0), c(20_000, 90.0)]
    gap = [c(0, 100.0), c(5000, 120.0), c(900_000, 121.0)]
    last = [c(0, 100.0), c(5000, 120.0, 125.0, 110.0)]
    zero = [c(0, 0.0), c(5000, 120.0)]
    params = replace(P, xs=(10.0,), ys=(5,), zs=(10.0,), slip=0.0)
    log = trade_ops.trade_log(frame(spark, {"both": both, "gap": gap, "last": last, "zero": zero}), params)
    got = rows(log.select("symbol", "entry_ms", "exit_ms", "reason", "max_price_during_trade", "min_price_during_trade"))
    assert got == [
        ("both", 5000, 20_000, "drop-z", 120.0, 90.0),
        ("gap", 5000, 900_000, "max-hold", 121.0, 120.0),
        ("last", 5000, 5000, "end-of-data", 125.0, 110.0),
    ]


def greedy(intervals):
    out, end = [], None
    for s, e in sorted(intervals):
        if end is None or s > end:
            out.append((s, e))
            end = e
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(st.integers(0, 3), st.integers(0, 200), st.integers(0, 60)), min_size=1, max_size=60),
    st.sampled_from([(7, ()), (10, (3,)), (5, (2, 4)), (1000, ())]),
)
def test_nonoverlap_equals_greedy(spark, items, layout):
    chunk, spans = layout
    by_lane = {}
    for lane, start, length in items:
        by_lane.setdefault(lane, {})[start] = start + length
    data = [("k", lane, s, e) for lane, d in by_lane.items() for s, e in d.items()]
    df = spark.createDataFrame(data, "k string, lane int, s long, e long").coalesce(1)
    got = nonoverlap.select_nonoverlapping(df, ["k"], "lane", "s", "e", chunk, lanes_together=2, spans=spans)
    want = sorted(("k", lane, s, e) for lane, d in by_lane.items() for s, e in greedy(d.items()))
    assert rows(got) == want


def test_touching_intervals(spark):
    df = spark.createDataFrame([("k", 1, 0, 5), ("k", 1, 5, 9), ("k", 1, 6, 8)], "k string, lane int, s long, e long")
    got = nonoverlap.select_nonoverlapping(df, ["k"], "lane", "s", "e", 2)
    assert rows(got.select("s", "e")) == [(0, 5), (6, 8)]


def test_running_aggregates_do_not_depend_on_chunks(spark):
    rng = random.Random(5)
    data = [("k" if rng.random() < 0.8 else "j", i, rng.choice([None, 1.0, -2.0, 3.0])) for i in range(80)]
    df = spark.createDataFrame(data, "k string, o long, v double")
    plan = [
        scans.Run("s", "sum", F.col("v")),
        scans.Run("m", "max", F.col("v")),
        scans.Run("n", "min", F.col("v")),
        scans.Run("l", "last", F.col("v")),
        scans.Run("before", "last", F.col("v"), inclusive=False),
    ]
    results = [
        rows(scans.running(df, ["k"], ["o"], F.floor(F.col("o") / w).cast("long"), plan), "k", "o") for w in (1, 7, 1000)
    ]
    assert results[0] == results[1] == results[2]


def test_asof_forward(spark):
    right = spark.createDataFrame([("S", t, float(t)) for t in (0, 10, 50, 200)], "symbol string, epoch_ms long, close double")
    left = spark.createDataFrame([("S", t) for t in (0, 1, 10, 51, 200, 201)], "symbol string, at_ms long")
    for chunk in (5, 60, 1000):
        got = asof.asof_forward(left, right, ["symbol"], "at_ms", "epoch_ms", "close", chunk)
        assert rows(got, "at_ms") == [
            ("S", 0, 0.0), ("S", 1, 10.0), ("S", 10, 10.0), ("S", 51, 200.0), ("S", 200, 200.0), ("S", 201, None)
        ]


def test_time_to_target(spark):
    candles = frame(spark, {"S": [{"t": t * 1000, "close": c, "high": c, "low": c} for t, c in [(0, 100.0), (10, 99.0), (20, 98.0)]]})
    trades = spark.createDataFrame([("S", 0, 100.0), ("S", 0, 98.0)], "symbol string, entry_ms long, entry_price double")
    got = asof.time_to_target(trades, candles, [1.0, 2.0, 5.0], 20_000, "short", 5000)
    assert rows(got.select("entry_price", "target", "seconds"), "entry_price", "target") == [
        (98.0, 1.0, None), (98.0, 2.0, None), (98.0, 5.0, None),
        (100.0, 1.0, 10.0), (100.0, 2.0, 20.0), (100.0, 5.0, None),
    ]
    up = asof.time_to_target(trades, candles, [2.0], 20_000, "long", 5000)
    assert rows(up.select("entry_price", "seconds"), "entry_price") == [(98.0, 0.0), (100.0, None)]


def test_validation_never_crosses_the_boundary(spark):
    candles = make_candles(21, 200)
    params = replace(P, skip_filters=True, top_n=2)
    screened, compared = runs.screen_and_validate(frame(spark, {"A": candles}), params)
    assert screened.count() == 8 and compared.count() == 2
    cut = int(len(candles) * 0.7)
    for r in compared.collect():
        train = walk(candles[:cut], r.x, r.y * 1000, r.z, 15_000, params.slip)
        later = walk(candles[cut:], r.x, r.y * 1000, r.z, 15_000, params.slip)
        assert (r.train_total_trades, r.validation_total_trades) == (len(train), len(later))
        assert r.verdict in ("ROBUST", "OVERFIT", "WEAK")
    counts = runs.verdict_counts(screened, compared, params).first()
    assert (counts.screened, counts.filtered, counts.validated) == (8, 8, 2)
    assert counts.robust + counts.overfit + counts.weak == 2
