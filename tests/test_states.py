"""Metrics from merged states equal metrics of the log, however the periods are merged."""

import random

import pytest
from pyspark.sql import functions as F

from sparktape.operators import metrics, states

DAY = 86_400_000
LOG = "symbol string, combo_id int, entry_ms long, pnl double, pnl_percent double, mae_pct double, mfe_pct double"
KEYS = ["symbol", "combo_id"]


def log(spark, seed=1, n=400):
    rng, rows = random.Random(seed), []
    for combo in range(6):
        t = 0
        for _ in range(n if combo else 1):
            t += rng.choice([1, 3_600_000, 20_000_000, 5 * DAY]) + 1
            # One set only loses, one only wins, one has the same result always; zeros count as losses.
            pnl = {1: -abs(rng.gauss(0, 3)), 2: abs(rng.gauss(0, 3)) + 0.1, 3: 0.7}.get(combo, rng.choice([0.0, rng.gauss(0.2, 3)]))
            rows.append((None if combo == 5 else "S", combo, t, pnl, pnl / 2, rng.random(), None if rng.random() < 0.2 else rng.random()))
    return spark.createDataFrame(rows, LOG)


def table(df):
    columns = sorted(df.columns)
    return {(r.symbol, r.combo_id): [None if r[c] is None else pytest.approx(r[c], rel=1e-6, abs=2e-4) for c in columns if c not in KEYS] for r in df.collect()}


@pytest.mark.parametrize("direction", ["long", "signal-only"])
def test_merged_states_give_the_logs_metrics(spark, direction):
    rows = log(spark).cache()
    full = metrics.trade_metrics(rows, KEYS, direction, 1000.0, DAY)
    more = metrics.advanced_metrics(rows, KEYS, direction, DAY)
    want = full.join(more, full.combo_id == more.combo_id).select(full["*"], *[more[c] for c in more.columns if c not in KEYS])
    days = states.daily_states(rows, KEYS, direction).cache()
    ways = [
        states.merge_states(days, KEYS),
        states.merge_states(states.merge_states(states.merge_states(days, KEYS, 3 * DAY), KEYS, 30 * DAY), KEYS),
        states.merge_states(states.daily_states(rows, KEYS, direction, 3_600_000), KEYS),
    ]
    want = {k: v for k, v in table(want).items() if k[0]}  # null symbols do not join; they are compared with each other below
    nulls = []
    for way in ways:
        got = table(states.state_metrics(way, KEYS, 1000.0))
        assert {k: v for k, v in got.items() if k[0]} == {k: [x.expected if hasattr(x, "expected") else x for x in v] for k, v in want.items()}
        nulls.append([v for k, v in got.items() if not k[0]])
    assert [[x.expected for x in v] for v in nulls[0]] == nulls[1] == nulls[2] and nulls[0]


def test_merging_in_parts_is_merging_at_once(spark):
    rows = log(spark, seed=5, n=120)
    days = states.daily_states(rows, KEYS, "long").cache()
    once = states.merge_states(days, KEYS, 40 * DAY)
    twice = states.merge_states(states.merge_states(days, KEYS, 8 * DAY), KEYS, 40 * DAY)
    key = lambda df: sorted(((r.symbol or "", r.combo_id, r.period), [r[c] for c in states.STATE]) for r in df.collect())
    for (a, x), (b, y) in zip(key(once), key(twice), strict=True):
        assert a == b and x == [pytest.approx(v, rel=1e-9, abs=1e-9) if v is not None else None for v in y]
    assert once.count() < days.count()


def test_streaks_and_falls_across_periods(spark):
    # Losses on both sides of midnight, a period without a win in between, a win at the end.
    data = [(1, 5.0), (2, -1.0), (3, -2.0), (DAY + 1, -3.0), (DAY + 2, 0.0), (2 * DAY + 1, -1.0), (2 * DAY + 2, 4.0), (2 * DAY + 3, -1.0)]
    rows = spark.createDataFrame([("S", 1, t, p, p, 0.1, 0.1) for t, p in data], LOG)
    days = states.daily_states(rows, KEYS, "long").orderBy("period").collect()
    assert [(r["head"], r["tail"], r.longest, r.fall) for r in days] == [(0, 2, 2, 3.0), (2, 2, 2, 0.0), (1, 1, 1, 1.0)]
    whole = states.merge_states(spark.createDataFrame(days), KEYS).first()
    assert (whole["head"], whole["tail"], whole.longest, whole.fall, whole.top, whole.bottom) == (0, 1, 5, 7.0, 5.0, -2.0)
    assert states.merge_states(states.daily_states(rows.limit(0), KEYS, "long"), KEYS).count() == 0
    assert rows.where(F.col("pnl") > 0).count() == 2
