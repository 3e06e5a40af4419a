import random

from conftest import rows
from pyspark.sql import functions as F

from sparktape.functions.timeops import DAY_MS
from sparktape.operators import candles, tape

T0 = 1700000000000
TAPE = "symbol string, a long, t long, p double, q double"


def test_three_trades(spark):
    df = spark.createDataFrame(
        [("S", 1, T0, 100.0, 1.0), ("S", 2, T0 + 500, 101.0, 2.0), ("S", 3, T0 + 1000, 102.0, 1.0)], TAPE
    )
    assert rows(candles.ohlcv(df)) == [
        ("S", T0, 100.0, 101.0, 100.0, 101.0, 3.0, 2),
        ("S", T0 + 1000, 102.0, 102.0, 102.0, 102.0, 1.0, 1),
    ]


def test_unsorted_empty_and_ties(spark):
    df = spark.createDataFrame(
        [("S", 3, T0 + 1000, 102.0, 1.0), ("S", 1, T0, 100.0, 1.0), ("S", 2, T0 + 500, 101.0, 1.0)], TAPE
    )
    assert [r[2] for r in rows(candles.ohlcv(df))] == [100.0, 102.0]
    assert candles.ohlcv(df.limit(0)).count() == 0
    tie = spark.createDataFrame([("S", 9, T0, 5.0, 1.0), ("S", 4, T0, 3.0, 1.0), ("S", 6, T0, 7.0, 1.0)], TAPE)
    assert rows(candles.ohlcv(tie))[0][2:6] == (3.0, 7.0, 3.0, 5.0)


def test_arrival_runs_across_chunks(spark):
    late = [("S", i, T0 + (0 if i % 3 == 0 else 1000), float(i), 1.0) for i in range(1, 12)]
    df = spark.createDataFrame(late, TAPE)
    want, previous = [], None
    for _, a, t, p, _ in late:
        if t != previous:
            want.append([t, p, p, 1])
            previous = t
        else:
            want[-1][2], want[-1][3] = p, want[-1][3] + 1
    for size in (1, 2, 5, 1000):
        got = candles.ohlcv_runs(df, 1000, "a", size).orderBy("run").select("epoch_ms", "open", "close", "trade_count")
        assert [list(r) for r in got.collect()] == want


def test_covered_intervals(spark):
    spans = [("k", 1, 0, 10), ("k", 2, 2, 5), ("k", 3, 0, 10), ("k", 4, 5, 15), ("k", 5, 20, 30), ("k", 6, 22, 30)]
    df = spark.createDataFrame(spans, "k string, n long, s long, e long")
    for chunk in (1, 3, 100):
        kept = tape.uncovered_intervals(df, ["k"], "n", "s", "e", F.lit(0), F.lit(100), chunk)
        assert sorted(r.n for r in kept.collect()) == [1, 4, 5]
    early = tape.uncovered_intervals(df, ["k"], "n", "s", "e", F.lit(16), F.lit(21), 3)
    assert sorted(r.n for r in early.collect()) == [5]


def test_covered_intervals_against_brute_force(spark):
    rng = random.Random(3)
    spans = [("k", i, s, s + rng.randint(1, 12)) for i in range(120) for s in [rng.randint(0, 60)]]
    df = spark.createDataFrame(spans, "k string, n long, s long, e long")
    selected = []
    for f in sorted(spans, key=lambda f: (-(f[3] - f[2]), f[1])):
        if not any(c[2] <= f[2] and c[3] >= f[3] for c in selected):
            selected.append(f)
    got = tape.uncovered_intervals(df, ["k"], "n", "s", "e", F.lit(-1), F.lit(1000), 7)
    assert sorted(r.n for r in got.collect()) == sorted(f[1] for f in selected)


def test_range_dedupe_and_days(spark):
    df = spark.createDataFrame([("S", i, T0 + i * 10_000_000, 1.0, 1.0) for i in range(30)], TAPE)
    assert tape.dedupe(df.unionByName(df)).count() == 30
    end = T0 + 10 * 10_000_000
    assert tape.time_range(df, T0, end).count() == 10
    assert rows(tape.time_range_counts(df, T0, end)) == [("S", 10, 20)]
    merged = tape.merge_days(df.where("a > 20"), df.where("a < 0"), df.where("a <= 20"))
    totals = tape.day_totals(merged).orderBy("day_ms").collect()
    assert totals[-1].running_rows == 30 and sum(r.rows for r in totals) == 30
    request = spark.createDataFrame([("S", T0 - T0 % DAY_MS - DAY_MS, T0)], "symbol string, start_ms long, end_ms long")
    days = tape.day_coverage(request, df, ["symbol"]).orderBy("day_ms").collect()
    assert [d.present for d in days] == [False, True]


def test_coverage(spark):
    df = spark.createDataFrame([("A", 0), ("A", 1000), ("A", 4000), ("B", 0)], "symbol string, epoch_ms long")
    assert rows(candles.coverage(df)) == [("A", 3, 0, 4000, 4, 0.75), ("B", 1, 0, 0, 1, 1.0)]
