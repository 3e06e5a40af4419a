"""Arrival-order candles as a stream: equal to the batch, across restarts, files and hot symbols."""

import random

import pytest
from conftest import rows

from sparktape.operators.candles import ohlcv_runs
from sparktape.streaming.run_stream import end_marks, run_stream, write_run_stream

TAPE = "symbol string, a long, t long, p double, q double"


def tape(n, seed=1, symbols=("HOT", "HOT", "HOT", "B", None)):
    rng, t, out = random.Random(seed), 1_700_000_000_000, []
    for a in range(n):
        t += rng.choice([0, 100, 400, 900, 2000, -1500])
        out.append((rng.choice(symbols), a, t, round(rng.uniform(1, 9), 2), float(rng.randint(1, 5))))
    return out


def feed(spark, folder, batches):
    for batch in batches:
        batch.coalesce(1).sortWithinPartitions("a").write.mode("append").parquet(folder)


def drain(spark, folder, tmp_path, files=1):
    stream = spark.readStream.schema(TAPE).option("maxFilesPerTrigger", files).parquet(folder)
    query = write_run_stream(run_stream(stream), str(tmp_path / "out"), str(tmp_path / "state"), backfill=True)
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.read.parquet(str(tmp_path / "out"))


def key(found):
    return sorted(map(tuple, found), key=str)


@pytest.mark.parametrize("files", [1, 3])
def test_stream_equals_batch(spark, tmp_path, files):
    trades = spark.createDataFrame(tape(600), TAPE)
    parts = [trades.where(f"a >= {i * 150} and a < {i * 150 + 150}") for i in range(4)]
    feed(spark, str(tmp_path / "in"), [*parts, end_marks(trades)])
    want = ohlcv_runs(trades, 1000)
    got = drain(spark, str(tmp_path / "in"), tmp_path, files)
    assert key(got.select(*want.columns).collect()) == key(want.collect()) and got.count() > 200


def test_restart_goes_on_with_the_open_candle(spark, tmp_path):
    trades = spark.createDataFrame(tape(200, seed=4), TAPE)
    want = ohlcv_runs(trades, 1000)
    feed(spark, str(tmp_path / "in"), [trades.where("a < 101")])
    first = drain(spark, str(tmp_path / "in"), tmp_path).count()
    assert 0 < first < want.count()
    feed(spark, str(tmp_path / "in"), [trades.where("a >= 101"), end_marks(trades)])
    got = drain(spark, str(tmp_path / "in"), tmp_path)
    assert key(got.select(*want.columns).collect()) == key(want.collect())


def test_an_open_candle_waits_and_marks_close_it_once(spark, tmp_path):
    one = [("S", 1, 5000, 2.0, 1.0), ("S", 2, 5400, 3.0, 1.0), ("S", 3, 5900, 1.0, 1.0)]
    feed(spark, str(tmp_path / "in"), [spark.createDataFrame(one, TAPE)])
    assert drain(spark, str(tmp_path / "in"), tmp_path).count() == 0
    mark = spark.createDataFrame([("S", 9, 5900, None, None)], TAPE)
    feed(spark, str(tmp_path / "in"), [mark, mark, spark.createDataFrame([("S", 10, 5950, 4.0, 2.0)], TAPE), mark])
    assert rows(drain(spark, str(tmp_path / "in"), tmp_path)) == [("S", 1, 5000, 2.0, 3.0, 1.0, 1.0, 3.0, 3), ("S", 2, 5000, 4.0, 4.0, 4.0, 4.0, 2.0, 1)]
