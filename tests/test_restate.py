"""Candles restated by late trades: merging, restarts, unfinished writes and compaction."""

import random
import shutil

import pytest
from conftest import rows

from sparktape.operators.candles import ohlcv
from sparktape.streaming.restate import candle_parts, compact, merged, restated_candles, write_restated

TAPE = "symbol string, a long, t long, p double, q double"
COLUMNS = ["symbol", "epoch_ms", "open", "high", "low", "close", "volume", "trade_count"]


def tape(n=400):
    rng = random.Random(2)
    return [("A" if i % 3 else "B", i, 1_700_000_000_000 + rng.randint(0, 40_000), float(rng.randint(1, 99)), 1.0) for i in range(n)]


def deliver(spark, folder, data, path, state):
    if data:
        spark.createDataFrame(data, TAPE).write.mode("append").parquet(folder)
    query = write_restated(spark.readStream.schema(TAPE).parquet(folder), path, state, backfill=True)
    query.awaitTermination(120)
    assert query.exception() is None


def test_late_trades_restate_candles(spark, tmp_path):
    folder, path, state = (str(tmp_path / x) for x in ("in", "parts", "state"))
    assert restated_candles(spark, path).count() == 0
    data = tape()
    parts = [data[:250], data[250:300], data[300:]]
    for i, part in enumerate(parts):
        deliver(spark, folder, part, path, state)
        seen = spark.createDataFrame([r for p in parts[: i + 1] for r in p], TAPE)
        assert rows(restated_candles(spark, path).select(*COLUMNS)) == rows(ohlcv(seen).select(*COLUMNS))
    first = spark.createDataFrame(parts[0], TAPE)
    assert rows(restated_candles(spark, path, as_of=0).select(*COLUMNS)) == rows(ohlcv(first).select(*COLUMNS))
    found = restated_candles(spark, path)
    assert found.where("restated > 0").count() > 10 and found.agg({"version": "max"}).first()[0] == 2
    before = rows(found)
    compact(spark, path)
    assert rows(restated_candles(spark, path)) == before
    with pytest.raises(ValueError):
        restated_candles(spark, path, as_of=0)
    deliver(spark, folder, [("A", 1000, 1_700_000_000_000, 500.0, 1.0)], path, state)
    top = restated_candles(spark, path).where("symbol = 'A' and epoch_ms = 1700000000000").first()
    assert top.high == 500.0 and top.version == 3


def test_unfinished_and_repeated_batches_change_nothing(spark, tmp_path):
    path, data = str(tmp_path / "parts"), spark.createDataFrame(tape(50) + tape(50)[:10], TAPE)
    for _ in range(2):  # a batch written again replaces itself; trades repeated in it count once
        candle_parts(data, 1000, 0).write.mode("overwrite").parquet(f"{path}/batch=0")
    want = rows(ohlcv(spark.createDataFrame(tape(50), TAPE)).select(*COLUMNS))
    shutil.copytree(f"{path}/batch=0", f"{path}/batch=1")
    (tmp_path / "parts" / "batch=1" / "_SUCCESS").unlink()
    assert rows(restated_candles(spark, path).select(*COLUMNS)) == want
    compact(spark, path)
    assert rows(restated_candles(spark, path).select(*COLUMNS)) == want


def test_merging_is_associative(spark):
    data = tape(90)
    a, b, c = (candle_parts(spark.createDataFrame(data[i::3], TAPE), 5000, i) for i in range(3))
    assert rows(merged(merged(a.unionByName(b)).unionByName(c))) == rows(merged(a.unionByName(merged(b.unionByName(c)))))
