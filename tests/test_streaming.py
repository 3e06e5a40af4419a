from conftest import rows
from pyspark.sql import functions as F

from sparktape.operators.candles import ohlcv
from sparktape.streaming.candle_stream import candle_stream, write_candle_stream

TAPE = "symbol string, a long, t long, p double, q double"
T0 = 1700000000000


def feed(spark, tmp_path, *batches):
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, TAPE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(TAPE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(spark, tmp_path, stream, **options):
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    query = write_candle_stream(candle_stream(stream, "1 second", "2 seconds", **options), out, state, backfill=True)
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.read.parquet(out)


def trades(first, last, base=0):
    return [("S", base + i, T0 + i * 300, float(i % 7), 1.0) for i in range(first, last)]


def test_stream_equals_batch_for_closed_windows(spark, tmp_path):
    data = trades(0, 60)
    stream = feed(spark, tmp_path, data[:30], data[30:], [("S", 999, T0 + 60_000, 1.0, 1.0)])
    got = run(spark, tmp_path, stream)
    want = ohlcv(spark.createDataFrame(data, TAPE))
    assert rows(got.select(*want.columns)) == rows(want)


def test_duplicates_and_late_rows(spark, tmp_path):
    data = trades(0, 20)
    far = [("S", 900, T0 + 30_000, 1.0, 1.0)]
    stream = feed(spark, tmp_path, data + data, far, [("S", 901, T0, 50.0, 1.0)], [("S", 902, T0 + 60_000, 1.0, 1.0)])
    got = run(spark, tmp_path, stream)
    want = ohlcv(spark.createDataFrame(data + far, TAPE))
    assert rows(got.select(*want.columns)) == rows(want)


def test_restart_resumes(spark, tmp_path):
    data = trades(0, 30)
    run(spark, tmp_path, feed(spark, tmp_path, data[:15]))
    got = run(spark, tmp_path, feed(spark, tmp_path, data[15:], [("S", 999, T0 + 60_000, 1.0, 1.0)]))
    want = ohlcv(spark.createDataFrame(data, TAPE))
    assert rows(got.select(*want.columns)) == rows(want)
    assert got.where(F.col("day") == "2023-11-14").count() == want.count()
