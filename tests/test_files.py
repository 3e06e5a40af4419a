import gzip

import pytest
from conftest import rows
from pyspark.sql import functions as F

from sparktape.operators.candles import ohlcv
from sparktape.schema import TapeError
from sparktape.sources import readers, writers

LINE = '{{"a":{a},"p":"{p}","q":"0.5","f":1,"l":1,"T":{t},"m":false,"M":true}}'


def test_jsonl(spark, tmp_path):
    raw = tmp_path / "btc" / "raw"
    raw.mkdir(parents=True)
    lines = [LINE.format(a=1, p="100.5", t=1700000000000), "", "{broken", LINE.format(a=2, p="7", t=1735689605179257)]
    with gzip.open(raw / "aggTrades_2024-01-01.jsonl.gz", "wt") as f:
        f.write("\n".join(lines))
    (raw / "aggTrades_2024-01-02.jsonl").write_text(LINE.format(a=3, p="8", t=1700000000001))
    got = rows(readers.read_trades_json(spark, str(raw)).select("symbol", "a", "t", "p", "q"))
    assert got == [
        ("BTC", 1, 1700000000000, 100.5, 0.5),
        ("BTC", 2, 1735689605179, 7.0, 0.5),
        ("BTC", 3, 1700000000001, 8.0, 0.5),
    ]


def test_bulk_csv(spark, tmp_path):
    (tmp_path / "day.csv").write_text(
        "agg_trade_id,p,q,f,l,T,m,M\n1,10,2,1,1,1700000000000,true,True\n2,11,2,1,1,1700000000000,False\n3,12,2\n"
        "x,1,1,1,1,1,true,true\n4,13,2,1,1,1735689605179257,True,false\n"
    )
    got = rows(readers.read_trades_csv(spark, str(tmp_path / "day.csv"), "eth").select("symbol", "a", "t", "p", "is_maker", "is_best"))
    assert got == [
        ("ETH", 1, 1700000000000, 10.0, True, True),
        ("ETH", 2, 1700000000000, 11.0, False, True),
        ("ETH", 4, 1735689605179, 13.0, True, False),
    ]


def test_candle_files(spark, tmp_path):
    path = str(tmp_path / "c")
    tape = spark.createDataFrame(
        [("S", 1, 1700000000000, 0.00000039, 1.0), ("S", 2, 1700000001000, 3.14, 2.0)],
        "symbol string, a long, t long, p double, q double",
    )
    candles = ohlcv(tape)
    writers.write_candles_csv(candles, path)
    back = readers.read_candles(spark, path).select(*candles.columns)
    assert rows(back) == rows(candles)
    text = "".join(p.read_text() for p in (tmp_path / "c" / "symbol=S").glob("*.csv"))
    assert text.splitlines()[0] == "timestamp,open,high,low,close,volume,tradeCount"
    assert "0.00000039" in text and "E-" not in text
    writers.write_candles(candles, str(tmp_path / "p"))
    assert rows(spark.read.parquet(str(tmp_path / "p")).select(*candles.columns)) == rows(candles)


def test_candle_coercion(spark, tmp_path):
    (tmp_path / "c.csv").write_text(
        "timestamp,open,high,low,close,volume,tradeCount\n1700000000000,1,2,x,1,1,\n2023-11-14T22:13:21.000Z,1,2,1,1,1,3\n"
    )
    got = rows(readers.read_candles(spark, str(tmp_path / "c.csv"), "s").select("epoch_ms", "low", "trade_count"))
    assert got == [(1700000000000, None, 0), (1700000001000, 1.0, 3)]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(TapeError, match="missing columns"):
        readers.read_candles(spark, str(tmp_path / "bad.csv"))


def test_trade_log_files(spark, tmp_path):
    sub = tmp_path / "out" / "S"
    sub.mkdir(parents=True)
    (sub / "trades_a.csv").write_text(
        "entry_time,exit_time,max_price,min_price,pnl,reason\n2024-01-01T00:00:00Z,2024-01-01T00:01:30Z,5,4,1.5,drop-z\n"
    )
    (sub / "summary.csv").write_text("x\n1\n")
    got = readers.read_trade_log(spark, str(tmp_path / "out"), ["pnl", "max_price_during_trade"]).collect()
    assert [(r.file_name, r.max_price_during_trade, r.hold_seconds, r.pnl) for r in got] == [("trades_a.csv", 5.0, 90.0, 1.5)]
    with pytest.raises(TapeError):
        readers.read_trade_log(spark, str(tmp_path / "out"), ["fees"])
    with pytest.raises(TapeError):
        readers.reject_empty(spark.range(0), "x")


def test_tape_round_trip(spark, tmp_path):
    fields = "symbol string, a long, t long, p double, q double, first_id long, last_id long, is_maker boolean, is_best boolean"
    df = spark.createDataFrame(
        [(f"S{i % 2}", i, 1700000000000 + i * 40_000_000, 0.00000039 + i, 1.0, i, i, i % 3 == 0, i > 2) for i in range(6)], fields
    )
    for fmt in ("parquet", "json"):
        path = str(tmp_path / fmt)
        writers.write_trades(df, path, fmt=fmt)
        writers.write_trades(df.withColumn("a", F.col("a") + 100), path, "append", fmt)
    back = spark.read.parquet(str(tmp_path / "parquet"))
    assert back.count() == 12 and back.where("day = '2023-11-14'").select("symbol").distinct().count() == 1
    again = readers.read_trades_json(spark, str(tmp_path / "json"))
    assert rows(again.where("a < 100").select(*df.columns)) == rows(df) and again.count() == 12
    text = "".join(gzip.open(f, "rt").read() for f in (tmp_path / "json").rglob("*.gz"))
    assert '"p":"0.00000039"' in text and "E-" not in text
    assert readers.read_trades_json(spark, str(tmp_path / "none")).collect() == []


def test_path_must_name_a_symbol(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text(LINE.format(a=1, p="1", t=1700000000000))
    with pytest.raises(Exception, match="no symbol"):
        readers.read_trades_json(spark, str(tmp_path / "x.jsonl")).collect()


def test_logs_of_three_layouts(spark, tmp_path):
    (tmp_path / "trades_1.csv").write_text("symbol,pnl,reason,max_price,min_price\nA,1.5,drop-z,5,4\n")
    (tmp_path / "trades_2.csv").write_text("reason,min_price_during_trade,max_price_during_trade,pnl,symbol\nmax-hold,3,6,2.5,B\n")
    (tmp_path / "trades_3.csv").write_text('pnl,symbol,fees,"reason"\n3.5,C,0.25,"a, b"\n')
    got = readers.read_trade_log(spark, str(tmp_path), ["pnl", "symbol"])
    wanted = ["symbol", "pnl", "reason", "max_price_during_trade", "min_price_during_trade", "fees"]
    assert rows(got.select(*wanted)) == [
        ("A", 1.5, "drop-z", 5.0, 4.0, None), ("B", 2.5, "max-hold", 6.0, 3.0, None), ("C", 3.5, "a, b", None, None, 0.25),
    ]
    with pytest.raises(TapeError, match="missing columns"):
        readers.read_trade_log(spark, str(tmp_path), ["fees"])


def test_candle_headers_and_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("timestamp,open,high,low,close,volume,tradeCount\n1700000000000,1,2,0.5,1.5,9,3\n")
    (tmp_path / "b.csv").write_text("tradeCount,close,timestamp,open,high,low,volume\n4,1.25,1700000001000,1,2,0.5,8\n")
    got = rows(readers.read_candles(spark, str(tmp_path), "s").select("epoch_ms", "close", "volume", "trade_count"))
    assert got == [(1700000000000, 1.5, 9.0, 3), (1700000001000, 1.25, 8.0, 4)]
    (tmp_path / "c.csv").write_text("timestamp,open,high,low,close,volume,tradeCount\n")
    with pytest.raises(TapeError, match="no rows"):
        readers.read_candles(spark, str(tmp_path), "s")


def test_written_log_is_read_back(spark, tmp_path):
    log = spark.createDataFrame(
        [(s, c, 1700000000000 + c, 1700000001000, float(c), "drop-z") for s in "AB" for c in (1, 2)],
        "symbol string, combo_id int, entry_ms long, exit_ms long, pnl double, reason string",
    )
    for name, top in (("all", None), ("top", log.where("combo_id = 2").select("symbol", "combo_id"))):
        writers.write_trade_log(log, str(tmp_path / name), fmt="csv", top=top)
        back = readers.read_trade_log(spark, str(tmp_path / name), ["pnl"]).select(*log.columns)
        assert rows(back) == rows(log if top is None else log.where("combo_id = 2"))


def test_log_and_summary_writers(spark, tmp_path):
    log = spark.createDataFrame(
        [("S", 1, 1700000000000, 1700000001000, 1.0), ("S", 2, 1700000000000, 1700000002000, 2.0)],
        "symbol string, combo_id int, entry_ms long, exit_ms long, pnl double",
    )
    top = spark.createDataFrame([("S", 2)], "symbol string, combo_id int")
    writers.write_trade_log(log, str(tmp_path / "log"), top=top)
    got = spark.read.parquet(str(tmp_path / "log")).collect()
    assert [(r.combo_id, r.exit_time) for r in got] == [(2, "2023-11-14T22:13:22.000Z")]
    writers.write_summary(log, str(tmp_path / "sum"), fmt="csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "sum")).count() == 2


def test_file_manifest(spark, tmp_path):
    for name in ("aggTrades_2024-01-01_2024-02-01.jsonl.gz", "aggTrades_2024-01-05.jsonl", "other.jsonl"):
        (tmp_path / name).write_text("{}")
    spans = readers.raw_file_spans(readers.list_files(spark, str(tmp_path)))
    day = 86_400_000
    got = sorted((r.start_ms, r.end_ms) for r in spans.collect())
    assert got == [(1704067200000, 1704067200000 + 31 * day), (1704067200000 + 4 * day, 1704067200000 + 5 * day)]
