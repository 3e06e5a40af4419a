"""Reading only the files that a range needs, and storing days without touching others."""

import gzip
import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from sparktape.functions.timeops import DAY_MS
from sparktape.sources import readers, writers

D0 = 1_704_067_200_000  # 2024-01-01
TAPE = "symbol string, a long, t long, p double, q double, first_id long, last_id long, is_maker boolean, is_best boolean"


def lines(first, days, step=6 * 3_600_000):
    return [{"a": first * 100 + i, "p": "1.5", "q": "2", "f": 1, "l": 1, "T": D0 + first * DAY_MS + i * step, "m": True, "M": True} for i in range(days * 4)]


def raw_files(folder):
    """Days 1 to 10 in files that overlap: single days, plain and gzipped, and spans."""
    raw = folder / "btc" / "raw"
    raw.mkdir(parents=True)
    for name, first, days in [("2024-01-01", 0, 1), ("2024-01-02_2024-01-05", 1, 3), ("2024-01-03", 2, 1), ("2024-01-05", 4, 1), ("2024-01-06_2024-01-09", 5, 3), ("2024-01-06_2024-01-08", 5, 2)]:
        (raw / f"aggTrades_{name}.jsonl").write_text("\n".join(json.dumps(x) for x in lines(first, days)))
    with gzip.open(raw / "aggTrades_2024-01-09.jsonl.gz", "wt") as f:
        f.write("\n".join(json.dumps(x) for x in lines(8, 1)))
    (raw / "notes.jsonl").write_text("{}")
    return str(folder)


@pytest.mark.parametrize(
    "start, end, names",
    [
        (0, 1, ["2024-01-01"]),
        (1, 4, ["2024-01-02_2024-01-05"]),
        (2, 6, ["2024-01-02_2024-01-05", "2024-01-05", "2024-01-06_2024-01-09"]),
        (7, 20, ["2024-01-06_2024-01-09", "2024-01-09"]),
        (40, 50, []),
    ],
)
def test_only_files_that_a_range_needs_are_opened(spark, tmp_path, start, end, names):
    folder = raw_files(tmp_path)
    found = readers.read_trades_range(spark, folder, D0 + start * DAY_MS, D0 + end * DAY_MS)
    opened = sorted(f.rsplit("aggTrades_", 1)[1].split(".")[0] for f in found.inputFiles())
    assert opened == names
    whole = [x for first, days in [(0, 1), (1, 3), (4, 1), (5, 3), (8, 1)] for x in lines(first, days)]
    assert sorted(r.t for r in found.collect()) == sorted(x["T"] for x in whole if D0 + start * DAY_MS <= x["T"] < D0 + end * DAY_MS)
    assert not names or {r.symbol for r in found.collect()} == {"BTC"}


def tape(spark, first, days, q=1.0, symbol="S"):
    data = [(symbol, d * 10 + i, D0 + d * DAY_MS + i * 1000, 2.0, q, d, d, True, False) for d in range(first, first + days) for i in range(5)]
    return spark.createDataFrame(data, TAPE)


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_storing_a_day_leaves_the_others(spark, tmp_path, fmt):
    path = str(tmp_path / "tape")
    read = lambda: readers.read_trades_json(spark, path) if fmt == "json" else spark.read.schema(TAPE).parquet(path)
    writers.store_days(tape(spark, 0, 4), path, fmt)
    writers.store_days(tape(spark, 2, 1, q=7.0), path, fmt)
    for _ in range(2):  # storing again changes nothing
        writers.store_days(tape(spark, 3, 2, symbol="T"), path, fmt)
    want = tape(spark, 0, 2).unionByName(tape(spark, 2, 1, q=7.0)).unionByName(tape(spark, 3, 1)).unionByName(tape(spark, 3, 2, symbol="T"))
    assert rows(read().select("symbol", "a", "t", "q")) == rows(want.select("symbol", "a", "t", "q"))
    record = {(r.symbol, r.day): (r["rows"], r.volume, r.running_rows) for r in readers.stored_days(spark, path).collect()}
    assert record == {("S", "2024-01-01"): (5, 5.0, 5), ("S", "2024-01-02"): (5, 5.0, 10), ("S", "2024-01-03"): (5, 35.0, 15), ("S", "2024-01-04"): (5, 5.0, 20), ("T", "2024-01-04"): (5, 5.0, 5), ("T", "2024-01-05"): (5, 5.0, 10)}


def test_a_failed_write_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "tape")
    writers.store_days(tape(spark, 0, 3), path)
    before, record = rows(spark.read.parquet(path).select("a", "t", "q")), rows(readers.stored_days(spark, path))
    broken = tape(spark, 1, 2, q=9.0).withColumn("p", F.when(F.col("t") > D0 + 2 * DAY_MS, F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("p")))
    for store in (writers.store_days, writers.write_trades):
        with pytest.raises(Exception, match="broken"):
            store(broken, path)
        assert rows(spark.read.parquet(path).select("a", "t", "q")) == before and rows(readers.stored_days(spark, path)) == record


def test_stored_ranges_prune_days(spark, tmp_path):
    path = str(tmp_path / "tape")
    writers.store_days(tape(spark, 0, 6), path)
    found = readers.read_trades_stored(spark, path, D0 + DAY_MS + 2000, D0 + 3 * DAY_MS)
    assert found.count() == 8
    assert "PartitionFilters: [isnotnull(day" in found._jdf.queryExecution().toString()
    assert readers.stored_days(spark, str(tmp_path / "none")).count() == 0
