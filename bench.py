"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from dataclasses import replace
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from sparktape.lineage import saved  # noqa: E402
from sparktape.operators.screening import derive, screen  # noqa: E402
from sparktape.operators.trades import trade_log  # noqa: E402
from sparktape.plans.bindings import DEFAULTS, candles  # noqa: E402
from sparktape.plans.catalogue import queries  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "ohlcv",
    "ohlcv_ties",
    "ohlcv_runs",
    "interval_cover",
    "asof_back",
    "asof_forward",
    "sliding_argmin",
    "signal_fixed",
    "signal_dynamic",
    "exit_search",
    "nonoverlap_select",
    "trade_log",
    "trade_metrics",
    "equity_curve",
    "screening",
    "dynamic_y_screen",
    "train_val_split",
    "kfold_split",
    "train_val_compare",
    "stoploss_impact",
    "maxhold_percentiles",
    "extended_hold_summary",
    "time_to_target_stats",
]
# A wider grid on one-minute candles, as a screening run would have it.
MINUTE_GRID = replace(
    DEFAULTS,
    xs=(10.0, 20.0, 50.0, 100.0),
    ys=(600, 1800, 3600, 7200),
    zs=(20.0, 50.0, 90.0),
    hold_s=3600,
    chunk_ms=86_400_000,
)


def screening_minute_grid(spark, sf_dir):
    log = trade_log(saved(candles(spark, sf_dir, 60_000)), MINUTE_GRID)
    return derive(screen(log, ["symbol", "combo_id"], MINUTE_GRID.direction), MINUTE_GRID.capital)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("sparktape-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "7g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="sparktape-bench-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    every = {**queries(), "screening_minute_grid": screening_minute_grid}
    every["ohlcv"](spark, SF_DIR).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in [*HEADLINE, "screening_minute_grid"]:
        begin = time.perf_counter()
        every[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    sets = len(MINUTE_GRID.xs) * len(MINUTE_GRID.ys) * len(MINUTE_GRID.zs)
    work = sets * candles(spark, SF_DIR, 60_000).count()
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(SF_DIR).name.removeprefix("sf"),
                "set_candles_per_sec": round(work / seconds["screening_minute_grid"]),
            }
        )
    )


if __name__ == "__main__":
    main()
