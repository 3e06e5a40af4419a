"""Candles in arrival order as a stream: one open candle per symbol, published when a trade of another bucket arrives.

Arrival is the order of the files and of the lines in them. A task first folds neighbouring trades of one symbol and bucket
into partial runs while it reads, so that a busy symbol reaches its state as a few rows, not as trades; the keyed state then
holds the one candle of each symbol that is still open. Nothing waits for a watermark and nothing is late: a trade of an
earlier bucket opens another candle, as in :func:`sparktape.operators.candles.ohlcv_runs`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparktape.functions.timeops import floor_to

_CANDLE = ["epoch_ms", "open", "high", "low", "close", "volume", "trade_count"]
OUT = "symbol string, run long, epoch_ms long, open double, high double, low double, close double, volume double, trade_count long"
STATE = "run long, epoch_ms long, open double, high double, low double, close double, volume double, trade_count long"
PART = "symbol string, first long, last long, epoch_ms long, open double, high double, low double, close double, volume double, trade_count long"


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial runs of the trades in the order they come in; a row without a price ends its symbol's candle."""
    for batch in batches:
        if not batch.num_rows:
            continue
        names = pa.array(batch.column("symbol")).dictionary_encode()
        code = names.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")  # by symbol, arrival within
        batch = batch.take(pa.array(order))
        code, bucket, place = code[order], batch.column("epoch_ms").to_numpy(zero_copy_only=False), batch.column("arrival").to_numpy()
        price, size = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("p", "q"))
        ends = np.isnan(price)
        bucket = np.where(ends, -1, np.nan_to_num(bucket)).astype(np.int64)
        begin = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (bucket[1:] != bucket[:-1])))
        last = np.append(begin[1:], len(order)) - 1
        runs = {
            "symbol": batch.column("symbol").take(pa.array(begin)),
            "first": pa.array(place[begin]),
            "last": pa.array(place[last]),
            "epoch_ms": pa.array(bucket[begin], mask=ends[begin]),
            "open": pa.array(price[begin]),
            "high": pa.array(np.fmax.reduceat(price, begin)),
            "low": pa.array(np.fmin.reduceat(price, begin)),
            "close": pa.array(price[last]),
            "volume": pa.array(np.add.reduceat(np.nan_to_num(size), begin)),
            "trade_count": pa.array(last - begin + 1),
        }
        yield pa.RecordBatch.from_pydict(runs)


def _published(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Finished candles of one symbol; the open one goes back to the state."""
    rows = pd.concat(list(parts)).sort_values(["first", "last"], kind="stable")
    now = list(state.get) if state.exists else [0, None, *[0.0] * 5, 0]
    done = []
    for epoch_ms, *values in rows[_CANDLE].itertuples(index=False, name=None):
        bucket = None if pd.isna(epoch_ms) else int(epoch_ms)
        if bucket is not None and bucket == now[1]:
            _, high, low, close, volume, count = values
            now[3:] = [max(now[3], high), min(now[4], low), close, now[6] + volume, now[7] + int(count)]
            continue
        if now[1] is not None:
            done.append((key[0], *now))
        now = [now[0] + (bucket is not None), bucket, *values[:-1], int(values[-1])]
    state.update(tuple(None if isinstance(v, float) and np.isnan(v) else v for v in now))
    found = pd.DataFrame(done, columns=["symbol", "run", *_CANDLE])
    for c in ("open", "high", "low", "close", "volume"):
        found[c] = found[c].astype(float)
    yield found


def run_stream(trades: DataFrame, bucket_ms: int = 1000) -> DataFrame:
    """Streaming ``symbol, run, epoch_ms, open .. trade_count`` of a stream ``symbol, a, t, p, q`` in arrival order.

    A row without a price closes its symbol's open candle: :func:`end_marks` makes them for a stream that ends. ``run``
    counts a symbol's candles. Files of one micro-batch are ordered by their first ids, which must not overlap: give the
    source ``maxFilesPerTrigger`` 1 where they may. State holds one candle per symbol; one micro-batch's partial runs of one
    symbol are read together.
    """
    rows = trades.select("symbol", F.col("a").alias("arrival"), floor_to(F.col("t"), bucket_ms).alias("epoch_ms"), "p", "q")
    parts = rows.mapInArrow(_folded, PART)
    found = parts.groupBy("symbol").applyInPandasWithState(_published, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
    return found.select("symbol", "run", "epoch_ms", *[F.round(c, 8).alias(c) for c in _CANDLE[1:6]], "trade_count")


def end_marks(trades: DataFrame) -> DataFrame:
    """One row without a price per symbol of a finished tape, after all its trades."""
    last = trades.groupBy("symbol").agg((F.max("a") + 1).alias("a"), F.max("t").alias("t"))
    return last.select("symbol", "a", "t", F.lit(None).cast("double").alias("p"), F.lit(None).cast("double").alias("q"))


def write_run_stream(candles: DataFrame, path: str, checkpoint: str, backfill: bool = False, every: str = "10 seconds") -> StreamingQuery:
    """Append finished candles to Parquet; restarts resume from ``checkpoint`` with the candles that were open."""
    writer = candles.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if backfill else writer.trigger(processingTime=every)
    return writer.start(path)
