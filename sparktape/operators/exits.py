"""Exit of every possible entry: first drop of z percent from the running maximum, else the maximum hold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktape.functions.positions import block_table, first_hit, span_fold
from sparktape.functions.pricing import entry_price
from sparktape.functions.timeops import floor_to
from sparktape.lineage import saved
from sparktape.operators.asof import asof_forward
from sparktape.operators.horizon import between, fan_of, first_hits, tree
from sparktape.operators.scans import Run, join_on, running, spread
from sparktape.schema import EXIT_REASONS

EXIT_FIELDS = [
    T.StructField("z", T.DoubleType()),
    T.StructField("exit_ms", T.LongType()),
    T.StructField("raw_exit", T.DoubleType()),
    T.StructField("max_price", T.DoubleType()),
    T.StructField("min_price", T.DoubleType()),
    T.StructField("reason", T.IntegerType()),
]


def _drop_test(peak: np.ndarray, z: float):
    def hit(close: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return (peak > 0) & ((peak - close) / peak * 100.0 >= z)

    return hit


def _chunk_exits(rows: pa.Table, zs: list[float], hold_ms: int, kept: list[str]) -> pa.Table:
    """Exits of one chunk's entries; the chunk comes with the candles of the hold after it.

    The running maximum passes the drop test at a candle when the entry price or some high since the entry does, so
    the exit is the earlier of two lookups: first close far enough below the entry price, and the earliest such close
    over the highs that follow the entry.
    """
    rows = rows.sort_by("epoch_ms")
    n = rows.num_rows
    ms, close, price = (rows[c].to_numpy() for c in ("epoch_ms", "close", "entry_price"))
    entries = np.flatnonzero(rows["is_entry"].to_numpy())
    lowest_close = block_table(close, np.minimum)
    highs = block_table(rows["high"].to_numpy(), np.fmax)
    lows = block_table(rows["low"].to_numpy(), np.fmin)
    price = price[entries]
    timeout = np.searchsorted(ms, ms[entries] + hold_ms, side="left")
    payload = rows.select(kept).take(pa.array(entries))
    parts = []
    for z in zs:
        from_entry = first_hit(lowest_close, entries + 1, _drop_test(price, z))
        from_high = first_hit(lowest_close, np.arange(n), _drop_test(highs[0], z))
        after = np.append(np.minimum.accumulate(from_high[::-1])[::-1], n)
        drop = np.minimum(from_entry, after[entries + 1])
        dropped = (drop < n) & (drop <= timeout)
        leave = np.where(dropped, drop, np.minimum(timeout, n - 1))
        seen = np.minimum(entries + 1, leave)
        reason = np.where(dropped, 1, np.where(timeout < n, 2, 3))
        found = {
            "z": np.full(len(entries), z),
            "exit_ms": ms[leave],
            "raw_exit": close[leave],
            "max_price": np.fmax(price, span_fold(highs, seen, leave, np.fmax)),
            "min_price": np.fmin(price, span_fold(lows, seen, leave, np.fmin)),
            "reason": reason.astype(np.int32),
        }
        part = payload
        for field in EXIT_FIELDS:
            part = part.append_column(field.name, pa.array(found[field.name]))
        parts.append(part)
    return pa.concat_tables(parts)


def exits(rows: DataFrame, keys: list[str], zs: list[float], hold_ms: int, slip: float, direction: str) -> DataFrame:
    """One row ``keys, epoch_ms, entry_price, z, exit_ms, raw_exit, max_price, min_price, reason`` per entry and z.

    ``rows`` are chunked candles that come with at least ``hold_ms`` and the first candle after it. Entries are the
    candles with ``is_entry``, core ones only; the others just serve as the path. Every row has a close: candles without
    one are left out before, so no trade enters or leaves at them; a missing high or low is passed over. Prices must not be
    negative. A task holds
    one chunk and its halo, so at most ``span / bucket`` candles.
    """
    priced = rows.withColumn("entry_price", entry_price(F.col("close"), slip, direction))
    kept = [*keys, "epoch_ms", "entry_price"]
    schema = T.StructType([priced.schema[c] for c in kept] + EXIT_FIELDS)
    levels = [float(z) for z in zs]
    found = priced.groupBy(*keys, "_chunk").applyInArrow(
        lambda group: _chunk_exits(group, levels, int(hold_ms), kept), schema
    )
    names = F.create_map(*[F.lit(v) for pair in EXIT_REASONS.items() for v in pair])
    return found.withColumn("reason", names[F.col("reason")])


def long_exits(path: DataFrame, keys: list[str], zs: list[float], hold_ms: int, slip: float, direction: str, chunk_ms: int) -> DataFrame:
    """The rows of :func:`exits` for holds longer than a chunk; ``path`` are candles with ``is_entry``, without chunks or halos.

    A task holds one chunk, however long the hold. What a chunk leaves open goes on with its highest price so far: it ends at
    the first later close that falls far enough below that price, or, if earlier, below a high after the chunk. The latter is
    the same for all entries of a chunk: each chunk's own highest price is followed like an entry, and the earliest of these
    drops from a chunk on is a running minimum from the end. Highest and lowest prices of a trade come from its own chunk,
    from the nodes between, and from the start of the chunk it ends in.
    """
    levels = [float(z) for z in zs]
    own = [*keys, "_chunk"]
    fan = fan_of(hold_ms, chunk_ms)
    number = lambda c: F.when(~F.isnan(c), F.col(c))
    rows = path.withColumns({"_chunk": floor_to(F.col("epoch_ms"), chunk_ms), "high": number("high"), "low": number("low")})
    here = Window.partitionBy(*own).orderBy("epoch_ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marks = saved(rows.withColumns({"_high": F.max("high").over(here), "_low": F.min("low").over(here)}))
    fallen = lambda z: (F.col("_high") > 0) & ((F.col("_high") - F.col("close")) / F.col("_high") * 100.0 >= z)
    inner = F.array(*[F.struct(F.lit(z).alias("z"), F.min(F.when(fallen(z), F.col("epoch_ms"))).alias("inner_ms")) for z in levels])
    chunks = saved(marks.groupBy(*own).agg(F.min("close").alias("close"), F.max("high").alias("high"), F.min("low").alias("low"), inner.alias("_inner")))
    nodes = tree(chunks, keys, chunk_ms, fan, {"close": "min", "high": "max", "low": "min"})

    found = exits(spread(marks, *own, rows=marks.count()).withColumn("_core", F.lit(True)), keys, levels, hold_ms, slip, direction)
    found = saved(found.withColumn("_chunk", floor_to(F.col("epoch_ms"), chunk_ms)))
    end = F.col("reason") == EXIT_REASONS[3]
    done, open_ = found.where(~end), found.where(end)
    # A candle that ends its chunk has seen no price after its own yet.
    last = F.col("exit_ms") == F.col("epoch_ms")
    open_ = open_.select(*own, "epoch_ms", "entry_price", "z", *[F.when(last, F.col("entry_price")).otherwise(F.col(c)).alias(c) for c in ("max_price", "min_price")])

    each = chunks.select(*own, F.col("high").alias("peak"), F.inline("_inner"))
    asked = open_.select(*own, "z", F.col("max_price").alias("peak")).unionByName(each.select(*own, "z", "peak").where("peak is not null"))
    hits = first_hits(
        asked, ["z", "peak"], marks, nodes, keys, "close", True,
        lambda close, q: _drop_test(q["peak"], q["z"])(close), chunk_ms, hold_ms,
    )
    hits = saved(hits)
    each = join_on(each, hits, [*own, "z", "peak"], "left").withColumns({"_back": -F.col("_chunk"), "_ms": F.least("inner_ms", "hit_ms")})
    each = each.select(*keys, F.col("_chunk").alias("_own"), "z", "_back", "_ms")
    later = running(each, [*keys, "z"], ["_back"], floor_to(F.col("_back"), chunk_ms * fan), [Run("later_ms", "min", F.col("_ms"), inclusive=False)])
    later = later.select(*keys, F.col("_own").alias("_chunk"), "z", "later_ms")
    open_ = join_on(open_.withColumn("peak", F.col("max_price")), hits, [*own, "z", "peak"], "left")
    open_ = join_on(open_, later, [*own, "z"], "left")

    limits = open_.select(*keys, "epoch_ms", (F.col("epoch_ms") + hold_ms).alias("_at")).distinct()
    times = marks.select(*keys, F.col("epoch_ms").alias("_time"), F.col("epoch_ms").alias("limit_ms"))
    limits = asof_forward(limits, times, keys, "_at", "_time", "limit_ms", chunk_ms)
    ends = marks.groupBy(*keys).agg(F.max("epoch_ms").alias("end_ms"))
    open_ = join_on(open_, limits.select(*keys, "epoch_ms", F.col("limit_ms").cast("long")), [*keys, "epoch_ms"])
    open_ = join_on(open_, ends, keys)
    drop = F.least("hit_ms", "later_ms")
    drops = drop.isNotNull() & (F.col("limit_ms").isNull() | (drop <= F.col("limit_ms")))
    reason = F.when(drops, 1).when(F.col("limit_ms").isNotNull(), 2).otherwise(3)
    open_ = open_.withColumns({"exit_ms": F.when(drops, drop).otherwise(F.coalesce("limit_ms", "end_ms")), "_reason": reason})
    open_ = saved(open_.withColumn("_until", floor_to(F.col("exit_ms"), chunk_ms)))

    middle = between(open_, nodes, keys, {"high": "max", "low": "min"}, chunk_ms, fan).withColumnsRenamed({"high": "_between_high", "low": "_between_low"})
    open_ = join_on(open_, middle, [*own, "_until"], "left")
    at = marks.select(*keys, F.col("epoch_ms").alias("exit_ms"), F.col("close").alias("raw_exit"), "high", "low", "_high", "_low")
    open_ = join_on(open_, at, [*keys, "exit_ms"])
    stays = F.col("_until") == F.col("_chunk")  # only a trade that nothing ends ends in its own chunk here

    def extreme(fold, price: str, side: str) -> Column:
        alone = F.when(F.col("exit_ms") == F.col("epoch_ms"), F.col(side))
        return F.when(stays, fold(F.col(price), alone)).otherwise(fold(price, f"_between_{side}", f"_{side}")).alias(price)

    names = F.create_map(*[F.lit(v) for pair in EXIT_REASONS.items() for v in pair])
    open_ = open_.select(
        *keys, "epoch_ms", "entry_price", "z", "exit_ms", "raw_exit", extreme(F.greatest, "max_price", "high"), extreme(F.least, "min_price", "low"),
        names[F.col("_reason")].alias("reason"),
    )
    return done.drop("_chunk").unionByName(open_)
