"""Entry signals: price rise over a fixed lookback, or over the lowest close of a window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktape.functions.pricing import percent_move
from sparktape.functions.timeops import floor_to
from sparktape.operators.scans import Run, chunk_with_halo, join_on, running, with_close


def _past_closes(rows: DataFrame, keys: list[str], lookbacks_ms: list[int]) -> DataFrame:
    """Add ``past_<i>`` on chunked rows; right for core rows."""
    w = Window.partitionBy(*keys, "_chunk").orderBy("epoch_ms")
    return rows.withColumns(
        {
            f"past_{i}": F.last("close").over(w.rangeBetween(Window.unboundedPreceding, -int(y)))
            for i, y in enumerate(lookbacks_ms)
        }
    )


def _lows(rows: DataFrame, keys: list[str], window_ms: int) -> DataFrame:
    """Add ``low_close, low_ms`` on chunked rows; right for core rows.

    A window meets at most two blocks of its own length: a prefix of the block of ``now`` and a suffix of the one
    before. Both are running minima, so the cost does not grow with the window, and nothing is shuffled again.
    """
    columns = rows.columns
    here = F.struct(F.lit(0).alias("probe"), F.col("epoch_ms").alias("pos"))
    back = F.struct(F.lit(1).alias("probe"), (F.col("epoch_ms") - window_ms).alias("pos"))
    rows = rows.withColumn("_at", F.explode(F.when(F.col("_core"), F.array(here, back)).otherwise(F.array(here))))
    rows = rows.select(
        *columns,
        F.col("_at.probe").alias("_probe"),
        F.col("_at.pos").alias("_pos"),
        floor_to(F.col("_at.pos"), window_ms).alias("_block"),
    )
    has_close = F.col("close").isNotNull() & ~F.isnan("close")
    point = F.when((F.col("_probe") == 0) & has_close, F.struct("close", "epoch_ms"))
    block = Window.partitionBy(*keys, "_chunk", "_block")
    prefix = F.min(point).over(block.orderBy("_pos", F.desc("_probe")).rowsBetween(Window.unboundedPreceding, -1))
    suffix = F.min(point).over(block.orderBy(F.desc("_pos"), "_probe").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_seen", prefix).withColumn(
        "_seen", F.when(F.col("_probe") == 0, F.col("_seen")).otherwise(suffix)
    )
    group = [*keys, "_chunk", "epoch_ms"]
    low = rows.groupBy(*group).agg(
        *[F.first(c).alias(c) for c in columns if c not in group], F.min("_seen").alias("_low")
    )
    below = F.col("_low.close") < F.col("close")
    return low.select(
        *columns,
        F.when(below, F.col("_low.close")).alias("low_close"),
        F.when(below, F.col("_low.epoch_ms")).alias("low_ms"),
    )


def _distant_closes(path: DataFrame, keys: list[str], lookbacks_ms: list[int], chunk_ms: int) -> DataFrame:
    """``keys, epoch_ms, past_<i>`` for lookbacks longer than a chunk: probes on the axis of closes, read in chunks."""
    probes = F.array(*[F.struct(F.lit(i).alias("_i"), (F.col("epoch_ms") - int(y)).alias("_pos")) for i, y in enumerate(lookbacks_ms)])
    probes = path.select(*keys, "epoch_ms", F.inline(probes)).withColumn("_close", F.lit(None).cast("double"))
    marks = path.select(*keys, F.lit(None).cast("long").alias("epoch_ms"), F.lit(-1).alias("_i"), F.col("epoch_ms").alias("_pos"), F.col("close").alias("_close"))
    axis = probes.unionByName(marks).withColumn("_probe", (F.col("_i") >= 0).cast("int"))
    found = running(axis, keys, ["_pos", "_probe"], floor_to(F.col("_pos"), chunk_ms), [Run("_past", "last", F.col("_close"))]).where("_i >= 0")
    return found.groupBy(*keys, "epoch_ms").agg(*[F.max(F.when(F.col("_i") == i, F.col("_past"))).alias(f"past_{i}") for i in range(len(lookbacks_ms))])


def _distant_lows(rows: DataFrame, keys: list[str], window_ms: int, chunk_ms: int) -> DataFrame:
    """Add ``low_close, low_ms`` for windows longer than a chunk.

    The same prefix and suffix of blocks as :func:`_lows`, but a block's running minimum is taken in chunks and carried on.
    """
    has_close = F.col("close").isNotNull() & ~F.isnan("close")
    point = F.when(has_close, F.struct("close", "epoch_ms"))
    own = floor_to(F.col("epoch_ms"), window_ms)
    rows = rows.withColumn("_block", own)
    rows = running(rows, [*keys, "_block"], ["epoch_ms"], floor_to(F.col("epoch_ms"), chunk_ms), [Run("_prefix", "min", point, inclusive=False)])
    row = F.struct(*[c for c in rows.columns if c != "_block"])
    marks = rows.select(*keys, F.col("_block"), (-F.col("epoch_ms")).alias("_back"), F.lit(0).alias("_probe"), point.alias("_point"), F.lit(None).cast(rows.select(row.alias("r")).schema["r"].dataType).alias("_row"))
    back = F.col("epoch_ms") - window_ms
    probes = rows.select(*keys, floor_to(back, window_ms).alias("_block"), (-back).alias("_back"), F.lit(1).alias("_probe"), F.lit(None).cast(marks.schema["_point"].dataType).alias("_point"), row.alias("_row"))
    axis = running(marks.unionByName(probes), [*keys, "_block"], ["_back", "_probe"], floor_to(F.col("_back"), chunk_ms), [Run("_suffix", "min", F.col("_point"))])
    low = axis.where("_probe = 1").select("_row.*", "_suffix").withColumn("_low", F.least("_prefix", "_suffix")).drop("_prefix", "_suffix")
    below = F.col("_low.close") < F.col("close")
    found = {"low_close": F.when(below, F.col("_low.close")), "low_ms": F.when(below, F.col("_low.epoch_ms"))}
    return low.withColumns(found).drop("_low")


def _core(rows: DataFrame) -> DataFrame:
    return rows.where("_core").drop("_chunk", "_core")


def lookback_closes(
    candles: DataFrame, lookbacks_ms: list[int], chunk_ms: int, keys: tuple[str, ...] = ("symbol",)
) -> DataFrame:
    """Add ``past_<i>``: the close of the last candle at least ``lookbacks_ms[i]`` earlier that has one, NULL if none.

    All lookbacks share one shuffle and one sort. Candles without a close get no past ones.
    """
    found = _closes_before(with_close(candles), list(keys), lookbacks_ms, chunk_ms)
    bare = candles.where(F.col("close").isNull() | F.isnan("close"))
    return found.unionByName(bare.withColumns({f"past_{i}": F.lit(None).cast("double") for i in range(len(lookbacks_ms))}))


def _closes_before(path: DataFrame, keys: list[str], lookbacks_ms: list[int], chunk_ms: int) -> DataFrame:
    if max(lookbacks_ms) > chunk_ms:
        return join_on(path, _distant_closes(path.select(*keys, "epoch_ms", "close"), keys, lookbacks_ms, chunk_ms), [*keys, "epoch_ms"])
    return _core(_past_closes(chunk_with_halo(path, keys, "epoch_ms", chunk_ms, before_ms=max(lookbacks_ms), last_before=True), keys, lookbacks_ms))


def window_lows(
    candles: DataFrame, window_ms: int, chunk_ms: int, keys: tuple[str, ...] = ("symbol",)
) -> DataFrame:
    """Add ``low_close, low_ms``: lowest close in ``[now - window, now)``, earliest on ties, if below the current one."""
    if window_ms > chunk_ms:
        return _distant_lows(candles, list(keys), window_ms, chunk_ms)
    rows = chunk_with_halo(candles, list(keys), "epoch_ms", chunk_ms, before_ms=window_ms)
    return _core(_lows(rows, list(keys), window_ms))


def moves_fixed(path: DataFrame, keys: list[str], ys: list[int], chunk_ms: int) -> DataFrame:
    """Add ``move_<i>``: percent move over lookback ``ys[i]`` seconds, NULL where there is none."""
    past = _closes_before(path, keys, [y * 1000 for y in ys], chunk_ms)
    return past.select(
        *path.columns, *[percent_move(F.col("close"), F.col(f"past_{i}")).alias(f"move_{i}") for i in range(len(ys))]
    )


def moves_dynamic(path: DataFrame, keys: list[str], y_max_s: int, chunk_ms: int) -> DataFrame:
    """Add ``move_0`` over the lowest close of the window and ``y_actual_seconds``, the distance to it."""
    return window_lows(path, y_max_s * 1000, chunk_ms, tuple(keys)).select(
        *path.columns,
        percent_move(F.col("close"), F.col("low_close")).alias("move_0"),
        ((F.col("epoch_ms") - F.col("low_ms")) / F.lit(1000.0)).alias("y_actual_seconds"),
    )


def long_moves(rows: DataFrame, ys: list[int], kept: list[str]) -> DataFrame:
    """One row per candle and lookback that has a move."""
    each: list[Column] = [
        F.struct(F.lit(int(y)).cast("long").alias("y"), F.col(f"move_{i}").alias("move")) for i, y in enumerate(ys)
    ]
    return (
        rows.select(*kept, F.explode(F.array(*each)).alias("_m"))
        .select(*kept, "_m.y", "_m.move")
        .where(F.col("move").isNotNull())
    )


def signals_fixed(
    candles: DataFrame, xs: list[float], ys: list[int], chunk_ms: int, keys: tuple[str, ...] = ("symbol",)
) -> DataFrame:
    """Candles that rose by at least ``x`` percent over ``y`` seconds, per (x, y)."""
    path = with_close(candles.select(*keys, "epoch_ms", "close"))
    moves = moves_fixed(path, list(keys), ys, chunk_ms)
    return _reaching(long_moves(moves, ys, [*keys, "epoch_ms", "close"]), xs)


def signals_dynamic(
    candles: DataFrame, xs: list[float], y_max_s: int, chunk_ms: int, keys: tuple[str, ...] = ("symbol",)
) -> DataFrame:
    """Candles at least ``x`` percent above the lowest close of the window, with the lookback found."""
    path = with_close(candles.select(*keys, "epoch_ms", "close"))
    moves = moves_dynamic(path, list(keys), y_max_s, chunk_ms).select(*keys, "epoch_ms", "close", F.col("move_0").alias("move"), "y_actual_seconds")
    return _reaching(moves.where(F.col("move").isNotNull()), xs)


def _reaching(moves: DataFrame, xs: list[float]) -> DataFrame:
    levels = F.array(*[F.lit(float(x)) for x in xs])
    reached = F.filter(levels, lambda x: F.col("move") >= x)
    return moves.where(F.col("move") >= min(xs)).withColumn("x", F.explode(reached))
