"""Searches along time that reach further than a chunk: a tree over chunks instead of chunks as long as the search.

Rows are cut into chunks of a chosen width, whatever the horizon. Every chunk, and every span of ``fan`` chunks, is a
node with the lowest and highest values below it. What a search does not settle in its own chunk looks at the nodes after
it - the chunks left in its span, then whole spans - and the first node whose extreme passes holds the first hit: the search
goes down into that span, then into that chunk. ``fan`` is the root of the number of chunks in the horizon, so a search sees
about ``2 * fan`` nodes. Searches of one chunk share the nodes they see; searches that ask the same are asked once; and into
a chunk they go by their own chunk, so no task gets all that end at one crash.
"""

from __future__ import annotations

from collections.abc import Callable
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktape.functions.positions import block_table, first_hit
from sparktape.functions.timeops import floor_to
from sparktape.lineage import saved
from sparktape.operators.scans import join_on

#: ``passes(values, queries)``: whether each query's value passes; ``queries`` gives columns by name.
Passes = Callable[[np.ndarray, dict[str, np.ndarray]], np.ndarray]


def fan_of(horizon_ms: int, chunk_ms: int) -> int:
    """Chunks in a span, so that a horizon has about as many spans as a span has chunks."""
    return max(2, isqrt(-(-int(horizon_ms) // int(chunk_ms))) + 1)


def _steps(start: Column, stop: Column, step: int) -> Column:
    """``start, start + step, ..`` up to ``stop``, none if it lies before ``start``."""
    empty = F.array().cast("array<bigint>")
    return F.when(start <= stop, F.sequence(start, stop, F.lit(int(step)).cast("long"))).otherwise(empty)


def _addresses(after: Column, upto: Column, chunk_ms: int, fan: int, whole_spans: bool) -> Column:
    """Nodes (level, start) that cover the chunks after ``after`` and before ``upto``.

    With ``whole_spans`` the last span is a single node, even where it reaches beyond ``upto``.
    """
    width = chunk_ms * fan
    own, last = floor_to(after, width), floor_to(upto, width)
    near = _steps(after + chunk_ms, F.least(own + width, upto) - chunk_ms, chunk_ms)
    spans = _steps(own + width, last if whole_spans else last - width, width)
    node = lambda level: lambda start: F.struct(F.lit(level).alias("level"), start.alias("start"))
    if whole_spans:
        return F.concat(F.transform(_steps(after + chunk_ms, own + width - chunk_ms, chunk_ms), node(0)), F.transform(spans, node(1)))
    far = _steps(F.greatest(last, after + chunk_ms), F.when(last > own, upto - chunk_ms), chunk_ms)
    return F.concat(F.transform(near, node(0)), F.transform(spans, node(1)), F.transform(F.coalesce(far, F.array().cast("array<bigint>")), node(0)))


def tree(chunks: DataFrame, keys: list[str], chunk_ms: int, fan: int, folds: dict[str, str]) -> DataFrame:
    """Nodes ``keys, level, start`` and folded values, from one row per ``keys, _chunk``; saved. ``folds``: column to min or max."""
    fold = lambda c, kind: (F.min if kind == "min" else F.max)(c).alias(c)
    low = chunks.select(*keys, F.lit(0).alias("level"), F.col("_chunk").alias("start"), *folds)
    span = floor_to(F.col("_chunk"), chunk_ms * fan)
    high = chunks.groupBy(*keys, span.alias("start")).agg(*[fold(c, k) for c, k in folds.items()])
    return saved(low.unionByName(high.select(*keys, F.lit(1).alias("level"), "start", *folds)))


def _first(queries: pa.Table, rows: pa.Table, value: str, lowest: bool, passes: Passes, columns: list[str], place: str, more: list[str]) -> pa.Table:
    """The queries with ``place`` (and more columns) of the first row, in time, whose value passes; NULL if none does."""
    rows = rows.sort_by(place)
    n = rows.num_rows
    at = np.full(queries.num_rows, n, np.int64)
    if n and queries.num_rows:
        own = {c: queries[c].to_numpy() for c in columns}
        table = block_table(rows[value].to_numpy(), np.fmin if lowest else np.fmax)
        at = first_hit(table, np.zeros(queries.num_rows, np.int64), lambda values: passes(values, own))
    places = pa.array(at, mask=at == n)
    for c in [place, *more]:
        queries = queries.append_column(c, rows[c].take(places) if n else pa.nulls(queries.num_rows, rows[c].type))
    return queries


def first_hits(
    queries: DataFrame, columns: list[str], candles: DataFrame, nodes: DataFrame, keys: list[str], value: str, lowest: bool, passes: Passes, chunk_ms: int, horizon_ms: int
) -> DataFrame:
    """Add ``hit_ms``: time of the first candle after the query's ``_chunk`` whose ``value`` passes, NULL if there is none near.

    ``queries``: ``keys, _chunk`` and the ``columns`` that ``passes`` reads, each asked once. ``candles``: ``keys, _chunk,
    epoch_ms`` and values, at least the record ones of each chunk. All candles of the horizon are searched; hits beyond it
    may be found or not.
    """
    fan = fan_of(horizon_ms, chunk_ms)
    width = chunk_ms * fan
    own = [*keys, "_chunk"]
    queries = saved(queries.select(*own, *columns).distinct())
    owners = queries.select(*own).distinct()
    seen = owners.withColumn("_node", F.explode(_addresses(F.col("_chunk"), F.col("_chunk") + (chunk_ms + horizon_ms), chunk_ms, fan, True)))
    seen = seen.select(*own, F.col("_node.level").alias("level"), F.col("_node.start").alias("start"))
    seen = join_on(seen, nodes.select(*keys, "level", "start", value), [*keys, "level", "start"])

    def searched(asked: DataFrame, rows: DataFrame, group: list[str], place: str, more: list[str]) -> DataFrame:
        kinds = T.StructType([*asked.schema.fields, *[T.StructField(c, rows.schema[c].dataType) for c in [place, *more]]])
        names = asked.columns
        rows = rows.select(*[F.col(c).alias(c) for c in rows.columns])  # columns of their own, as both sides come from the queries
        return (
            asked.groupBy(*group).cogroup(rows.groupBy(*group))
            .applyInArrow(lambda q, r: _first(q.select(names), r, value, lowest, passes, columns, place, more), kinds)
        )

    found = saved(searched(queries, seen, own, "start", ["level"]))
    # Down from spans to chunks, for the spans that searches end in.
    wide = found.where("level = 1").select(*own, *columns, F.col("start").alias("_span"))
    chunks = nodes.where("level = 0").select(*keys, F.col("start").alias("_at"), value, floor_to(F.col("start"), width).alias("_span"))
    below = join_on(wide.select(*own, "_span").distinct(), chunks, [*keys, "_span"])
    wide = searched(wide, below, [*own, "_span"], "_at", [])
    near = found.where("level = 0").select(*own, *columns, F.col("start").alias("_at"))
    near = saved(near.unionByName(wide.select(*near.columns)))
    # Down from chunks to candles; only new lows (highs) of a chunk can be first hits.
    here = Window.partitionBy(*own).orderBy("epoch_ms").rowsBetween(Window.unboundedPreceding, -1)
    before = (F.min if lowest else F.max)(value).over(here)
    record = before.isNull() | (F.col(value) < before if lowest else F.col(value) > before)
    records = candles.select(*own, "epoch_ms", value).withColumn("_record", record).where("_record").drop("_record")
    records = records.select(*keys, F.col("_chunk").alias("_at"), F.col("epoch_ms").alias("hit_ms"), value)
    below = join_on(near.select(*own, "_at").distinct(), records, [*keys, "_at"])
    hits = searched(near, below, [*own, "_at"], "hit_ms", []).select(*own, *columns, "hit_ms")
    missed = found.where("level is null").select(*own, *columns, F.lit(None).cast("long").alias("hit_ms"))
    return hits.unionByName(missed)


def between(pairs: DataFrame, nodes: DataFrame, keys: list[str], folds: dict[str, str], chunk_ms: int, fan: int) -> DataFrame:
    """Folded values over the chunks strictly between ``_chunk`` and ``_until``, per distinct pair; NULL where there are none."""
    group = [*keys, "_chunk", "_until"]
    pairs = pairs.select(*group).distinct()
    rows = pairs.withColumn("_node", F.explode_outer(_addresses(F.col("_chunk"), F.col("_until"), chunk_ms, fan, False)))
    rows = rows.select(*group, F.col("_node.level").alias("level"), F.col("_node.start").alias("start"))
    rows = join_on(rows, nodes.select(*keys, "level", "start", *folds), [*keys, "level", "start"], "left")
    return rows.groupBy(*group).agg(*[(F.min if kind == "min" else F.max)(c).alias(c) for c, kind in folds.items()])
