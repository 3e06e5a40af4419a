"""One open trade at a time: walk a key's intervals in order, take each that starts after the last taken one ends.

The walk is sequential, but what a time chunk does to it is a step function of the end carried in: only the first
start after that end matters. Each chunk is reduced to these steps on its own; steps of neighbouring chunks combine the
same way into larger spans; a walk over the top spans then hands every chunk the end it starts from, and chunks are
walked in parallel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparktape.functions.timeops import floor_to
from sparktape.operators.scans import spread


def _links(rows: pa.Table, lane: str, start: str, end: str):
    """Rows by (lane, start), their ends, lane codes, and the position each row leads to (its own when none)."""
    lanes, starts, ends = (rows[c].to_numpy() for c in (lane, start, end))
    order = np.lexsort((ends, starts, lanes))
    lanes, starts, ends = lanes[order], starts[order], ends[order]
    code = np.cumsum(np.append(False, lanes[1:] != lanes[:-1])).astype(np.int64)
    base = starts.min()
    stride = max(starts.max(), ends.max()) - base + 1
    line = code * stride + (starts - base)
    nxt = np.searchsorted(line, code * stride + (ends - base), side="right")
    stays = (nxt == len(order)) | (code[np.minimum(nxt, len(order) - 1)] != code)
    nxt = np.where(stays, np.arange(len(order)), nxt)
    return rows.take(pa.array(order)), ends, code, line, nxt, (base, stride)


def _steps(rows: pa.Table, lane: str, start: str, end: str) -> pa.Table:
    """Per first start of the walk, the end it leaves the chunk with; equal neighbours merged."""
    rows, ends, code, _, nxt, _ = _links(rows, lane, start, end)
    while True:
        further = nxt[nxt]
        if np.array_equal(further, nxt):
            break
        nxt = further
    left = ends[nxt]
    last = np.append((code[1:] != code[:-1]) | (left[1:] != left[:-1]), True)
    rows = rows.set_column(rows.column_names.index(end), end, pa.array(left))
    return rows.filter(pa.array(last))


def _walk(rows: pa.Table, carried: pa.Table | None, lane: str, start: str, end: str) -> pa.Table:
    """Rows visited per lane, with ``_from``: the end carried into the row (NULL at the very start)."""
    if carried is not None:
        rows = rows.filter(pc.is_in(rows[lane], value_set=carried[lane].combine_chunks()))
    if rows.num_rows == 0:
        return rows.append_column("_from", pa.array([], type=pa.int64()))
    rows, ends, code, line, nxt, (base, stride) = _links(rows, lane, start, end)
    here = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    came, known = np.full(len(here), -1, dtype=np.int64), np.zeros(len(here), dtype=bool)
    if carried is not None:
        lanes = np.arange(len(here))
        given = carried.take(pc.index_in(rows[lane].take(pa.array(here)), value_set=carried[lane].combine_chunks()))
        known = given["_from"].is_valid().to_numpy()
        came = given["_from"].fill_null(-1).to_numpy()
        shift = np.clip(np.where(known, came - base, -1), -1, stride - 1)
        pos = np.searchsorted(line, lanes * stride + shift, side="right")
        alive = (pos < len(line)) & (code[np.minimum(pos, len(line) - 1)] == lanes)
        here, came, known = pos[alive], came[alive], known[alive]
    visits = []
    while len(here):
        visits.append((here, came, known))
        go = nxt[here] != here
        came, known, here = ends[here][go], np.ones(go.sum(), dtype=bool), nxt[here][go]
    if not visits:
        return rows.slice(0, 0).append_column("_from", pa.array([], type=pa.int64()))
    at, came, known = (np.concatenate(parts) for parts in zip(*visits))
    return rows.take(pa.array(at)).append_column("_from", pa.array(came, mask=~known))


def _at_levels(rows: pa.Table, lane: str, value: str | None, levels: tuple[float, ...]):
    """The rows that reach each level, in a lane of their own for each level: ``lane * len(levels) + i``."""
    if value is None:
        yield rows
        return
    number, reached = rows[lane].to_numpy(), rows[value].to_numpy()
    place = rows.column_names.index(lane)
    for i, level in enumerate(levels):
        passing = np.flatnonzero(reached >= level)
        if len(passing):
            part = rows.take(pa.array(passing))
            yield part.set_column(place, lane, pa.array(number[passing] * len(levels) + i))


def select_nonoverlapping(
    df: DataFrame,
    keys: list[str],
    lane: str,
    start: str,
    end: str,
    chunk_ms: int,
    lanes_together: int = 64,
    spans: tuple[int, ...] = (32,),
    value: str | None = None,
    levels: tuple[float, ...] = (),
    rows_expected: int = 0,
) -> DataFrame:
    """Rows the greedy walk takes, per ``keys`` and ``lane``.

    ``lane`` is an integer key, such as a parameter-set id; a task handles up to ``lanes_together`` of them so that
    large grids do not end in tiny groups. ``spans`` are the fan-ins of the spans above the chunks. ``start`` and
    ``end`` are epoch ms, and every interval ends at or after its start.

    With ``levels`` a row takes part in one walk for each level that its ``value`` reaches; a row is shuffled once for all of
    them, and the lane of what is taken is ``lane * len(levels) + i``. Every column of ``df`` passes through Python
    workers twice, so keep it narrow and join the rest to the result.
    """
    group = [*keys, "_lanes"]
    columns = df.columns
    df = df.withColumn(lane, F.col(lane).cast("long"))
    rows = df.withColumns(
        {"_lanes": F.floor(F.col(lane) / lanes_together).cast("long"), "_span0": floor_to(F.col(start), int(chunk_ms))}
    )
    rows = spread(rows, *group, "_span0", rows=rows_expected)
    fields = [rows.schema[c] for c in (*keys, "_lanes", "_span0", lane, start, end)]
    step_schema = T.StructType(fields)
    wanted = [f.name for f in fields]

    widths = [int(chunk_ms)]
    for fan_in in spans:
        widths.append(widths[-1] * int(fan_in))
    def first_steps(part: pa.Table) -> pa.Table:
        found = [_steps(own.select(wanted), lane, start, end) for own in _at_levels(part, lane, value, levels)]
        return pa.concat_tables(found) if found else part.select(wanted).slice(0, 0)

    def last_walk(part: pa.Table, given: pa.Table) -> pa.Table:
        found = [_walk(own, given, lane, start, end).select(columns) for own in _at_levels(part, lane, value, levels)]
        return pa.concat_tables(found) if found else part.select(columns).slice(0, 0)

    steps = [rows.groupBy(*group, "_span0").applyInArrow(first_steps, step_schema)]
    for width in widths[1:]:
        lower = steps[-1].withColumn("_up", floor_to(F.col(start), width))
        steps.append(
            lower.drop("_span0")
            .withColumnRenamed("_up", "_span0")
            .groupBy(*group, "_span0")
            .applyInArrow(lambda part: _steps(part.select(wanted), lane, start, end), step_schema)
        )

    from_field = T.StructField("_from", T.LongType())
    carry_schema = T.StructType([*[rows.schema[c] for c in (*group, "_span0", lane)], from_field])
    carry_columns = [f.name for f in carry_schema]
    carried = steps[-1].groupBy(*group).applyInArrow(
        lambda part: _walk(part, None, lane, start, end).select(carry_columns), carry_schema
    )
    for level in range(len(spans), 0, -1):
        lower = steps[level - 1].withColumn("_up", floor_to(F.col(start), widths[level]))
        carried = (
            lower.groupBy(*group, "_up")
            .cogroup(carried.withColumnRenamed("_span0", "_up").groupBy(*group, "_up"))
            .applyInArrow(
                lambda part, given: _walk(part, given, lane, start, end).select(carry_columns), carry_schema
            )
        )
    return (
        rows.groupBy(*group, "_span0")
        .cogroup(carried.groupBy(*group, "_span0"))
        .applyInArrow(last_walk, df.schema)
    )
