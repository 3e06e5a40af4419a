"""Running aggregates and neighbour access on long ordered keys.

A window partitioned by a key alone puts that key's whole history in one task. Both helpers below cut the order
into chunks, so a task sees one (key, chunk) at a time, and carry what crosses a chunk edge through a table
with one row per (key, chunk).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktape.functions.timeops import floor_to
from sparktape.lineage import saved


# Rows of one partition of a stage in Python.
ROWS_PER_PARTITION = 2_000_000


@dataclass(frozen=True)
class Run:
    """One running aggregate: ``kind`` is sum, max, min or last (last skips NULL)."""

    name: str
    kind: str
    value: Column
    inclusive: bool = True


def _fold(kind: str, value: Column) -> Column:
    if kind == "last":
        return F.last(value, ignorenulls=True)
    return {"sum": F.sum, "max": F.max, "min": F.min}[kind](value)


def _join_runs(kind: str, local: Column, carried: Column) -> Column:
    if kind == "sum":
        return F.when(local.isNull(), carried).when(carried.isNull(), local).otherwise(carried + local)
    if kind == "last":
        return F.coalesce(local, carried)
    return {"max": F.greatest, "min": F.least}[kind](local, carried)


def running(
    df: DataFrame, keys: list[str], order: list[str], chunk: Column, runs: list[Run]
) -> DataFrame:
    """Add running aggregates along ``order`` within ``keys``.

    ``chunk`` must not decrease along ``order``; a (key, chunk) must fit a task. The order columns are numeric; negate
    them for a descending scan.
    """
    names = [f"_v{i}" for i in range(len(runs))]
    src = df.withColumn("_chunk", chunk).withColumns({n: r.value for n, r in zip(names, runs)})
    here = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    local = src.withColumns(
        {
            f"_l{n}": _fold(r.kind, F.col(n)).over(
                here.rowsBetween(Window.unboundedPreceding, 0 if r.inclusive else -1)
            )
            for n, r in zip(names, runs)
        }
    )
    # Saved, so that ``df`` is computed and shuffled once: both the chunks' totals and the rows start from here.
    local = saved(local)
    totals = local.groupBy(*keys, "_chunk").agg(
        *[
            F.max_by(n, F.when(F.col(n).isNotNull(), F.struct(*order))).alias(n)
            if r.kind == "last"
            else _fold(r.kind, F.col(n)).alias(n)
            for n, r in zip(names, runs)
        ]
    )
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = saved(
        totals.select(
            *keys, "_chunk", *[_fold(r.kind, F.col(n)).over(earlier).alias(f"_c{n}") for n, r in zip(names, runs)]
        )
    )
    joined = join_on(local, carry, [*keys, "_chunk"], "left")
    return joined.select(
        *df.columns,
        *[_join_runs(r.kind, F.col(f"_l{n}"), F.col(f"_c{n}")).alias(r.name) for n, r in zip(names, runs)],
    )


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where NULL equals NULL; the result has the left side's keys."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys]
    return left.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def with_close(candles: DataFrame) -> DataFrame:
    """Candles that have a close; the others are no candles to signals, exits and walks."""
    return candles.where(F.col("close").isNotNull() & ~F.isnan("close"))


def chunk_with_halo(
    df: DataFrame,
    keys: list[str],
    time: str,
    chunk_ms: int,
    before_ms: int = 0,
    after_ms: int = 0,
    last_before: bool = False,
    first_after: bool = False,
) -> DataFrame:
    """Give every row its time chunk (``_chunk``) and copy it to the neighbours that need to see it.

    Chunk ``c`` also receives the rows of ``[c - before, c)`` and ``[end, end + after]``; with ``last_before`` /
    ``first_after`` the one row next to that span as well, however far away it is. Copies have ``_core`` false.
    A row is copied at most twice because the chunk is never shorter than a halo.
    """
    width = max(int(chunk_ms), int(before_ms), int(after_ms))
    t = F.col(time)
    own = df.withColumn("_own", floor_to(t, width))
    offset = t - F.col("_own")
    targets = [F.col("_own")]
    if before_ms:
        targets.append(F.when(offset >= width - before_ms, F.col("_own") + width))
    if after_ms:
        targets.append(F.when(offset <= after_ms, F.col("_own") - width))
    rows = (
        own.withColumn("_chunk", F.explode(F.array_compact(F.array(*targets))))
        .withColumn("_core", F.col("_chunk") == F.col("_own"))
        .drop("_own")
    )
    if not (last_before or first_after):
        return rows
    sides = []
    if last_before:
        sides.append((F.max_by, offset < width - before_ms, -1))
    if first_after:
        sides.append((F.min_by, offset > after_ms, 1))
    # Column by column rather than as one struct: plain numbers keep this a hash aggregate.
    carried = [c for c in df.columns if c not in keys]
    edges = own.groupBy(*keys, "_own").agg(
        *[
            pick(c, order).alias(f"_{name}{step}_{c}")
            for pick, inside, step in sides
            for name, order in (("near", F.when(inside, t)), ("any", t))
            for c in carried
        ]
    )

    def edge(name: str, step: int) -> Column:
        part = {c: F.col(f"_{name}{step}_{c}") for c in carried}
        return F.when(part[time].isNotNull(), F.struct(*[part.get(c, F.col(c)).alias(c) for c in df.columns]))

    by_chunk = Window.partitionBy(*keys).orderBy("_own")
    seeds = []
    for _, _, step in sides:
        near, far = edge("near", step), edge("any", step)
        at = lambda c, steps, step=step: F.lead(c, steps * step).over(by_chunk)
        adjacent = at(F.col("_own"), 1) == F.col("_own") + step * width
        seeds.append(F.when(adjacent, F.coalesce(at(near, 1), at(far, 2))).otherwise(at(far, 1)))
    outer = edges.select(F.col("_own").alias("_chunk"), F.array(*seeds).alias("_rows")).select(
        "_chunk", F.explode(F.array_compact("_rows")).alias("_row")
    )
    return rows.unionByName(outer.select("_row.*", "_chunk", F.lit(False).alias("_core")))


def spread(df: DataFrame, *columns: str, rows: int = 0) -> DataFrame:
    """Hash partitions in the session's full number, more where ``rows`` are expected to need them.

    For stages that run in Python: they cost far more per byte than Spark assumes when it merges small partitions.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // ROWS_PER_PARTITION)), *columns)
